"""Dates, timestamps without zone, and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DIRECTIVES = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "f": "SSSSSS", "j": "DDD", "I": "hh",
    "p": "a", "A": "EEEE", "a": "EEE", "B": "MMMM", "b": "MMM", "F": "yyyy-MM-dd", "T": "HH:mm:ss",
}


def java_format(spec: str) -> str:
    """A strftime format as date_format's pattern; other directives are refused."""
    out, literal, k = [], [], 0

    def flush() -> None:
        if literal:
            out.append("'" + "".join(literal).replace("'", "''") + "'" if any(c.isalpha() or c == "'" for c in literal) else "".join(literal))
            literal.clear()

    while k < len(spec):
        if spec[k] == "%" and k + 1 < len(spec):
            code = spec[k + 1]
            k += 2
            if code == "%":
                literal.append("%")
                continue
            if code not in _DIRECTIVES:
                raise ValueError(f"unsupported directive %{code}")
            flush()
            out.append(_DIRECTIVES[code])
        else:
            literal.append(spec[k])
            k += 1
    flush()
    return "".join(out)


def date(year: Column, month: Column, day: Column) -> Column:
    return F.make_date(year, month, day)


def date_fromisoformat(text: Column) -> Column:
    return F.when(text.rlike(r"\A\d{4}-\d\d-\d\d\z"), text.try_cast("date"))


def datetime_fromisoformat(text: Column) -> Column:
    shape = r"\A\d{4}-\d\d-\d\d([T ]\d\d:\d\d(:\d\d(\.\d{3}(\d{3})?)?)?)?\z"
    return F.when(text.rlike(shape), text.try_cast("timestamp_ntz"))


def toordinal(d: Column) -> Column:
    return F.date_diff(d, F.lit("0001-01-01").cast("date")) + 1


def fromordinal(n: Column) -> Column:
    return F.date_add(F.lit("0001-01-01").cast("date"), (n - 1).cast("int"))


def weekday(d: Column) -> Column:
    return F.weekday(d)


def isoweekday(d: Column) -> Column:
    return F.weekday(d) + 1


def isoformat(x: Column, kind: str = "timestamp") -> Column:
    """The fraction is shown only where it is not zero."""
    if kind == "date":
        return F.date_format(x, "yyyy-MM-dd")
    fraction = F.date_format(x, "SSSSSS")
    return F.concat(F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss"), F.when(fraction == "000000", "").otherwise(F.concat(F.lit("."), fraction)))


def strftime(x: Column, spec: str) -> Column:
    return F.date_format(x, java_format(spec))


def replace(d: Column, year: int | None = None, month: int | None = None, day: int | None = None) -> Column:
    return F.make_date(
        F.lit(year) if year is not None else F.year(d), F.lit(month) if month is not None else F.month(d), F.lit(day) if day is not None else F.day(d)
    )


def combine(d: Column, hour: Column, minute: Column, second: Column) -> Column:
    return F.make_timestamp_ntz(F.year(d), F.month(d), F.day(d), hour, minute, second)


def timestamp(x: Column) -> Column:
    """Seconds since the epoch, in UTC."""
    return F.unix_micros(x.cast("timestamp")) / 1e6


def fromtimestamp(seconds: Column) -> Column:
    return F.timestamp_micros(F.rint(seconds * 1e6).cast("long")).cast("timestamp_ntz")


def add_seconds(x: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(x.cast("timestamp")) + F.rint(seconds * 1e6).cast("long")).cast("timestamp_ntz")


def total_seconds(later: Column, earlier: Column) -> Column:
    """``(later - earlier).total_seconds()``."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 1e6


def timedelta_parts(seconds: Column) -> Column:
    """struct<days, seconds, microseconds>, the last two never negative."""
    micros = F.rint(seconds * 1e6).cast("long")
    day = 86_400_000_000
    rest = F.pmod(micros, F.lit(day))
    return F.struct(((micros - rest) / day).cast("long").alias("days"), F.floor(rest / 1_000_000).alias("seconds"), (rest % 1_000_000).alias("microseconds"))
