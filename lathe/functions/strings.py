"""String methods."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Python's white space; \\s in Unicode mode lacks the four separators.
SPACE = "[\\s\u001c-\u001f\u0085   -     　]"


def quote(literal: str) -> str:
    """A literal as a Java pattern."""
    return "\\Q" + literal.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def _arrow(kind: str, f):
    @F.pandas_udf(kind)
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else f(v))

    return run


def upper(x: Column) -> Column:
    return F.upper(x)


def lower(x: Column) -> Column:
    return F.lower(x)


def casefold(x: Column) -> Column:
    return _arrow("string", str.casefold)(x)


def swapcase(x: Column) -> Column:
    return _arrow("string", str.swapcase)(x)


def title(x: Column) -> Column:
    """Upper case after every character that is no letter; initcap knows blanks only."""
    return _arrow("string", str.title)(x)


def capitalize(x: Column) -> Column:
    return F.concat(F.upper(F.left(x, F.lit(1))), F.lower(F.substring(x, F.lit(2), F.length(x))))


def _set(chars: str | None) -> str:
    if chars is None:
        return SPACE
    return "[" + "".join("\\" + c if not c.isalnum() and ord(c) < 128 else c for c in chars) + "]" if chars else "(?!)"


def lstrip(x: Column, chars: str | None = None) -> Column:
    return F.regexp_replace(x, f"\\A{_set(chars)}+", "")


def rstrip(x: Column, chars: str | None = None) -> Column:
    # looked at from the first of a run only, else long runs take quadratic time
    return F.regexp_replace(x, f"(?<!{_set(chars)}){_set(chars)}++\\z", "")


def strip(x: Column, chars: str | None = None) -> Column:
    return rstrip(lstrip(x, chars), chars)


def split(x: Column, sep: str | None = None, maxsplit: int = -1) -> Column:
    if sep == "":
        raise ValueError("empty separator")
    if sep is None:
        if maxsplit < 0:
            # only the ends can be empty
            return F.array_remove(F.split(x, f"{SPACE}+", -1), "")
        body = lstrip(x)
        # the rest keeps its inner blanks; only the ends are cut
        parts = F.split(body, f"{SPACE}+", maxsplit + 1)
        last = F.size(parts) - 1
        parts = F.filter(F.transform(parts, lambda p, k: F.when(k == last, rstrip(p) if maxsplit == 0 else p).otherwise(p)), lambda p: p != "")
        return F.when(body == "", F.array().cast("array<string>")).otherwise(parts)
    return F.split(x, quote(sep), maxsplit + 1 if maxsplit >= 0 else -1)


def rsplit(x: Column, sep: str, maxsplit: int = -1) -> Column:
    parts = F.split(x, quote(sep), -1)
    if maxsplit < 0:
        return parts
    head = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - maxsplit, F.lit(0))), sep)
    tail = F.slice(parts, F.size(parts) - maxsplit + 1, F.lit(maxsplit)) if maxsplit else F.array().cast("array<string>")
    return F.when(F.size(parts) <= maxsplit + 1, parts).otherwise(F.concat(F.array(head), tail))


_BREAKS = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"


def splitlines(x: Column, keepends: bool = False) -> Column:
    parts = F.split(x, f"(?<=\n)|(?<=\r)(?!\n)|(?<=[\u000b\u000c\u001c\u001d\u001e\u0085  ])", -1) if keepends else F.split(x, _BREAKS, -1)
    whole = F.when(F.try_element_at(parts, F.lit(-1)) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.when(x == "", F.array().cast("array<string>")).otherwise(whole)


def join(sep: str, items: Column) -> Column:
    """``sep.join(items)``; a null item raises, where array_join would skip it."""
    return F.when(F.exists(items, lambda i: i.isNull()), F.raise_error(F.lit("sequence item: expected str, found None"))).otherwise(F.array_join(items, sep))


def replace(x: Column, old: str, new: str, count: int = -1) -> Column:
    if count < 0 and old:
        return F.replace(x, F.lit(old), F.lit(new))
    if count < 0 or not old:
        return _arrow("string", lambda v: v.replace(old, new, count))(x)
    parts = F.split(x, quote(old), count + 1)
    return F.array_join(parts, new)


def startswith(x: Column, *prefixes: str) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | x.startswith(p)
    return out


def endswith(x: Column, *suffixes: str) -> Column:
    out = F.lit(False)
    for p in suffixes:
        out = out | x.endswith(p)
    return out


def find(x: Column, sub: str) -> Column:
    return F.instr(x, sub) - 1


def rfind(x: Column, sub: str) -> Column:
    if sub == "":
        return F.length(x)
    at = F.instr(F.reverse(x), sub[::-1])
    return F.when(at == 0, -1).otherwise(F.length(x) - at - len(sub) + 1)


def index(x: Column, sub: str) -> Column:
    at = find(x, sub)
    return F.when(at < 0, F.raise_error(F.lit("substring not found"))).otherwise(at)


def rindex(x: Column, sub: str) -> Column:
    at = rfind(x, sub)
    return F.when(at < 0, F.raise_error(F.lit("substring not found"))).otherwise(at)


def count(x: Column, sub: str, start: int = 0, end: int | None = None) -> Column:
    piece = slice_(x, start, end) if start or end is not None else x
    if sub == "":
        return F.length(piece) + 1
    return F.size(F.split(piece, quote(sub), -1)) - 1


def _three(head: Column, sep: Column, tail: Column) -> Column:
    return F.struct(head.alias("head"), sep.alias("sep"), tail.alias("tail"))


def partition(x: Column, sep: str) -> Column:
    if not sep:
        raise ValueError("empty separator")
    at = F.instr(x, sep)
    found = _three(F.left(x, at - 1), F.lit(sep), F.substring(x, at + len(sep), F.length(x)))
    return F.when(at > 0, found).otherwise(_three(x, F.lit(""), F.lit("")))


def rpartition(x: Column, sep: str) -> Column:
    if not sep:
        raise ValueError("empty separator")
    at = rfind(x, sep)
    found = _three(F.left(x, at), F.lit(sep), F.substring(x, at + len(sep) + 1, F.length(x)))
    return F.when(at >= 0, found).otherwise(_three(F.lit(""), F.lit(""), x))


def removeprefix(x: Column, prefix: str) -> Column:
    return F.when(x.startswith(prefix), F.substring(x, F.lit(len(prefix) + 1), F.length(x))).otherwise(x)


def removesuffix(x: Column, suffix: str) -> Column:
    return F.when(x.endswith(suffix), F.left(x, F.length(x) - len(suffix))).otherwise(x) if suffix else x


def ljust(x: Column, width: int, fill: str = " ") -> Column:
    return F.when(F.length(x) < width, F.rpad(x, width, fill)).otherwise(x)


def rjust(x: Column, width: int, fill: str = " ") -> Column:
    return F.when(F.length(x) < width, F.lpad(x, width, fill)).otherwise(x)


def center(x: Column, width: int, fill: str = " ") -> Column:
    return _arrow("string", lambda v: v.center(width, fill))(x)


def zfill(x: Column, width: int) -> Column:
    sign = F.regexp_extract(x, "^[+-]", 0)
    body = F.substring(x, F.length(sign) + 1, F.length(x))
    padded = F.lpad(body, F.lit(width) - F.length(sign), F.lit("0"))
    return F.when(F.length(x) < width, F.concat(sign, padded)).otherwise(x)


def isalpha(x: Column) -> Column:
    return x.rlike("\\A\\p{L}+\\z")


def isdigit(x: Column) -> Column:
    """Decimal digits and superscripts, not fractions: CPython's rule."""
    return _arrow("boolean", str.isdigit)(x)


def isdecimal(x: Column) -> Column:
    return x.rlike("\\A\\p{Nd}+\\z")


def isnumeric(x: Column) -> Column:
    return _arrow("boolean", str.isnumeric)(x)


def isalnum(x: Column) -> Column:
    return _arrow("boolean", str.isalnum)(x)


def isspace(x: Column) -> Column:
    return x.rlike(f"\\A{SPACE}+\\z")


def islower(x: Column) -> Column:
    return x.rlike("\\p{Ll}") & ~x.rlike("[\\p{Lu}\\p{Lt}]")


def isupper(x: Column) -> Column:
    return x.rlike("\\p{Lu}") & ~x.rlike("[\\p{Ll}\\p{Lt}]")


def isascii(x: Column) -> Column:
    return x.rlike("\\A\\p{ASCII}*\\z")


def encode(x: Column) -> Column:
    return F.encode(x, "utf-8")


def decode(x: Column) -> Column:
    return F.decode(x, "utf-8")


def char_at(x: Column, k: int) -> Column:
    """``x[k]``; outside the text null, where Python raises IndexError."""
    at = F.lit(k + 1) if k >= 0 else F.length(x) + (k + 1)
    return F.when((at >= 1) & (at <= F.length(x)), F.substring(x, at, F.lit(1)))


def slice_(x: Column, start: int | None = None, stop: int | None = None, step: int = 1) -> Column:
    """``x[start:stop:step]`` with Python's clamping, of strings."""
    n = F.length(x)
    if step == 1:
        lo, hi = _bounds(n, start, stop)
        return F.substring(x, lo + 1, F.greatest(hi - lo, F.lit(0)))
    chars = F.filter(F.split(x, ""), lambda c: c != "")
    return F.array_join(F.transform(_places(n, start, stop, step), lambda k: F.get(chars, k)), "")


def _bounds(n: Column, start: int | None, stop: int | None) -> tuple[Column, Column]:
    def clamp(v: int | None, default: Column) -> Column:
        if v is None:
            return default
        return F.least(F.lit(v), n) if v >= 0 else F.greatest(n + v, F.lit(0))

    return clamp(start, F.lit(0)), clamp(stop, n)


def _places(n: Column, start: int | None, stop: int | None, step: int) -> Column:
    if step == 0:
        raise ValueError("slice step cannot be zero")
    if step > 0:
        lo, hi = _bounds(n, start, stop)
        some = lo < hi
        last = hi - 1
    else:

        def clamp(v: int | None, default: Column) -> Column:
            if v is None:
                return default
            return F.least(F.lit(v), n - 1) if v >= 0 else F.greatest(n + v, F.lit(-1))

        lo, last = clamp(start, n - 1), clamp(stop, F.lit(-1)) + 1
        some = lo >= last
    return F.when(some, F.sequence(lo, F.when(some, last).otherwise(lo), F.lit(step))).otherwise(F.array().cast("array<int>"))
