"""Text wrapping, Unicode normalisation, bytes, CSV: exact rules that need Python run on Arrow batches."""

from __future__ import annotations

import csv as _csv
import io
import struct
import textwrap
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _arrow(kind: str, f):
    @F.pandas_udf(kind)
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else f(v))

    return run


def dedent(x: Column) -> Column:
    return _arrow("string", textwrap.dedent)(x)


def wrap(x: Column, width: int = 70) -> Column:
    return _arrow("array<string>", lambda v: textwrap.wrap(v, width))(x)


def fill(x: Column, width: int = 70) -> Column:
    return F.array_join(wrap(x, width), "\n")


def shorten(x: Column, width: int, placeholder: str = " [...]") -> Column:
    return _arrow("string", lambda v: textwrap.shorten(v, width, placeholder=placeholder))(x)


def indent(x: Column, prefix: str) -> Column:
    """Lines with anything but blanks get the prefix."""
    return F.regexp_replace(x, "(?md)^(?=.*\\S)", prefix.replace("\\", "\\\\").replace("$", "\\$"))


def normalize(x: Column, form: str) -> Column:
    if form not in ("NFC", "NFD", "NFKC", "NFKD"):
        raise ValueError("invalid normalization form")
    return _arrow("string", lambda v: unicodedata.normalize(form, v))(x)


def is_normalized(x: Column, form: str) -> Column:
    return normalize(x, form) == x


def csv_row(line: Column, delimiter: str = ",", quotechar: str = '"') -> Column:
    """Fields of one CSV record; a quoted field may hold line breaks."""

    def one(v: str) -> list[str]:
        return next(_csv.reader(io.StringIO(v), delimiter=delimiter, quotechar=quotechar), [])

    return _arrow("array<string>", one)(line)


def csv_dict(line: Column, fieldnames: list[str], restkey: str = "rest", restval: str | None = None) -> Column:
    """map of field name to value; missing fields get restval, surplus ones are joined under restkey."""
    fields = csv_row(line)
    named = [F.coalesce(F.try_element_at(fields, F.lit(k + 1)), F.lit(restval)) for k in range(len(fieldnames))]
    base = F.map_from_arrays(F.array(*map(F.lit, fieldnames)), F.array(*named))
    rest = F.slice(fields, len(fieldnames) + 1, F.greatest(F.size(fields), F.lit(1)))
    return F.when(F.size(rest) > 0, F.map_concat(base, F.create_map(F.lit(restkey), F.array_join(rest, ",")))).otherwise(base)


def csv_write(fields: Column, delimiter: str = ",", terminator: str = "\r\n") -> Column:
    """One record with minimal quoting."""

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        def one(row) -> str:
            out = io.StringIO()
            _csv.writer(out, delimiter=delimiter, lineterminator=terminator).writerow(["" if f is None else f for f in row])
            return out.getvalue()

        return rows.map(lambda r: None if r is None else one(r))

    return run(fields)


def bytes_hex(b: Column) -> Column:
    return F.lower(F.hex(b))


def bytes_lower(b: Column) -> Column:
    return _arrow("binary", bytes.lower)(b)


def bytes_upper(b: Column) -> Column:
    return _arrow("binary", bytes.upper)(b)


def bytes_strip(b: Column, chars: bytes | None = None) -> Column:
    return _arrow("binary", lambda v: v.strip(chars))(b)


def bytes_lstrip(b: Column, chars: bytes | None = None) -> Column:
    return _arrow("binary", lambda v: v.lstrip(chars))(b)


def bytes_rstrip(b: Column, chars: bytes | None = None) -> Column:
    return _arrow("binary", lambda v: v.rstrip(chars))(b)


def bytes_split(b: Column, sep: bytes | None = None, maxsplit: int = -1) -> Column:
    return _arrow("array<binary>", lambda v: v.split(sep, maxsplit))(b)


def bytes_rsplit(b: Column, sep: bytes | None = None, maxsplit: int = -1) -> Column:
    return _arrow("array<binary>", lambda v: v.rsplit(sep, maxsplit))(b)


def bytes_find(b: Column, sub: bytes | int) -> Column:
    return _arrow("int", lambda v: v.find(sub))(b)


def bytes_replace(b: Column, old: bytes, new: bytes, count: int = -1) -> Column:
    return _arrow("binary", lambda v: v.replace(old, new, count))(b)


def bytes_join(sep: bytes, items: Column) -> Column:
    return _arrow("binary", lambda v: sep.join(v))(items)


def bytes_decode(b: Column) -> Column:
    """UTF-8; null where the bytes are invalid."""
    return _arrow("string", lambda v: v.decode("utf-8") if _valid(v) else None)(b)


def _valid(v: bytes) -> bool:
    try:
        v.decode("utf-8")
        return True
    except UnicodeDecodeError:
        return False


def bytes_of(values: Column) -> Column:
    """``bytes([...])``: every value in 0..255, else the batch fails."""
    return _arrow("binary", lambda v: bytes(list(map(int, v))))(values)


def struct_pack(spec: str, *values: Column) -> Column:
    """``struct.pack(spec, *values)``."""
    struct.calcsize(spec)  # a wrong format fails before anything runs

    @F.pandas_udf("binary")
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([struct.pack(spec, *row) for row in zip(*columns)])

    return run(*values)


def struct_unpack(spec: str, b: Column, kind: str = "long") -> Column:
    """``struct.unpack(spec, b)`` as an array of one type."""
    struct.calcsize(spec)
    return _arrow(f"array<{kind}>", lambda v: list(struct.unpack(spec, v)))(b)
