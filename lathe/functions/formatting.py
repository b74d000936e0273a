"""Display of values: str, repr, format specs, printf, templates."""

from __future__ import annotations

import json as _json
import re
import string
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def py_str(x: Column, kind: str) -> Column:
    """``str(x)`` for a value of a simple type name."""
    if kind in ("double", "float"):
        text = float_repr(x)
    elif kind == "boolean":
        text = F.when(x, "True").otherwise("False")
    else:
        text = x.cast("string")
    return F.when(x.isNull(), "None").otherwise(text)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def float_repr(x: Column) -> Column:
    """Shortest digits that round-trip, laid out as Python does: exponents outside -5..15 only."""

    def parted(raw: Column) -> Column:
        half = F.split(raw, "E", 2)
        return F.struct(
            F.when(raw.startswith("-"), "-").otherwise("").alias("sign"),
            F.ltrim(F.get(half, F.lit(0)), F.lit("-")).alias("mantissa"),
            F.coalesce(F.get(half, F.lit(1)), F.lit("0")).try_cast("int").alias("exponent"),
        )

    def pointed(p: Column) -> Column:
        # value = 0.DIGITS * 10 ** point
        whole = F.instr(p["mantissa"], ".") - 1
        digits = F.translate(p["mantissa"], ".", "")
        stripped = F.ltrim(digits, F.lit("0"))
        return F.struct(
            p["sign"].alias("sign"),
            F.rtrim(stripped, F.lit("0")).alias("digits"),
            (p["exponent"] + whole - F.length(digits) + F.length(stripped)).alias("point"),
        )

    def shown(p: Column) -> Column:
        digits, point = p["digits"], p["point"]
        n = F.length(digits)
        plain = (
            F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
            .when(point >= n, F.concat(digits, F.repeat(F.lit("0"), point - n), F.lit(".0")))
            .otherwise(F.concat(F.left(digits, point), F.lit("."), F.substring(digits, point + 1, n)))
        )
        tail = F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise("")
        size = F.abs(point - 1).cast("string")
        scientific = F.concat(F.left(digits, F.lit(1)), tail, F.lit("e"), F.when(point < 1, "-").otherwise("+"), F.when(F.length(size) < 2, "0").otherwise(""), size)
        return F.concat(p["sign"], F.when((point > -4) & (point <= 16), plain).otherwise(scientific))

    def signed(text: str) -> Column:
        return F.when(F.signum(x) < 0, "-" + text).otherwise(text)

    raw = x.cast("double").cast("string")
    return (
        F.when(F.isnan(x), "nan")
        .when(F.abs(x) == float("inf"), signed("inf"))
        .when(x == 0, F.when(raw.startswith("-"), "-0.0").otherwise("0.0"))
        .when(F.abs(x) == 5e-324, signed("5e-324"))  # older JVMs show two digits
        .otherwise(_let(_let(_let(raw, parted), pointed), shown))
    )


def _plain(value):
    """Arrow's containers as Python's own."""
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, list):
        return [_plain(v) for v in value]
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return value


def _arrow(f):
    """f over a column as text. Values of any type go to Python in Arrow batches; f itself is called once a value."""

    @F.arrow_udf("string")
    def run(x: pa.Array) -> pa.Array:
        return pa.array([f(v) for v in x.to_pylist()], pa.string())

    return run


def repr_(x: Column) -> Column:
    """``repr(x)`` of text, numbers, lists and nested values; quoting and nesting need Python, hence Arrow."""
    return _arrow(repr)(x)


def format_(x: Column, spec: str) -> Column:
    """``format(x, spec)``; the locale-dependent type n is refused."""
    if spec.endswith("n"):
        raise ValueError("format type n depends on the locale")
    return _arrow(lambda v: None if v is None else format(v, spec))(x)


def fixed(x: Column, digits: int, grouped: bool = False) -> Column:
    """``f"{x:.Nf}"`` or ``f"{x:,.Nf}"`` in the JVM: half to even, as Python rounds; Java's own formatter rounds half up."""
    text = F.format_number(x, digits)
    return text if grouped else F.regexp_replace(text, ",", "")


def percent_format(template: str, *values: Column) -> Column:
    """``template % values``."""

    @F.pandas_udf("string")
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([template % tuple(_plain(v) for v in row) for row in zip(*columns)])

    return run(*values)


def template(text: str, *values: Column, **named: Column) -> Column:
    """``text.format(*values, **named)``; conversions and nested specs included."""
    for _, field, _, _ in string.Formatter().parse(text):
        if field is not None and re.search(r"[.\[]", field):
            raise ValueError("fields with attributes or items are refused")
    names = list(named)

    @F.pandas_udf("string")
    def run(*columns: pd.Series) -> pd.Series:
        n = len(columns) - len(names)
        return pd.Series([text.format(*map(_plain, row[:n]), **dict(zip(names, map(_plain, row[n:])))) for row in zip(*columns)])

    return run(*values, *named.values())


def print_(*values: Column, kinds: list[str], sep: str = " ", end: str = "\n") -> Column:
    """The text that print writes."""
    return F.concat(F.concat_ws(sep, *[py_str(v, k) for v, k in zip(values, kinds)]), F.lit(end))


def json_dumps(x: Column, indent: int | None = None, sort_keys: bool = False, ensure_ascii: bool = True, separators: tuple[str, str] | None = None) -> Column:
    """``json.dumps``: the exact text, with NaN bare and ASCII escapes, which to_json lacks."""
    return _arrow(lambda v: _json.dumps(v, indent=indent, sort_keys=sort_keys, ensure_ascii=ensure_ascii, separators=separators))(x)


def json_rewrite(text: Column, indent: int | None = None, sort_keys: bool = False, ensure_ascii: bool = True) -> Column:
    """``json.dumps(json.loads(text))``; null where the text is no JSON."""

    def one(v):
        try:
            return None if v is None else _json.dumps(_json.loads(v), indent=indent, sort_keys=sort_keys, ensure_ascii=ensure_ascii)
        except ValueError:
            return None

    return _arrow(one)(text)


def json_loads(text: Column) -> Column:
    """VARIANT of a JSON text, null where it is none. Of repeated keys the last counts."""
    return F.try_parse_json(text)
