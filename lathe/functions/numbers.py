"""Arithmetic, comparison and truth as Python defines them. ANSI mode is assumed: overflow and division by zero raise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Value = Column | int | float | str | bool


def col(x: Value) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def true_div(a: Value, b: Value) -> Column:
    return col(a).cast("double") / col(b).cast("double")


def floor_div(a: Value, b: Value) -> Column:
    """Integer division towards minus infinity."""
    a, b = col(a).cast("long"), col(b).cast("long")
    rest = a % b
    # a - rest is a multiple of b, so decimal division is exact; longs of 19 digits fit
    quotient = ((a.cast("decimal(20,0)") - rest) / b.cast("decimal(20,0)")).cast("long")
    return quotient - F.when((rest != 0) & ((rest < 0) != (b < 0)), 1).otherwise(0)


def mod(a: Value, b: Value) -> Column:
    """Remainder with the divisor's sign, for integers and floats."""
    a, b = col(a), col(b)
    rest = a % b
    zero = F.abs(rest) * F.when(b < 0, -1).otherwise(1)  # a float zero takes the divisor's sign as well
    return F.when((rest != 0) & ((rest < 0) != (b < 0)), rest + b).when(rest == 0, zero).otherwise(rest)


def float_floor_div(a: Value, b: Value) -> Column:
    """Floor division of floats by way of the remainder, as CPython computes it: zeros keep their sign, infinities give nan."""
    a, b = col(a).cast("double"), col(b).cast("double")
    rest = a % b
    exact = (a - rest) / b
    shifted = F.when((rest != 0) & ((b < 0) != (rest < 0)), exact - 1.0).otherwise(exact)
    floored = F.floor(shifted).cast("double")
    near = F.when(shifted - floored > 0.5, floored + 1.0).otherwise(floored)
    whole = F.when(F.abs(shifted) < 9e15, near).otherwise(shifted)
    zero = a / b * 0.0  # keeps the quotient's sign
    return F.when(F.isnan(a) | F.isnan(b) | F.abs(a).eqNullSafe(F.lit(float("inf"))), F.lit(float("nan"))).when(shifted == 0, zero).otherwise(whole)


def divmod_(a: Value, b: Value) -> Column:
    return F.struct(floor_div(a, b).alias("quotient"), mod(a, b).alias("remainder"))


def int_pow(base: Value, exponent: Value) -> Column:
    """Exact power of integers; overflow raises, a negative exponent gives null (Python gives a float there)."""
    base, exponent = col(base).cast("long"), col(exponent)
    # by squaring: 6 steps cover every exponent below 64, and larger ones overflow unless the base is -1, 0 or 1
    small = F.when(F.abs(base) > 1, exponent).otherwise(F.when(exponent > 1, 2 - exponent % 2).otherwise(exponent))
    times = F.array_repeat(base, F.least(small, F.lit(64)).cast("int"))
    return F.when(exponent >= 0, F.aggregate(times, F.lit(1).cast("long"), lambda acc, x: acc * x))


def left_shift(x: Value, n: Value) -> Column:
    """``x << n`` with a check: what does not fit a long raises, as does a negative count."""
    x, n = col(x).cast("long"), col(n)
    room = F.call_function("shiftleft", x, F.least(n, F.lit(63)).cast("int"))
    back = F.call_function("shiftright", room, F.least(n, F.lit(63)).cast("int"))
    fits = (x == 0) | ((n < 64) & (back == x))
    return F.when(n < 0, F.raise_error(F.lit("negative shift count"))).when(fits, F.when(x == 0, F.lit(0).cast("long")).otherwise(room)).otherwise(
        F.raise_error(F.lit("integer overflow in shift"))
    )


def right_shift(x: Value, n: Value) -> Column:
    x, n = col(x).cast("long"), col(n)
    return F.when(n < 0, F.raise_error(F.lit("negative shift count"))).otherwise(F.call_function("shiftright", x, F.least(n, F.lit(63)).cast("int")))


def round_(x: Value, digits: int = 0) -> Column:
    """Half to even on the exact binary value.

    The decimal expansion of a double is exact in decimal arithmetic only as a
    string of up to 50 digits; format_number rounds that value itself.
    """
    x = col(x)
    if digits >= 0:
        text = F.regexp_replace(F.format_number(x, digits), ",", "")
        rounded = text.cast("double")
    else:
        scale = float(10**-digits)
        rounded = F.rint(x / scale) * scale
    special = F.isnan(x) | (F.abs(x) == float("inf")) | (F.abs(x) >= 1e15)
    signed = F.when((rounded == 0) & ((x < 0) | x.cast("string").startswith("-")), F.lit(-0.0)).otherwise(rounded)
    return F.when(special, x).otherwise(signed)


def abs_(x: Value) -> Column:
    return F.abs(col(x))


def less(a: Value, b: Value) -> Column:
    """``a < b`` of floats: false wherever nan is involved, where Spark sorts nan last."""
    a, b = col(a), col(b)
    return ~F.isnan(a) & ~F.isnan(b) & (a < b)


def equal(a: Value, b: Value) -> Column:
    """``a == b``: None equals None only, nan nothing."""
    a, b = col(a), col(b)
    return a.eqNullSafe(b)


def float_equal(a: Value, b: Value) -> Column:
    a, b = col(a), col(b)
    return ~F.coalesce(F.isnan(a) | F.isnan(b), F.lit(False)) & a.eqNullSafe(b)


def between_chain(low: Value, x: Value, high: Value) -> Column:
    """``low <= x < high``."""
    x = col(x)
    return (col(low) <= x) & (x < col(high))


def truthy(x: Column, kind: str) -> Column:
    """bool(x) for a value of a simple type name; None is false."""
    if kind in ("string", "binary"):
        truth = F.length(x) > 0
    elif kind.startswith(("array", "map")):
        truth = F.size(x) > 0
    elif kind == "boolean":
        truth = x
    else:
        truth = x != 0
    return F.coalesce(truth, F.lit(False))


def and_(a: Column, b: Column, kind: str) -> Column:
    """``a and b``: the deciding operand, not a truth value."""
    return F.when(truthy(a, kind), b).otherwise(a)


def or_(a: Column, b: Column, kind: str) -> Column:
    return F.when(truthy(a, kind), a).otherwise(b)


def parse_int(text: Column, base: int = 10) -> Column:
    """``int(text, base)``; null where Python raises ValueError."""
    t = F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")
    prefix = {2: "0[bB]", 8: "0[oO]", 16: "0[xX]"}.get(base)
    if prefix:
        t = F.regexp_replace(t, f"^([+-]?){prefix}_?", "$1")
    digits = "0-9" if base >= 10 else f"0-{base - 1}"
    letters = "" if base <= 10 else f"a-{chr(86 + base)}A-{chr(54 + base)}"
    one = f"[{digits}{letters}]"
    ok = t.rlike(f"^[+-]?{one}(_?{one})*$")
    plain = F.regexp_replace(t, "_", "")
    value = plain.try_cast("bigint") if base == 10 else F.conv(plain, base, -10).try_cast("bigint")
    return F.when(ok, value)


def parse_float(text: Column) -> Column:
    """``float(text)``; null where Python raises ValueError."""
    t = F.lower(F.regexp_replace(text, "(?U)^\\s+|\\s+$", ""))
    number = t.rlike(r"^[+-]?(\d(_?\d)*\.?(\d(_?\d)*)?|\.\d(_?\d)*)(e[+-]?\d(_?\d)*)?$")
    plain = F.regexp_replace(t, "_", "")
    return (
        F.when(t.rlike("^[+]?(inf|infinity)$"), F.lit(float("inf")))
        .when(t.rlike("^-(inf|infinity)$"), F.lit(float("-inf")))
        .when(t.rlike("^[+-]?nan$"), F.lit(float("nan")))
        .when(number, plain.try_cast("double"))
    )


def to_base(x: Value, base: int) -> Column:
    """hex, oct or bin of an integer, the sign in front of the prefix."""
    x = col(x).cast("long")
    prefix = {2: "0b", 8: "0o", 16: "0x"}[base]
    digits = F.lower(F.conv(F.abs(x.cast("decimal(38,0)")).cast("string"), 10, base))
    return F.concat(F.when(x < 0, "-").otherwise(""), F.lit(prefix), digits)


def ord_(text: Column) -> Column:
    """Code point of a one-character text."""
    return F.when(F.length(text) == 1, F.conv(F.hex(F.encode(text, "utf-32")), 16, 10).cast("int"))


def chr_(code: Column) -> Column:
    """Character of a code point."""
    raw = F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0"))
    return F.when((code >= 0) & (code < 0x110000), F.decode(raw, "utf-32"))


def sqrt(x: Value) -> Column:
    """math.sqrt: a negative argument raises, where Spark gives nan."""
    x = col(x).cast("double")
    return F.when(x < 0, F.raise_error(F.lit("math domain error")).cast("double")).otherwise(F.sqrt(x))


def log10(x: Value) -> Column:
    """math.log10: zero and below raise."""
    x = col(x).cast("double")
    return F.when(x <= 0, F.raise_error(F.lit("math domain error")).cast("double")).otherwise(F.log10(x))


def floor(x: Value) -> Column:
    return F.floor(col(x))


def ceil(x: Value) -> Column:
    return F.ceil(col(x))


_TYPES = {"string": "str", "bigint": "int", "int": "int", "double": "float", "boolean": "bool", "binary": "bytes", "void": "NoneType"}


def type_name(kind: str) -> str:
    """Python's name of a column's type; types without one are refused."""
    if kind.startswith("array"):
        return "list"
    if kind.startswith("map"):
        return "dict"
    if kind.startswith("struct"):
        return "tuple"
    if kind not in _TYPES:
        raise ValueError(f"no Python type for {kind}")
    return _TYPES[kind]


def isinstance_(kind: str, *names: str) -> bool:
    """isinstance for a column's type, decided before anything runs; a bool is an int."""
    own = type_name(kind)
    return own in names or own == "bool" and "int" in names
