"""List, dict and set methods on array and map columns. Columns are values: what Python changes in place is returned."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lathe.functions.strings import _bounds, _places

Lambda = Callable[[Column], Column]


# lists


def append(a: Column, v: Column) -> Column:
    return F.array_append(a, v)


def extend(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def insert(a: Column, k: int, v: Column) -> Column:
    at = F.least(F.lit(k), F.size(a)) if k >= 0 else F.greatest(F.size(a) + k, F.lit(0))
    return F.concat(F.slice(a, F.lit(1), at), F.array(v), F.slice(a, at + 1, F.size(a)))


def pop(a: Column, k: int = -1) -> Column:
    """struct<value, rest>."""
    at = F.lit(k + 1) if k >= 0 else F.size(a) + (k + 1)
    rest = F.concat(F.slice(a, F.lit(1), at - 1), F.slice(a, at + 1, F.size(a)))
    return F.when((at >= 1) & (at <= F.size(a)), F.struct(F.try_element_at(a, at).alias("value"), rest.alias("rest")))


def remove(a: Column, v: Column) -> Column:
    """Without the first equal element; array_remove drops all."""
    at = F.array_position(a, v).cast("int")
    cut = F.concat(F.slice(a, F.lit(1), F.greatest(at - 1, F.lit(0))), F.slice(a, at + 1, F.size(a)))
    return F.when(at > 0, cut).otherwise(F.raise_error(F.lit("the value to remove is not in the list")))


def index(a: Column, v: Column) -> Column:
    at = F.array_position(a, v)
    return F.when(at > 0, at - 1).otherwise(F.raise_error(F.lit("value is not in list")))


def count(a: Column, v: Column) -> Column:
    return F.size(F.filter(a, lambda x: x.eqNullSafe(v)))


def reverse(a: Column) -> Column:
    return F.reverse(a)


def item(a: Column, k: int) -> Column:
    at = F.lit(k + 1) if k >= 0 else F.size(a) + (k + 1)
    return F.when((at >= 1) & (at <= F.size(a)), F.try_element_at(a, F.greatest(at, F.lit(1))))


def slice_(a: Column, start: int | None = None, stop: int | None = None, step: int = 1) -> Column:
    n = F.size(a)
    if step == 1:
        lo, hi = _bounds(n, start, stop)
        return F.slice(a, lo + 1, F.greatest(hi - lo, F.lit(0)))
    return F.transform(_places(n, start, stop, step), lambda k: F.get(a, k))


def sort(a: Column, key: Lambda | None = None, reverse: bool = False) -> Column:
    """Stable sort; reversed, equal keys keep their order as in CPython."""
    tagged = F.transform(a, lambda x, k: F.struct((key(x) if key else x).alias("key"), k.alias("pos"), x.alias("x")))

    def compare(p: Column, q: Column) -> Column:
        first, second = (q, p) if reverse else (p, q)
        return (
            F.when(first["key"] < second["key"], -1).when(first["key"] > second["key"], 1).when(p["pos"] < q["pos"], -1).when(p["pos"] > q["pos"], 1).otherwise(0)
        )

    return F.transform(F.array_sort(tagged, compare), lambda t: t["x"])


def min_by(a: Column, key: Lambda) -> Column:
    """``min(a, key=...)``: the first of equals; null for an empty list."""
    return F.array_min(F.transform(a, lambda x, k: F.struct(key(x).alias("key"), k.alias("pos"), x.alias("x"))))["x"]


def max_by(a: Column, key: Lambda) -> Column:
    return F.array_max(F.transform(a, lambda x, k: F.struct(key(x).alias("key"), (-k).alias("pos"), x.alias("x"))))["x"]


def sum_(a: Column, start: Column) -> Column:
    """Left fold, in order."""
    return F.aggregate(a, start, lambda acc, x: acc + x)


def any_(a: Column, test: Lambda) -> Column:
    return F.exists(a, lambda x: F.coalesce(test(x), F.lit(False)))


def all_(a: Column, test: Lambda) -> Column:
    return F.forall(a, lambda x: F.coalesce(test(x), F.lit(False)))


def enumerate_(a: Column, start: int = 0) -> Column:
    return F.transform(a, lambda x, k: F.struct((k + start).alias("index"), x.alias("item")))


def zip_(*arrays: Column) -> Column:
    """Pairs up to the shortest list; arrays_zip alone pads with null."""
    n = F.least(*map(F.size, arrays)) if len(arrays) > 1 else F.size(arrays[0])
    return F.arrays_zip(*[F.slice(a, F.lit(1), n).alias(f"_{k}") for k, a in enumerate(arrays)])


def map_(f: Lambda, a: Column) -> Column:
    return F.transform(a, f)


def filter_(f: Lambda, a: Column) -> Column:
    return F.filter(a, lambda x: F.coalesce(f(x), F.lit(False)))


def range_(start: Column, stop: Column, step: int = 1) -> Column:
    """Half-open; empty where sequence would count the other way."""
    some = (start < stop) if step > 0 else (start > stop)
    last = stop - (1 if step > 0 else -1)
    return F.when(some, F.sequence(start, F.when(some, last).otherwise(start), F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def repeat(a: Column, n: Column) -> Column:
    return F.flatten(F.array_repeat(a, F.greatest(n, F.lit(0)).cast("int")))


def contains(a: Column, v: Column) -> Column:
    return F.exists(a, lambda x: x.eqNullSafe(v))


def comprehension(a: Column, element: Lambda, condition: Lambda | None = None) -> Column:
    """``[element(x) for x in a if condition(x)]``."""
    return F.transform(filter_(condition, a) if condition else a, element)


def nested(a: Column, inner: Lambda, element: Callable[[Column, Column], Column]) -> Column:
    """``[element(x, y) for x in a for y in inner(x)]``."""
    return F.flatten(F.transform(a, lambda x: F.transform(inner(x), lambda y: element(x, y))))


# dicts


def get(m: Column, k: Column, default: Column | None = None) -> Column:
    """``m.get(k, default)``: a stored None is not a missing key."""
    found = F.map_contains_key(m, k)
    value = F.try_element_at(m, k)
    return F.when(found, value) if default is None else F.when(found, value).otherwise(default)


def lookup(m: Column, k: Column) -> Column:
    """``m[k]``; a missing key raises."""
    return F.when(F.map_contains_key(m, k), F.try_element_at(m, k)).otherwise(F.raise_error(F.concat(F.lit("KeyError: "), k.cast("string"))))


def setdefault(m: Column, k: Column, v: Column) -> Column:
    return F.when(F.map_contains_key(m, k), m).otherwise(F.map_concat(m, F.create_map(k, v)))


def dict_pop(m: Column, k: Column) -> Column:
    return F.struct(F.try_element_at(m, k).alias("value"), F.map_filter(m, lambda key, _: key != k).alias("rest"))


def popitem(m: Column) -> Column:
    return F.try_element_at(F.map_entries(m), F.lit(-1))


def update(m: Column, other: Column) -> Column:
    """Right wins, keys keep their first place. Needs spark.sql.mapKeyDedupPolicy=LAST_WIN."""
    return F.map_concat(m, other)


def dict_of(pairs: Column) -> Column:
    return F.map_from_entries(pairs)


# sets: sorted arrays of distinct values, so that equal sets are equal columns


def set_of(a: Column) -> Column:
    return F.array_sort(F.array_distinct(a))


def union(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def intersection(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def difference(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_except(a, b))


def symmetric_difference(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(F.array_except(a, b), F.array_except(b, a)))


def add(s: Column, v: Column) -> Column:
    return union(s, F.array(v))


def discard(s: Column, v: Column) -> Column:
    return F.array_remove(s, v)


def set_remove(s: Column, v: Column) -> Column:
    return F.when(F.array_contains(s, v), F.array_remove(s, v)).otherwise(F.raise_error(F.lit("KeyError")))


def issubset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def issuperset(a: Column, b: Column) -> Column:
    return issubset(b, a)


def counter(a: Column) -> Column:
    """array<struct<key, count>> in order of first occurrence."""
    return F.transform(F.array_distinct(a), lambda k: F.struct(k.alias("key"), F.size(F.filter(a, lambda x: x.eqNullSafe(k))).alias("count")))


def most_common(a: Column, n: int) -> Column:
    return F.slice(sort(counter(a), key=lambda e: e["count"], reverse=True), 1, n)
