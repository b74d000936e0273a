"""Python's collection algebra on tables: positions, joins, sets, counters."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lathe.operators.corpus import value_ranks
from lathe.session import stored

#: Rows of a block in a join by order: a pair of blocks whose ranges overlap is compared row by row.
BLOCK_ROWS = 1000


def enumerate_rows(df: DataFrame, *order: str | Column, start: int = 0, name: str = "pos") -> DataFrame:
    """Rows with their position in a total order.

    Sorted by range over all executors; the offset of each range is a count per
    range, so no single task sees the whole table. The ranges are drawn from a
    sample that another run would draw anew, so the sorted rows are written once
    to the shared folder and both their counts and the result are read from it.
    """
    ordered = df.orderBy(*order).select("*", F.spark_partition_id().alias("__p"))
    local = stored(ordered.withColumn("__k", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "ordered")
    # one row per range: at most as many as there are shuffle partitions
    counts = local.groupBy("__p").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("__p", F.coalesce(before, F.lit(0)).alias("__o"))
    return local.join(F.broadcast(offsets), "__p").withColumn(name, F.col("__o") + F.col("__k") + start).drop("__p", "__k", "__o")


def zip_rows(left: DataFrame, right: DataFrame, by: str = "pos") -> DataFrame:
    """Positional pairing of two enumerated frames; the shorter one ends it."""
    return left.join(right, by)


def nested_loops(left: DataFrame, right: DataFrame, condition: Column | None = None, less: tuple[Column, Column] | None = None) -> DataFrame:
    """``[... for a in left for b in right if condition]``; equalities in the condition become a hash or merge join.

    Where there is none, every pair would be looked at. ``less`` names an expression
    of the left side and one of the right that each pair has in increasing order, and
    the work then follows the rows and the pairs found: rows that nothing on the other
    side matches go, the others are sorted by the expression and cut into blocks of
    BLOCK_ROWS, and only blocks whose ranges allow a pair are joined.
    """
    if less is None:
        return left.join(right, condition)
    a, b = left.withColumn("__a", less[0]), right.withColumn("__b", less[1])
    if (dict(a.dtypes)["__a"] == "string") != (dict(b.dtypes)["__b"] == "string"):
        raise ValueError("less: a text and another type have no common order")
    # one row each, so they may be broadcast
    least, most = a.agg(F.min("__a").alias("__least")), b.agg(F.max("__b").alias("__most"))
    a = _blocks(a.crossJoin(F.broadcast(most)).where("__a < __most").drop("__most"), "__a", "__left")
    b = _blocks(b.crossJoin(F.broadcast(least)).where("__least < __b").drop("__least"), "__b", "__right")
    low, high = a.groupBy("__left").agg(F.min("__a").alias("__low")), b.groupBy("__right").agg(F.max("__b").alias("__high"))
    # rows of bounds only: as many as there are blocks
    meeting = low.join(high, F.col("__low") < F.col("__high")).select("__left", "__right")
    pairs = a.join(meeting, "__left").join(b, "__right").where("__a < __b").drop("__left", "__right", "__a", "__b")
    return pairs if condition is None else pairs.where(condition)


def _blocks(df: DataFrame, value: str, name: str) -> DataFrame:
    """Rows with the number of their block of BLOCK_ROWS in order of the value; equal values are sorted in several tasks."""
    ordered = enumerate_rows(df.withColumn("__tie", F.monotonically_increasing_id()), value, "__tie", name=name)
    return ordered.withColumn(name, F.expr(f"{name} div {BLOCK_ROWS}")).drop("__tie")


def first_by(df: DataFrame, keys: Sequence[str], key: str, position: str, largest: bool = False) -> DataFrame:
    """Row of the smallest (or largest) key per group; ties to the first position, as ``min`` and ``max`` with ``key=`` have it."""
    order = F.struct(F.col(key), -F.col(position)) if largest else F.struct(F.col(key), F.col(position))
    others = [c for c in df.columns if c not in keys]
    pick = (F.max_by if largest else F.min_by)(F.struct(*others), order)
    return df.groupBy(*keys).agg(pick.alias("r")).select(*keys, "r.*")


def sort_rows(df: DataFrame, key: str, position: str, reverse: bool = False) -> DataFrame:
    """Stable sort; reversed, equal keys keep their order."""
    return df.orderBy(F.desc(key) if reverse else F.asc(key), position)


def union_set(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """One pass instead of two subtractions: values that only one side has."""
    sides = a.distinct().withColumn("__s", F.lit(1)).unionByName(b.distinct().withColumn("__s", F.lit(2)))
    return sides.groupBy(*a.columns).agg(F.sum("__s").alias("__s")).where("__s < 3").drop("__s")


def is_subset(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (is_subset)."""
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in a.columns]
    condition = same[0]
    for s in same[1:]:
        condition &= s
    return a.alias("a").join(b.alias("b"), condition, "left_anti").agg((F.count("*") == 0).alias("is_subset"))


def counter(df: DataFrame, key: str, position: str) -> DataFrame:
    """(key, count, first): occurrences and the first position, the order in which a Counter lists keys."""
    return df.groupBy(key).agg(F.count("*").alias("count"), F.min(position).alias("first"))


def most_common(counts: DataFrame, n: int) -> DataFrame:
    return counts.orderBy(F.desc("count"), "first").limit(n)


def subtract_counts(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    x, y = a.select(key, F.col("count").alias("__x")), b.select(key, F.col("count").alias("__y"))
    return x.join(y, key, "full").select(key, (F.coalesce("__x", F.lit(0)) - F.coalesce("__y", F.lit(0))).alias("count"))


def elements(counts: DataFrame, key: str) -> DataFrame:
    return counts.where("count > 0").select(F.explode(F.array_repeat(key, F.col("count").cast("int"))).alias(key))


def merge_dicts(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``left | right``: the right side's values win, no key is lost."""
    others = [c for c in left.columns if c != key]
    joined = left.select(key, F.struct(*others).alias("l")).join(right.select(key, F.struct(*others).alias("r")), key, "full")
    return joined.select(key, *[F.when(F.col("r").isNotNull(), F.col(f"r.{c}")).otherwise(F.col(f"l.{c}")).alias(c) for c in others])


def statistics(df: DataFrame, value: str, *by: str) -> DataFrame:
    """mean, median, variances and deviations per group, as Python's statistics module defines them."""
    moments = df.groupBy(*by).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.var_pop(value).alias("pvariance"),
        F.var_samp(value).alias("variance"),
        F.stddev_pop(value).alias("pstdev"),
        F.stddev_samp(value).alias("stdev"),
    )
    # medians by counted values: no group is held in one place
    low, high = (F.min(F.when(F.col("__upto") > place, F.col(value))) for place in (F.expr("(__n - 1) div 2"), F.expr("__n div 2")))
    medians = value_ranks(df, value, *by).groupBy(*[F.col(b).alias(f"__{b}") for b in by]).agg(((low.cast("double") + high.cast("double")) / 2).alias("median"), low.alias("median_low"))
    same = reduce(and_, [F.col(b).eqNullSafe(F.col(f"__{b}")) for b in by], F.lit(True))
    return moments.join(medians, same, "left").select(*by, "n", "mean", "median", "median_low", "pvariance", "variance", "pstdev", "stdev")


def median_high(df: DataFrame, value: str, *by: str) -> DataFrame:
    return value_ranks(df, value, *by).groupBy(*by).agg(F.min(F.when(F.expr("__upto > __n div 2"), F.col(value))).alias("median_high"))


def mode(df: DataFrame, value: str, position: str, *by: str) -> DataFrame:
    """The most frequent value, ties to the one met first."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("n"), F.min(position).alias("first"))
    return counts.groupBy(*by).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias("mode"))


def total(counts: DataFrame) -> DataFrame:
    """One row (total): the sum of all counts."""
    return counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total"))
