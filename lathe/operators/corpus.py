"""Content keys, normalisation, merging and profiling of a corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sorts after every ISO-8601 date: an entry without one never wins by it.
NO_DATE = "9999"
IDENTITY = "id program argv_tail source first_seen count stdin_sample".split()
ENTRY = "id string, program string, argv_tail array<string>, source string, first_seen string, count bigint, stdin_sample string, extra variant"


def normalise(text: Column) -> Column:
    """Line breaks unified, blanks at line ends cut, blank lines at both ends dropped; indentation stays."""
    out = F.when(text.contains("\r"), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)
    # a run of blanks is looked at from its first one only, else long runs take quadratic time
    out = F.regexp_replace(out, "(?<![ \t])[ \t]++(?=\n|\\z)", "")
    out = F.regexp_replace(out, "(?U)\\A\\s*\n", "")
    # up to the end of the last line that is not blank; nothing of a text without one
    return F.regexp_extract(out, "(?sU)\\A.*\\S[^\n]*", 0)


def content_key(text: Column) -> Column:
    return F.concat(F.lit("py-"), F.substring(F.sha2(text, 256), 1, 12))


def fingerprint(text: Column) -> Column:
    """Key of the normalised text: texts that differ in trailing blanks only share it."""
    return content_key(normalise(text))


def line_count(text: Column) -> Column:
    """Lines of a text as ``str.splitlines`` counts them."""
    breaks = F.regexp_count(text, F.lit("\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"))
    open_end = F.when(text == "", 0).when(text.rlike("[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]\\z"), 0).otherwise(1)
    return (breaks + open_end).cast("long")


def is_oneliner(text: Column) -> Column:
    return line_count(text) <= 1


def rank(prefix: str = "") -> Column:
    """Total order of entries with one id: the earliest, then by every field."""
    c = lambda name: F.col(prefix + name)
    dated = F.when(F.coalesce(c("first_seen"), F.lit("")) == "", NO_DATE).otherwise(c("first_seen"))
    return F.struct(
        dated.alias("a"),
        F.coalesce(c("source"), F.lit("")).alias("b"),
        F.coalesce(c("stdin_sample"), F.lit("")).alias("c"),
        F.coalesce(c("argv_tail"), F.array().cast("array<string>")).alias("d"),
        F.coalesce(c("program"), F.lit("")).alias("e"),
    )


def merge(*groups: DataFrame) -> DataFrame:
    """Union by id: equal entries count once, counts add up, the first by ``rank`` gives the other fields.

    Commutative, and idempotent on entries that are equal in everything but extra.
    """
    whole = reduce(DataFrame.unionByName, groups)
    once = whole.groupBy(*IDENTITY).agg(F.min_by("extra", F.coalesce(F.to_json("extra"), F.lit(""))).alias("extra"))
    dates = F.when(F.col("first_seen") != "", F.col("first_seen"))
    winner = F.min_by(F.struct("program", "argv_tail", "source", "stdin_sample", "extra"), rank())
    merged = once.groupBy("id").agg(winner.alias("w"), F.sum("count").alias("count"), F.coalesce(F.min(dates), F.lit("")).alias("first_seen"))
    return merged.select("id", "w.program", "w.argv_tail", "w.source", "first_seen", "count", "w.stdin_sample", "w.extra")


def dedupe_by_key(rows: DataFrame, key: Column, first: str) -> DataFrame:
    """(id, count, first): rows per content key and the smallest ``first`` among them."""
    return rows.groupBy(key.alias("id")).agg(F.count("*").alias("count"), F.min(first).alias(first))


def nth_value(values: Column, q: float) -> Column:
    """The value at place min(int(q * n), n - 1) of a sorted array; null for an empty one."""
    n = F.size(values)
    place = F.least((F.lit(q) * n).cast("int"), n - 1) + 1
    return F.when(n > 0, F.try_element_at(values, place))


def percentiles(rows: DataFrame, value: str, quantiles: dict[str, float], *by: str) -> DataFrame:
    """Percentiles by the int(q * n) rule without gathering a group in one row.

    Values are counted before they are ranked, so that what is sorted is the
    distinct values of a group, not its rows.
    """
    ranked = value_ranks(rows, value, *by)
    place = lambda q: F.least((F.lit(q) * F.col("__n")).cast("long"), F.col("__n") - 1)
    return ranked.groupBy(*by).agg(*[F.min(F.when(F.col("__upto") > place(q), F.col(value))).alias(name) for name, q in quantiles.items()])


def value_ranks(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Distinct values with __upto, how many of the group are at most as large, and __n, how many there are; nulls are left out."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__c"))
    group = Window.partitionBy(*by)
    return counts.withColumns({"__n": F.sum("__c").over(group), "__upto": F.sum("__c").over(group.orderBy(value))})


def top_counts(rows: DataFrame, key: str, k: int) -> DataFrame:
    """The k most frequent values, ties in order of the value."""
    return rows.groupBy(key).agg(F.count("*").alias("count")).orderBy(F.desc("count"), key).limit(k)


def histograms(rows: DataFrame, *columns: str) -> DataFrame:
    """(field, value, count) for several columns in one scan."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns]))
    return rows.select(pairs.alias("p")).groupBy("p.field", "p.value").agg(F.count("*").alias("count"))


def share(value: Column) -> Column:
    """Per cent of the total, 0 of nothing. For results of few rows, as one task sees them all; ``timing.concentration`` is for tables."""
    whole = F.sum(value).over(Window.partitionBy())
    return F.when(whole == 0, 0.0).otherwise(100.0 * value / whole)


def profile(entries: DataFrame) -> DataFrame:
    """One row of totals over a corpus of entries."""
    size = line_count(F.col("program"))
    return entries.agg(
        F.count("*").alias("entries"),
        F.sum("count").alias("occurrences"),
        F.count_if(size <= 1).alias("oneliners"),
        F.count_if(F.size("argv_tail") > 0).alias("with_argv"),
        F.count_if(F.col("stdin_sample").isNotNull()).alias("with_stdin"),
        F.max(F.length("program")).alias("longest"),
    )
