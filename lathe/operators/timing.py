"""Timing roll-ups: best of repeats, shared subsets, totals, baselines and their difference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathe.operators.grading import absolute_paths
from lathe.operators.relational import enumerate_rows

RAN = "ran"
RECORD_SCHEMA = "lathe-timing-1"
#: Entries of one record at most.
RECORD_ENTRIES = 10_000
RECORD = "schema string, total_ms double, entries map<string, struct<ms: double, outcome: string, rc: int>>"


def keep_best(samples: DataFrame) -> DataFrame:
    """The fastest repeat of each (arm, entry_id); its outcome and exit code go with it, ties to the earlier repeat."""
    best = F.min_by(F.struct("ms", "outcome", "rc"), F.struct("ms", "repeat"))
    return samples.groupBy("arm", "entry_id").agg(best.alias("b")).select("arm", "entry_id", "b.*")


def startup(samples: DataFrame) -> DataFrame:
    """Fastest clean run per arm."""
    return samples.where((F.col("outcome") == RAN) & (F.col("rc") == 0)).groupBy("arm").agg(F.min("ms").alias("startup_ms"))


def skip_reason(program: Column, argv_tail: Column) -> Column:
    """Why an entry is not timed; an empty string if it is."""
    nul = program.contains("\0") | F.exists(argv_tail, lambda a: a.contains("\0"))
    everywhere = F.concat(F.array(program), argv_tail)
    paths = F.flatten(F.transform(everywhere, absolute_paths))
    return (
        F.when(nul, "NUL byte in the program or its argv: unspawnable")
        .when(F.size(paths) > 0, F.concat(F.lit("absolute path outside the sandbox: "), F.try_element_at(paths, F.lit(1))))
        .otherwise("")
    )


def shared_subset(best: DataFrame) -> DataFrame:
    """(entry_id) of the entries that every arm ran."""
    arms = best.agg(F.count_distinct("arm").alias("arms"))
    ran = best.where(F.col("outcome") == RAN).groupBy("entry_id").agg(F.count_distinct("arm").alias("n"))
    return ran.crossJoin(F.broadcast(arms)).where("n = arms").select("entry_id")


def corpus_time(samples: DataFrame) -> DataFrame:
    """Per arm: entries by outcome, total time, and count, total and median over the shared subset."""
    best = keep_best(samples)
    shared = shared_subset(best).withColumn("shared", F.lit(True))
    marked = best.join(shared, "entry_id", "left")
    both = F.col("shared").isNotNull()
    ran = F.col("outcome") == RAN
    return marked.groupBy("arm").agg(
        F.count_if(ran).alias("ran"),
        F.count_if(F.col("outcome") == "refused").alias("refused"),
        F.count_if(F.col("outcome") == "error").alias("errors"),
        F.sum(F.when(ran, F.col("ms"))).alias("total_ms"),
        F.count_if(both).alias("shared"),
        F.sum(F.when(both, F.col("ms"))).alias("shared_ms"),
        F.median(F.when(both, F.col("ms"))).alias("shared_median_ms"),
    )


def timing_record(best: DataFrame) -> DataFrame:
    """(arm, part, record): JSON texts with the arm's total and every entry's time, in order of id over the parts.

    A record holds the entries of RECORD_ENTRIES consecutive places, so no row grows with the table;
    an arm that is longer has several, each with the total of the whole arm.
    """
    placed = enumerate_rows(best.select("arm", "entry_id", "ms", "outcome", "rc"), "arm", "entry_id", name="__at")
    # not broadcast by a hint: nothing bounds the number of arms
    totals = placed.groupBy(F.col("arm").alias("__arm")).agg(F.sum("ms").alias("__total"), F.min("__at").alias("__first"))
    part = F.expr(f"(__at - __first) div {RECORD_ENTRIES}")
    rows = placed.join(totals, F.col("arm").eqNullSafe(F.col("__arm"))).withColumn("part", part)
    entries = F.array_sort(F.collect_list(F.struct("entry_id", F.struct("ms", "outcome", "rc").alias("t"))))
    as_map = F.map_from_entries(entries)
    record = F.to_json(F.struct(F.lit(RECORD_SCHEMA).alias("schema"), F.first("__total").alias("total_ms"), as_map.alias("entries")))
    return rows.groupBy("arm", "part").agg(record.alias("record"))


def load_record(records: DataFrame, column: str) -> DataFrame:
    """(entry_id, ms, outcome, rc) of records of this schema; records of another are left out."""
    parsed = records.select(F.from_json(column, RECORD).alias("r")).where(F.col("r.schema") == RECORD_SCHEMA)
    return parsed.select(F.explode("r.entries").alias("entry_id", "t")).select("entry_id", "t.*")


def _status(outcome: Column, rc: Column) -> Column:
    return F.when(outcome == RAN, F.concat(F.lit("exit "), rc.cast("string"))).otherwise(outcome)


def diff(baseline: DataFrame, run: DataFrame) -> DataFrame:
    """(entry_id, before_ms, after_ms, change, flip) over both sides; change is shared, added or dropped."""
    b = baseline.select("entry_id", F.struct("ms", "outcome", "rc").alias("b"))
    a = run.select("entry_id", F.struct("ms", "outcome", "rc").alias("a"))
    before, after = F.col("b"), F.col("a")
    change = F.when(before.isNull(), "added").when(after.isNull(), "dropped").otherwise("shared")
    was, now = (_status(s["outcome"], s["rc"]) for s in (before, after))
    flip = F.when(before.isNotNull() & after.isNotNull() & ~was.eqNullSafe(now), F.concat(was, F.lit(" -> "), now))
    return b.join(a, "entry_id", "full").select("entry_id", before["ms"].alias("before_ms"), after["ms"].alias("after_ms"), change.alias("change"), flip.alias("flip"))


def diff_summary(changes: DataFrame) -> DataFrame:
    both = F.col("change") == "shared"
    counts = [F.count_if(F.col("change") == c).alias(c) for c in ("shared", "added", "dropped")]
    sums = [F.sum(F.when(both, F.col(c))).alias(c) for c in ("before_ms", "after_ms")]
    return changes.agg(*counts, *sums, F.count("flip").alias("flips"))


def movers(changes: DataFrame, top: int = 12) -> DataFrame:
    """Shared entries whose time changed most."""
    delta = F.col("after_ms") - F.col("before_ms")
    return changes.where("change = 'shared'").withColumn("delta_ms", delta).orderBy(F.desc(F.abs("delta_ms")), "entry_id").limit(top)


def ratio(ours: Column, theirs: Column) -> Column:
    return F.when(ours.isNull() | theirs.isNull() | (theirs == 0), "—").otherwise(F.format_string("%.2fx", ours / theirs))


def concentration(gaps: DataFrame, gap: str) -> DataFrame:
    """Rows with the share that each has of the summed gap."""
    # one row, so it may be broadcast
    whole = gaps.agg(F.sum(gap).alias("__whole"))
    share = F.when(F.col("__whole") != 0, F.abs(gap) / F.abs("__whole"))
    return gaps.crossJoin(F.broadcast(whole)).withColumn("share", share).drop("__whole")
