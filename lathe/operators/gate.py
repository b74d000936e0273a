"""Size and start-up gates over measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 131072
MAX_BYTES, MAX_OPENS, MAX_SHARED_OBJECTS = 700_000, 3, 0
_OPENED = r'^(?:open|openat)\([^"]*"([^"]*)"'
_FAILED = r"= -1 E[A-Z]+"
_STAT = r"^(?:stat|lstat|fstat|newfstatat|statx|access|faccessat2?|readlink)\("


def device_blocks(size: Column) -> Column:
    return F.ceil(size / BLOCK)


def check(value: Column, limit: int) -> Column:
    """passed, failed, or unmeasured where there is no value; unmeasured is not a failure."""
    return F.when(value.isNull(), "unmeasured").when(value <= limit, "passed").otherwise("failed")


def gate(measured: DataFrame) -> DataFrame:
    """Rows (bytes, opens, shared_objects, ...) with a state per check, the blocks, and ``ok``."""
    limits = {"bytes": MAX_BYTES, "opens": MAX_OPENS, "shared_objects": MAX_SHARED_OBJECTS}
    states = {f"{c}_check": check(F.col(c), most) for c, most in limits.items()}
    out = measured.withColumns(states | {"blocks": device_blocks(F.col("bytes"))})
    failed = [F.col(c) == "failed" for c in states]
    return out.withColumn("ok", ~(failed[0] | failed[1] | failed[2]))


def parse_trace(log: DataFrame, line: str = "value") -> DataFrame:
    """Distinct files opened, failed opens and stat-like calls of a system call trace."""
    text = F.col(line)
    opened, failed = text.rlike(_OPENED), text.rlike(_FAILED)
    return log.agg(
        F.count_distinct(F.when(opened & ~failed, F.regexp_extract(text, _OPENED, 1))).alias("opens"),
        F.count_if(opened & failed).alias("failed_opens"),
        F.count_if(text.rlike(_STAT)).alias("stat_calls"),
    )


def project_cold_ms(size: Column, opens: Column, base_size: Column, base_opens: Column, base_ms: Column) -> Column:
    """The base's cold time scaled by the larger of the shares of blocks and of opens, rounded half to even; null if unmeasured."""
    share = lambda x, base: F.when(base == 0, 0.0).otherwise(x / base)
    return F.bround(base_ms * F.greatest(share(device_blocks(size), device_blocks(base_size)), share(opens, base_opens))).cast("long")


def compare(ours: DataFrame, baseline: DataFrame) -> DataFrame:
    return ours.withColumn("side", F.lit("ours")).unionByName(baseline.withColumn("side", F.lit("baseline")), allowMissingColumns=True)
