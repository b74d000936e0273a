"""Capture of command events as a stream: projection, quarantine, and replay-safe publication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.operators.extraction import extract, looks_pythonish
from lathe.operators.harvest import aggregate

MAX_EVENT_BYTES = 4 << 20
_TEXT = lambda *paths: F.coalesce(*[F.get_json_object("value", p) for p in paths])


def records(events: DataFrame) -> DataFrame:
    """Log records of the shell commands that may hold Python, from events as JSON texts (value)."""
    rows = events.where(F.octet_length("value") <= MAX_EVENT_BYTES).select(
        F.lit("bash_command").alias("kind"),
        _TEXT("$.ts").alias("ts"),
        _TEXT("$.session_id", "$.sessionId").alias("session"),
        _TEXT("$.cwd").alias("cwd"),
        _TEXT("$.tool_name", "$.toolName").alias("tool"),
        _TEXT("$.tool_input.command", "$.toolInput.command").alias("command"),
        _TEXT("$.tool_input.description", "$.toolInput.description").alias("description"),
        _TEXT("$.transcript_path", "$.transcriptPath").alias("transcript"),
    )
    return rows.where((F.col("tool") == "Bash") & (F.col("command") != "") & looks_pythonish(F.col("command")))


def quarantine(events: DataFrame) -> DataFrame:
    """Events that are no JSON object or too large."""
    v = F.try_parse_json("value")
    return events.where((F.octet_length("value") > MAX_EVENT_BYTES) | v.isNull() | ~F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)))


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str) -> None:
    """Read what has arrived in ``source`` and append its records to ``target``; returns when caught up.

    A batch owns the folder batch=N of the target and replaces it, so one that
    is run again after a failure leaves nothing twice.
    """

    def publish(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            records(batch).write.mode("overwrite").parquet(f"{target}/records/batch={number}")
            quarantine(batch).write.mode("overwrite").parquet(f"{target}/quarantine/batch={number}")
        finally:
            batch.unpersist()

    stream = spark.readStream.schema("value string").text(source)
    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(publish).start().awaitTermination()


def sightings(spark: SparkSession, target: str) -> DataFrame:
    """Everything captured so far, one row per program."""
    rows = spark.read.parquet(f"{target}/records")
    place = F.concat_ws("#", F.coalesce("session", F.lit("invocations")), F.coalesce("ts", F.lit("")), F.sha2("command", 256))
    found = extract(rows.select("command", "session", "ts", place.alias("place")), "command").select(
        F.concat_ws("#", F.concat(F.lit("hook:"), "place"), F.col("idx").cast("string")).alias("occ_key"),
        "program", "argv_tail", F.lit("hook").alias("source"), "session", F.coalesce("ts", F.lit("")).alias("ts"),
    )
    return aggregate(found)


def running_counts(events: DataFrame, timestamp: str, key: str, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts per time window and key of a stream (or a table); rows later than ``late`` are left out."""
    return events.withColumn(timestamp, F.col(timestamp).cast("timestamp")).withWatermark(timestamp, late).groupBy(F.window(timestamp, window).alias("w"), key).agg(F.count("*").alias("count")).select(F.col("w.start").alias("start"), key, "count")
