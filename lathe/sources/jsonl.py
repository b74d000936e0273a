"""JSON Lines: numbered lines, entries with open extras, and sorted output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lathe.operators.corpus import IDENTITY, content_key, merge

CORE = IDENTITY
ALIASES = dict(key="id", stdin="stdin_sample")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of text files; lines count from 1 within each file.

    A file is split over executors; blocks of one file are ordered by where they
    start, so the numbers do not depend on how it was split. Lines are counted by
    block and only the counts are summed up, so no task sees a whole file.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__b"))
    # lines of a block are consecutive within one task
    placed = raw.withColumn("__m", F.monotonically_increasing_id())
    blocks = placed.groupBy("file", "__b").agg(F.min("__m").alias("__first"), F.count("*").alias("__n"))
    earlier = F.sum("__n").over(Window.partitionBy("file").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    starts = blocks.select("file", "__b", (F.coalesce(earlier, F.lit(0)) - F.col("__first") + 1).alias("__o"))
    return placed.join(starts, ["file", "__b"]).select("file", (F.col("__m") + F.col("__o")).cast("int").alias("line"), "value")


def _kind(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def parse_entries(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, problems) of lines with a ``value``.

    Blank lines are nothing; a line that is no JSON object, or has no program,
    is a problem. Aliases are folded, wrong types become defaults, unknown keys
    are kept in ``extra``.
    """
    rows = lines.where(F.trim("value") != "").withColumn("__v", F.try_parse_json("value"))
    v = F.col("__v")
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    is_text = lambda key: F.coalesce(_kind(v, f"$.{key}") == "STRING", F.lit(False))
    text = lambda key: F.when(is_text(key), F.try_variant_get(v, f"$.{key}", "string"))
    good = is_object & is_text("program")
    known = [*CORE, *ALIASES]
    extras = F.map_filter(F.from_json("value", "map<string,variant>"), lambda k, _: ~k.isin(*known))
    integer = F.coalesce(_kind(v, "$.count") == "BIGINT", F.lit(False))
    tail = F.try_variant_get(v, "$.argv_tail", "array<string>")
    entries = rows.where(good).select(
        F.coalesce(text("id"), text("key"), content_key(text("program"))).alias("id"),
        text("program").alias("program"),
        F.coalesce(tail, F.array().cast("array<string>")).alias("argv_tail"),
        F.coalesce(text("source"), F.lit("")).alias("source"),
        F.coalesce(text("first_seen"), F.lit("")).alias("first_seen"),
        F.when(integer, F.try_variant_get(v, "$.count", "bigint")).otherwise(1).cast("bigint").alias("count"),
        F.coalesce(text("stdin_sample"), text("stdin")).alias("stdin_sample"),
        F.when(F.size(extras) > 0, F.parse_json(F.to_json(extras))).alias("extra"),
    )
    return entries, rows.where(~good).drop("__v")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entries and problems of a file, folder or glob; nothing at all where there is no file."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(fs_path)
    if found is None or len(found) == 0:
        return parse_entries(spark.createDataFrame([], "file string, line int, value string"))
    return parse_entries(spark.read.text(path))


def load_default(spark: SparkSession, *paths: str) -> DataFrame:
    """All entries of several inputs, merged."""
    return merge(*[load(spark, p)[0] for p in paths])


def serialise(entries: DataFrame) -> DataFrame:
    """(id, value): one compact JSON object per entry, core fields first, extras last, non-ASCII kept."""
    core = F.to_json(F.struct(*[F.col(c) for c in CORE]))
    extra = F.coalesce(F.to_json("extra"), F.lit("{}"))
    return entries.select("id", F.when(extra == "{}", core).otherwise(F.concat(F.left(core, F.length(core) - 1), F.lit(","), F.substring(extra, F.lit(2), F.length(extra)))).alias("value"))


def write(entries: DataFrame, path: str, partitions: int | None = None) -> None:
    """Sorted by id over as many files as asked for, else as Spark finds fit; files are in order by name. Task output appears only on commit."""
    rows = serialise(entries)
    ranged = rows.repartitionByRange(partitions, "id") if partitions else rows.repartitionByRange("id")
    ranged.sortWithinPartitions("id").select("value").write.mode("overwrite").text(path)


def write_by_session(sightings: DataFrame, path: str) -> None:
    """One folder per session; only the sessions present are replaced."""
    spark = sightings.sparkSession
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    rows = sightings.select("session", F.to_json(F.struct(*[c for c in sightings.columns if c != "session"])).alias("value"), "key")
    rows.repartition("session").sortWithinPartitions("session", "key").select("session", "value").write.mode("overwrite").partitionBy("session").text(path)
