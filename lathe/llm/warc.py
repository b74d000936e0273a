"""WARC fixity audit with Merkle trees.

Every record of an archive file is hashed; ranges of offsets are hashed over
their records, and ranges of ranges over those, up to one root. Two replicas
are compared root by root; only below roots that differ are the next ranges
compared, down to the records that are corrupt, missing or superfluous.

Shape at scale: pages are hashed where they are read, and only digests are
shuffled (a hundred bytes a record); each level of the tree has a 64th of
the one below. An intact file costs one comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lathe.llm.common import pick, sortable_id, stored

RECORDS_PER_FILE = 4096
#: log2 of the bytes in a leaf range, and of the ranges in a range above.
RANGE_BITS, FANOUT_BITS = 18, 6
#: Levels of ranges; the top ones span 2**30 bytes. A larger file has several.
LEVELS = 3
#: Of page ids, one in DAMAGE each is flipped, cut or lost in the simulated replica.
DAMAGE = 211


def record(page_id: Column, url: Column, html: Column) -> Column:
    """The WARC record of a page, as text; nulls are empty."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
        body,
        F.lit("\r\n\r\n"),
    )


def _damaged(page_id: Column, html: Column) -> Column:
    kind = F.coalesce(F.pmod(page_id, F.lit(DAMAGE)), F.lit(-1))
    return (
        F.when(kind == 0, F.concat(F.lit("X"), F.substring(html, 2, 1 << 30)))
        .when(kind == 1, F.expr("substring(html, 1, cast(length(html) div 2 as int))"))
        .otherwise(html)
    )


def archive(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records (file, offset, page_id, digest) of an archive of these pages, and of a replica with simulated damage.

    Files hold RECORDS_PER_FILE consecutive page ids, in order of id; null ids
    are in file -1. Offsets are the original's in both, as its index has them.
    """
    rows = pick(pages, "page_id", "url", "html").withColumn("page_id", F.col("page_id").cast("long"))
    one = record(F.col("page_id"), F.col("url"), F.col("html"))
    two = record(F.col("page_id"), F.col("url"), _damaged(F.col("page_id"), F.col("html")))
    hashed = rows.select(
        "page_id",
        F.coalesce(F.floor(F.col("page_id") / RECORDS_PER_FILE), F.lit(-1)).cast("long").alias("file"),
        F.octet_length(one).cast("long").alias("bytes"),
        F.sha2(one, 256).alias("digest"),
        F.sha2(two, 256).alias("other"),
    )
    before = Window.partitionBy("file").orderBy(sortable_id(F.col("page_id")), "digest").rowsBetween(Window.unboundedPreceding, -1)
    laid = stored(hashed.withColumn("offset", F.coalesce(F.sum("bytes").over(before), F.lit(0))), "records")
    lost = F.coalesce(F.pmod("page_id", F.lit(DAMAGE)) == 2, F.lit(False))
    return laid.select("file", "offset", "page_id", "digest"), laid.where(~lost).select("file", "offset", "page_id", F.col("other").alias("digest"))


def tree(records: DataFrame) -> list[DataFrame]:
    """Levels of (file, range, digest), from leaf ranges to roots."""
    levels, below, at = [], records, F.shiftright("offset", RANGE_BITS)
    name = "offset"
    for _ in range(LEVELS):
        children = F.array_sort(F.collect_list(F.struct(F.col(name).alias("at"), "digest")))
        text = F.array_join(F.transform(children, lambda c: F.concat_ws(":", c["at"].cast("string"), c["digest"])), "\n")
        below = below.groupBy("file", at.alias("range")).agg(F.sha2(text, 256).alias("digest"))
        if name == "offset":
            below = stored(below, "ranges")  # read again by every level above and by the descent
        levels.append(below)
        name, at = "range", F.shiftright("range", FANOUT_BITS)
    return levels


def _differ(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    left, right = a.withColumnRenamed("digest", "mine"), b.withColumnRenamed("digest", "theirs")
    return left.join(right, keys, "full").where("not (mine <=> theirs)")


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """(file, offset, page_id, status) of each record that differs: corrupt, missing or extra in the replica.

    Both frames are (file, offset, page_id, digest). Order of rows and null page
    ids do not matter; repeated rows make a range differ and are reported as
    corrupt or extra only where the digests at one offset differ. Two equal or
    empty archives give no rows; against an empty replica all is missing.
    """
    mine, theirs = tree(primary), tree(replica)
    def differing(*levels: DataFrame) -> DataFrame:
        # small, and read on both sides of the level below
        return stored(_differ(*levels, ["file", "range"]).select("file", F.col("range").alias("parent")), "differing")

    bad = differing(mine[-1], theirs[-1])
    for k in range(LEVELS - 2, -1, -1):
        sides = [level[k].withColumn("parent", F.shiftright("range", FANOUT_BITS)).join(bad, ["file", "parent"], "left_semi").drop("parent") for level in (mine, theirs)]
        bad = differing(*sides)
    found = [
        side.withColumn("parent", F.shiftright("offset", RANGE_BITS)).join(bad, ["file", "parent"], "left_semi").drop("parent")
        for side in (primary, replica.withColumnRenamed("page_id", "their_id"))
    ]
    status = F.when(F.col("theirs").isNull(), "missing").when(F.col("mine").isNull(), "extra").otherwise("corrupt")
    return _differ(*found, ["file", "offset"]).select("file", "offset", F.coalesce("page_id", "their_id").alias("page_id"), status.alias("status"))


def audited(pages: DataFrame) -> DataFrame:
    """The audit of an archive of all pages against a replica with simulated damage.

    Null url and html are archived as empty; null page ids share file -1 and are
    never damaged; empty and very long pages are records like others; repeated
    rows are repeated records. Extra columns are ignored. An empty table gives
    no rows.
    """
    return audit(*archive(pages))


SQL = f"""
WITH r AS (
  SELECT page_id, coalesce(page_id // {RECORDS_PER_FILE}, -1) AS file, url, coalesce(html, '') AS html,
         CASE page_id % {DAMAGE} WHEN 0 THEN 'X' || substring(html, 2) WHEN 1 THEN substring(html, 1, CAST(length(html) // 2 AS INT)) ELSE coalesce(html, '') END AS other
  FROM pages
), b AS (
  SELECT page_id, file, html, other,
         'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
         || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: '
         || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM r
), o AS (
  SELECT *, coalesce(sum(strlen(record)) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM b
)
SELECT CAST(file AS BIGINT) AS file, CAST(place AS BIGINT) AS "offset", page_id, CASE WHEN page_id % {DAMAGE} = 2 THEN 'missing' ELSE 'corrupt' END AS status
FROM o WHERE page_id % {DAMAGE} = 2 OR html <> other
"""
