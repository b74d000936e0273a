import pytest
from pyspark.sql import functions as F

from lathe.llm import sharding
from lathe.llm.common import table


@pytest.mark.parametrize("shard_bytes", [1 << 17, 1 << 19, 1 << 30])
def test_shards_are_sorted_and_even(spark, small, shard_bytes):
    docs = table(spark, small, "documents")
    rows = sharding.shards(docs, shard_bytes).select("*", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("at")).collect()
    assert sorted(tuple(r)[:5] for r in rows) == sorted(tuple(r) for r in docs.collect())
    assert all(r.shard == r.p for r in rows)
    rows.sort(key=lambda r: (r.shard, r["at"]))
    keys = [(r.source, r.doc_id) for r in rows]
    assert keys == sorted(keys)
    whole = sum(len(r.text.encode()) for r in rows)
    n = max(1, -(-whole // shard_bytes))
    assert max(r.shard for r in rows) == n - 1
    largest = max(len(r.text.encode()) for r in rows)
    below = 0
    for k in range(n - 1):
        below += sum(len(r.text.encode()) for r in rows if r.shard == k)
        assert abs(below - whole * (k + 1) / n) <= max(sharding.TOLERANCE * whole / n, largest)


def test_splitters_match_sorted_positions(spark):
    rows = [(f"{k * 7919 % 1000:04d}".encode().ljust(24, b"\0"), k % 13 + 1) for k in range(1000)]
    found = sharding.splitters(spark.createDataFrame(rows, "key binary, bytes long"), 500)
    whole = sum(b for _, b in rows)
    n = -(-whole // 500)
    assert len(found) == n - 1
    for k, s in enumerate(found):
        below = sum(b for key, b in rows if key < s)
        assert abs(below - whole * (k + 1) / n) <= max(sharding.TOLERANCE * whole / n, 13)


def test_one_heavy_key_and_ties(spark):
    rows = [(b"a" * 24, 10_000)] + [(b"b" * 24, 10)] * 50 + [(bytes([99, k]) + b"c" * 22, 1) for k in range(50)]
    found = sharding.splitters(spark.createDataFrame(rows, "key binary, bytes long"), 1000)
    assert 1 <= len(found) <= 3
    assert sharding.splitters(spark.createDataFrame([], "key binary, bytes long"), 10) == []


def test_odd_rows(odd_documents, no_documents):
    got = sharding.shards(odd_documents, 100_000)
    rows = got.collect()
    assert len(rows) == odd_documents.count()
    assert got.columns.count("shard") == 1 and "TEXT" in got.columns
    order = [(r[3] or "", r[0] if r[0] is not None else 1 << 62) for r in sorted(rows, key=lambda r: r.shard)]
    assert order == sorted(order)
    assert sharding.shards(no_documents).count() == 0


def test_sources_with_a_long_common_start(spark):
    sources = ["https://www.example.org/a", "https://www.example.org/b", "https://www.example.org/b\0", "https://www.example.org/b\0c", "https://www.example.org/b\x01", "", None]
    rows = [(k * 7919 % 1000 - 500, "x" * 100, "en", sources[k % 7], 100) for k in range(700)]
    got = sharding.shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), 7_000)
    placed = got.select("*", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("at")).collect()
    placed.sort(key=lambda r: (r.shard, r["at"]))
    order = [((r.source or "").encode(), r.doc_id) for r in placed]
    assert order == sorted(order) and {r.shard for r in placed} == set(range(10)) and all(r.shard == r.p for r in placed)


def test_null_and_empty_sources_are_one(spark):
    """Shards in order are one list sorted by (source or '', doc_id), with nulls beside empty sources."""
    rows = [(k * 7919 % 500, "y" * 50, (None, "", "a")[k % 3]) for k in range(500)]
    got = sharding.shards(spark.createDataFrame(rows, "doc_id long, text string, source string"), 2_500)
    placed = got.select("*", F.monotonically_increasing_id().alias("at")).collect()
    placed.sort(key=lambda r: (r.shard, r["at"]))
    assert [(r.source or "", r.doc_id) for r in placed] == sorted((s or "", i) for i, _, s in rows)
    assert {r.shard for r in placed} == set(range(10))


def test_bounds_on_shards_and_probes(spark, monkeypatch):
    """With fewer probes it takes more rounds; a table too large for MAX_SHARDS gets that many equal shards."""
    rows = [(f"{k * 7919 % 1000:04d}".encode(), k % 13 + 1) for k in range(1000)]
    keys = spark.createDataFrame(rows, "key binary, bytes long").cache()
    whole = sum(b for _, b in rows)
    monkeypatch.setattr(sharding, "MAX_PROBES", 4)
    monkeypatch.setattr(sharding, "MAX_SHARDS", 6)
    found = sharding.splitters(keys, 100)
    assert len(found) == 5
    for k, s in enumerate(found):
        assert abs(sum(b for key, b in rows if key < s) - whole * (k + 1) / 6) <= max(sharding.TOLERANCE * whole / 6, 13)
