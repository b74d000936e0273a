import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lathe.llm import simhash
from lathe.llm.common import table


def brute_groups(texts):
    """Connected components over all pairs within the radius; -1 for texts without a word."""
    fp, known = simhash.fingerprints(pa.array(texts, pa.string()))
    words = fp.view(np.uint64).reshape(-1, 2)
    root = np.arange(len(texts))
    for i in np.flatnonzero(known):
        near = np.flatnonzero(known & (np.bitwise_count(words ^ words[i]).sum(axis=1) <= simhash.RADIUS))
        least = root[near].min()
        root[np.isin(root, root[near])] = least
    root[~known] = -1
    return root


def search(words, own, low, width, radius):
    return simhash.group_edges(own, low.astype(np.int32), width, words, radius)


@pytest.mark.parametrize("seed", range(4))
def test_group_edges_connect_what_pairs_connect(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, (6, 2), dtype=np.uint64)
    words = base[rng.integers(0, 6, 300)] ^ (np.uint64(1) << rng.integers(0, 64, (300, 2), dtype=np.uint64))
    own = rng.random(300) < 0.7
    low = rng.integers(0, 16, 300)
    radius, width = 3, 4
    want = np.arange(300)
    for a in range(300):
        for b in np.flatnonzero(own):
            value = low[a] ^ low[b]
            meets = value == 0 or own[a] and bin(value).count("1") == 1
            if a != b and meets and np.bitwise_count(words[a] ^ words[b]).sum() <= radius:
                want[want == want[a]] = want[b]
    got = np.arange(300)
    for a, b in search(words, own, low, width, radius):
        assert np.bitwise_count(words[a] ^ words[b]).sum() <= radius
        got[got == got[a]] = got[b]
    same = lambda x: x[:, None] == x[None, :]
    assert (same(got) == same(want)).all()


@pytest.mark.parametrize("bits", [4, 8, 11])
def test_pairs_do_not_depend_on_the_routes(spark, small, monkeypatch, bits):
    docs = table(spark, small, "documents")
    want = sorted(tuple(r) for r in simhash.duplicates(docs).collect())
    monkeypatch.setattr(simhash, "route_bits", lambda n: bits)
    assert sorted(tuple(r) for r in simhash.duplicates(docs).collect()) == want


def test_route_bits():
    assert [simhash.route_bits(n) for n in (0, 1 << 18, 1 << 20, 1 << 27, 1 << 40)] == [4, 4, 6, 13, 14]


def test_duplicates_match_brute_force(spark, small):
    docs = table(spark, small, "documents")
    rows = docs.orderBy("doc_id").select("doc_id", "text").collect()
    root = brute_groups([r.text for r in rows])
    ids = np.array([r.doc_id for r in rows])
    want = {(int(i), int(ids[r])) for i, r in zip(ids, root) if r >= 0 and ids[r] != i}
    got = {(r.doc_id, r.duplicate_of) for r in simhash.duplicates(docs).collect()}
    assert len(got & want) >= 0.9 * len(want)
    assert {i for i, _ in got} <= {i for i, _ in want}


def test_search_recall_on_edited_copies():
    rng = np.random.default_rng(7)
    hits = total = 0
    for distance in range(0, simhash.RADIUS + 1, 3):
        for _ in range(60):
            fp = rng.integers(0, 256, (2, 16), dtype=np.uint8)
            flips = rng.choice(128, distance, replace=False)
            bits = np.unpackbits(fp[0])
            bits[flips] ^= 1
            fp[1] = np.packbits(bits)
            a, b = zip(*[(s[0], s[1]) for s in simhash.segments(fp)])
            found = any(bin(int(x) ^ int(y)).count("1") <= 1 for x, y in zip(a, b))
            assert found or distance > 2 * simhash.SEGMENTS - 1
            hits, total = hits + found, total + 1
    assert hits / total > 0.8  # evenly over distances; real copies are mostly near


def test_components_of_a_long_chain(spark):
    edges = spark.range(60).select(F.lpad(F.col("id").cast("string"), 3, "0").cast("binary").alias("a"), F.lpad((F.col("id") + 1).cast("string"), 3, "0").cast("binary").alias("b"))
    roots = simhash.components(edges).collect()
    assert len(roots) == 61 and {bytes(r.root) for r in roots} == {b"000"}


def test_odd_rows(odd_documents, no_documents):
    pairs = {(r.doc_id, r.duplicate_of): r.hamming for r in simhash.duplicates(odd_documents).collect()}
    assert pairs == {(1, 1): 0, (2, 1): 0, (None, 1): 0}
    kept = simhash.drop_near_copies(odd_documents)
    assert kept.columns == odd_documents.columns
    assert kept.count() == odd_documents.count() - 3
    assert simhash.duplicates(no_documents).count() == 0
    assert simhash.drop_near_copies(no_documents).count() == 0


def test_hamming_column(spark):
    row = spark.createDataFrame([(b"\xff" * 16, b"\x00" * 15 + b"\x0f")], "a binary, b binary").select(simhash._hamming(F.col("a"), F.col("b")).alias("h")).first()
    assert row.h == 124
