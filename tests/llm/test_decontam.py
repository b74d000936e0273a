import random

import numpy as np
import pytest

from lathe.llm import decontam
from lathe.llm.common import table
from lathe.llm.kernels import Words


def smith_waterman(a, b):
    best = 0
    row = [0] * (len(a) + 1)
    for y in b:
        new = [0]
        for k, x in enumerate(a):
            new.append(max(0, row[k] + (decontam.MATCH if x == y else decontam.MISMATCH), row[k + 1] + decontam.GAP, new[k] + decontam.GAP))
        row = new
        best = max(best, *row)
    return best


@pytest.mark.parametrize("seed", range(20))
def test_alignment_is_smith_waterman(seed):
    rng = random.Random(seed)
    pairs = [([rng.randint(1, 6) for _ in range(rng.randint(1, 15))], [rng.randint(1, 6) for _ in range(rng.randint(0, 30))]) for _ in range(20)]
    best, _ = decontam.align([np.array(a, np.uint64) for a, _ in pairs], [np.array(b, np.uint64) for _, b in pairs])
    assert best.tolist() == [smith_waterman(a, b) if b else 0 for a, b in pairs]


def words(text):
    import pyarrow as pa

    return Words(pa.array([text])).hash.tolist()


def test_matches_brute_force(spark, tiny):
    docs, bench = table(spark, tiny, "documents"), table(spark, tiny, "benchmark")
    items = [(r.item_id, words(r.text)) for r in bench.collect()]
    want = set()
    for r in docs.collect():
        text = words(r.text)
        for i, item in items:
            # any alignment of half the item shares words with it; skip what cannot
            if len(set(item) & set(text)) * 2 >= len(set(item)) and smith_waterman(item, text) >= decontam.THRESHOLD * decontam.MATCH * len(item):
                want.add((r.doc_id, i))
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()}
    assert want and len(got & want) >= 0.9 * len(want) and not got - want


def test_edited_copies(spark, small):
    rng = random.Random(3)
    bench = table(spark, small, "benchmark")
    items = [(r.item_id, r.text.split()) for r in bench.collect()]
    filler = [f"word{k}" for k in range(500)]
    rows, kinds = [], {}
    for n, (i, text) in enumerate(items):
        edited = list(text)
        for k in rng.sample(range(len(text)), len(text) // 6):
            edited[k] = rng.choice(filler)
        del edited[len(edited) // 2]
        rows.append((n, " ".join(rng.choices(filler, k=100) + edited + rng.choices(filler, k=100))))
        kinds[n] = i
    rows.append((10_000, " ".join(rng.choices(filler, k=300))))
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert len({d for d, i in got if kinds.get(d) == i}) >= 0.9 * len(items)
    assert 10_000 not in {d for d, _ in got}


def test_blocks_of_a_large_benchmark(spark, tiny, monkeypatch):
    docs, bench = table(spark, tiny, "documents"), table(spark, tiny, "benchmark")
    whole = sorted(map(tuple, decontam.contaminated(docs, bench).collect()))
    monkeypatch.setattr(decontam, "MAX_SEEDS", 500)
    assert sorted(map(tuple, decontam.contaminated(docs, bench).collect())) == whole


def test_odd_rows(spark, odd_documents, no_documents):
    bench = spark.createDataFrame(
        [(1, "quick brown foxes jumped over seventeen lazy dogs", 0), (1, "quick brown foxes jumped over seventeen lazy dogs", 0), (2, None, 0), (None, "lost item of words", 0), (3, "", 0), (4, "two words", 0)],
        "item_id long, text string, TEXT int",
    )
    got = decontam.contaminated(odd_documents, bench).collect()
    assert sorted(((r.doc_id, r.item_id, r.score) for r in got), key=str) == [(1, 1, 1.0), (2, 1, 1.0), (None, 1, 1.0)]
    kept = decontam.drop_contaminated(odd_documents, bench)
    assert kept.columns == odd_documents.columns and kept.count() == odd_documents.count() - 4
    assert decontam.contaminated(no_documents, bench).count() == 0
    assert decontam.contaminated(odd_documents, bench.where("false")).count() == 0
    assert decontam.drop_contaminated(odd_documents, bench.where("false")).count() == odd_documents.count()


def test_group_of_edited_copies_beside_one_exact_copy(spark):
    item = [f"term{k}" for k in range(30)]
    edited = [f"other{k}" if k % 5 == 4 else w for k, w in enumerate(item)]
    rows = [(0, " ".join(item))]
    copies = decontam.RARE_DOCUMENTS + 50
    rows += [(n, " ".join([f"before{n}x{k}" for k in range(50)] + edited + [f"after{n}x{k}" for k in range(50)])) for n in range(1, copies)]
    # a run of the item alone is no copy
    rows += [(n, f"lead{n} term0 term1 term2 and nothing else of it") for n in range(copies, copies + 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    assert {r.doc_id for r in decontam.contaminated(docs, bench).collect()} == set(range(copies))


def test_places_in_parts(spark, tiny, monkeypatch):
    docs, bench = table(spark, tiny, "documents"), table(spark, tiny, "benchmark")
    whole = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()}
    monkeypatch.setattr(decontam, "PLACES", 5)
    items = [(r.item_id, r.text) for r in bench.collect()]
    aligner = decontam._aligner(items, decontam.with_rarity(decontam.item_grams(items), {}))
    import pyarrow as pa

    rows = docs.collect()
    batch = pa.record_batch([pa.array([r.doc_id for r in rows]), pa.array([0] * len(rows)), pa.array([r.text for r in rows])], names=["id", "tk", "text"])
    assert {(a, b) for out in aligner(iter([batch])) for a, b in zip(out["id"].to_pylist(), out["item_id"].to_pylist())} == whole


def test_common_runs_need_a_second_one():
    """Chains of hits within a slack: a rare hit, or two runs of the item, or nothing."""
    slack = np.array([8, 8])
    hits = [  # row, item, begin, at, rare
        (0, 0, 5, 1, False), (0, 0, 9, 1, False),  # one run twice
        (0, 0, 40, 1, False), (0, 0, 44, 2, False),  # two runs
        (0, 1, 44, 3, False),  # of another item
        (1, 1, 44, 3, True), (1, 1, 50, 3, False),  # beside a rare one
        (1, 1, 90, 4, False),
    ]
    got = decontam._supported(*(np.array(x) for x in zip(*hits)), slack)
    assert got.tolist() == [False, False, True, True, False, True, True, False]


def test_rarity_is_a_share_of_the_documents():
    grams = decontam.item_grams([(1, "a b c d"), (2, "b c d e")])
    h = grams["h"].to_numpy(np.uint64).view(np.int64).tolist()
    few = decontam.with_rarity(grams, {None: 1000, h[0]: 100, h[1]: 101})
    many = decontam.with_rarity(grams, {None: 10**6, h[0]: 1000, h[1]: 1001})
    assert few["rare"].tolist() == many["rare"].tolist() == [True, False, False, True]


def test_of_equal_alignments_the_first_counts(spark):
    item = " ".join(f"word{k}" for k in range(12))
    docs = spark.createDataFrame([(1, f"x y z {item} " + "fill " * 60 + item)], "doc_id long, text string")
    assert [tuple(r) for r in decontam.contaminated(docs, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()] == [(1, 5, 1.0, 15)]
