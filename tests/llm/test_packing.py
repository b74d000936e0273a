import random

import pytest

from lathe.llm import packing
from lathe.llm.common import table


def naive(lengths, capacity):
    """The same rule with plain lists."""
    rest = sorted(range(len(lengths)), key=lambda k: (-lengths[k], k))
    out = []
    while rest:
        chosen, gap = [], capacity
        for k in list(rest):
            if lengths[k] <= gap:
                chosen.append(k)
                rest.remove(k)
                gap -= lengths[k]
        small = lengths[chosen[-1]]
        best = max(
            ((lengths[a] + lengths[b], max(lengths[a], lengths[b])) for i, a in enumerate(rest) for b in rest[i + 1 :] if small < lengths[a] + lengths[b] <= gap + small),
            default=None,
        )
        if best:
            back = chosen.pop()
            for size in (best[1], best[0] - best[1]):
                k = next(k for k in rest if lengths[k] == size)
                rest.remove(k)
                chosen.append(k)
            at = next((i for i, k in enumerate(rest) if lengths[k] <= small), len(rest))
            rest.insert(at, back)
        out.append(chosen)
    return out


@pytest.mark.parametrize("seed", range(30))
def test_pack_is_the_naive_rule(seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(packing, "NEAR", rng.choice([0, 3, 64]))
    capacity = rng.choice([10, 64, 200])
    lengths = sorted((rng.randint(1, capacity) for _ in range(rng.randint(0, 60))), reverse=True)
    got, want = packing.pack(lengths, capacity), naive(lengths, capacity)
    assert [[lengths[k] for k in x] for x in got] == [[lengths[k] for k in x] for x in want]
    assert sorted(k for x in got for k in x) == list(range(len(lengths)))
    assert all(sum(lengths[k] for k in x) <= capacity for x in got)


def test_two_small_pieces_replace_one():
    # 6 + 3 leaves 1; 3 gives way to 2 + 2, which fill the bin
    assert [sorted([6, 3, 2, 2][k] for k in x) for x in packing.pack([6, 3, 2, 2], 10)] == [[2, 2, 6], [3]]


def test_the_only_piece_of_a_sequence_gives_way_too():
    assert [[[60, 50, 50][k] for k in x] for x in packing.pack([60, 50, 50], 100)] == [[50, 50], [60]]


def spans(rows):
    return sorted((i is None, i or 0, s, n) for r in rows for i, s, n in zip(r.doc_ids, r.starts, r.lengths))


def test_every_byte_is_packed_once(spark, small):
    docs = table(spark, small, "documents")
    rows = packing.packed(docs).collect()
    assert all(r.used == sum(r.lengths) <= packing.CAPACITY for r in rows)
    sizes = {r.doc_id: len(r.text.encode()) for r in docs.collect()}
    ends = dict.fromkeys(sizes, 0)
    for _, i, start, n in spans(rows):
        assert ends[i] == start
        ends[i] += n
    assert ends == sizes


def test_odd_rows(odd_documents, no_documents):
    rows = packing.packed(odd_documents).collect()
    texts = [r[1] for r in odd_documents.collect() if r[1]]
    assert sum(r.used for r in rows) == sum(len(t.encode()) for t in texts)
    assert any(None in r.doc_ids for r in rows)
    assert packing.packed(no_documents).count() == 0
