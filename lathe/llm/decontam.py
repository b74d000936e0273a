"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

The runs of three words of the test items are counted over all documents. A run
that few documents hold is rare, and a seed on its own; a common one is a seed
only together with another run of its item that stands about as far from it as
in the item. So a common phrase by itself costs no alignment, and copies of an
item, which make its runs common, are still met: they hold several of them.
Where a document holds a seed, and the words around it hold enough of the item's
words for a match at all, they are aligned with the whole item. The score is the
alignment's share of a full match, so edited and paraphrased copies score in
proportion to what survived.

Shape at scale: two scans of the documents and no shuffle of texts. What each
task needs of the benchmark travels with the task only up to MAX_SEEDS runs of
words, and so many counts come back; a larger benchmark is worked off in blocks
of that size, two scans each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.llm.common import numbered, pick, position, sortable_id, stored, text_key
from lathe.llm.kernels import Words, text_slices

#: Words in a seed. Items with fewer words are no evidence and match nothing.
GRAM = 3
#: A run is rare if at most this share of the documents hold it, or so few of them.
RARE_SHARE, RARE_DOCUMENTS = 0.001, 100
#: Runs of words that travel with a task at once (16 bytes each).
MAX_SEEDS = 1 << 20
#: Share of a full match from which a document counts as contaminated.
THRESHOLD = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: Alignments that are computed at once.
ALIGN_BLOCK = 512
#: Places of seeds that are held against the items at once.
PLACES = 1 << 18

_TABLE_BITS = 22


class Index:
    """A sorted set of hashes with a bitmap in front of it."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = np.unique(hashes)
        self.bitmap = np.zeros(1 << _TABLE_BITS, bool)
        self.bitmap[(self.hashes >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in h, places in hashes) of the members of h."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        maybe = np.flatnonzero(self.bitmap[(h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
        at = np.searchsorted(self.hashes, h[maybe])
        at[at == len(self.hashes)] = 0
        ok = self.hashes[at] == h[maybe]
        return maybe[ok], at[ok]


def item_grams(items: list[tuple[int, str]]) -> pd.DataFrame:
    """(item, h, at) for each distinct run of GRAM words of each item; item is its place in the list."""
    words = Words(pa.array([t for _, t in items], pa.string()))
    at, h = words.grams(GRAM)
    row = words.row[at]
    frame = pd.DataFrame({"item": row, "h": h, "at": at - words.first[row]})
    return frame


def blocks(items: list[tuple[int, str]]) -> Iterator[list[tuple[int, str]]]:
    """The items in runs that have at most MAX_SEEDS words, or one item."""
    block, size = [], 0
    for item in items:
        n = len(item[1]) // 2 + 1
        if block and size + n > MAX_SEEDS:
            yield block
            block, size = [], 0
        block.append(item)
        size += n
    if block:
        yield block


def _counter(hashes: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(h, documents) of the runs that occur, and the number of all documents under a null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(hashes)
        seen, rows = np.zeros(len(index.hashes), np.int64), 0
        for batch in batches:
            rows += len(batch)
            for start, stop in text_slices(batch.column("text")):
                words = Words(batch.column("text").slice(start, stop - start))
                at, h = words.grams(GRAM)
                place, which = index.find(h)
                pair = np.unique(words.row[at[place]] * len(index.hashes) + which)
                seen += np.bincount(pair % max(1, len(index.hashes)), minlength=len(index.hashes))
        some = np.flatnonzero(seen)
        found = pa.concat_arrays([pa.array(index.hashes[some].view(np.int64)), pa.nulls(1, pa.int64())])
        yield pa.record_batch([found, pa.array(np.append(seen[some], rows))], names=["h", "documents"])

    return run


def with_rarity(grams: pd.DataFrame, counts: dict[int | None, int]) -> pd.DataFrame:
    """The runs of the items with ``rare``; counts holds documents by run, and all documents under None."""
    most = max(RARE_DOCUMENTS, RARE_SHARE * counts.get(None, 0))
    return grams.assign(rare=[counts.get(h, 0) <= most for h in grams["h"].to_numpy(np.uint64).view(np.int64).tolist()])


def _padded(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Arrays of words as rows of one table, and where it is filled."""
    out = np.zeros((len(parts), max(map(len, parts))), np.uint64)
    used = np.zeros(out.shape, bool)
    for k, x in enumerate(parts):
        out[k, : len(x)], used[k, : len(x)] = x, True
    return out, used


def present(items: list[np.ndarray], passages: list[np.ndarray]) -> np.ndarray:
    """How many words of each item its passage holds somewhere; no alignment matches more."""
    a, used_a = _padded(items)
    b, used_b = _padded(passages)
    found = np.zeros(a.shape, bool)
    for j in range(b.shape[1]):
        found |= (a == b[:, j : j + 1]) & used_b[:, j : j + 1]
    return (found & used_a).sum(axis=1)


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment of each item with its passage: score and the passage's word after it."""
    a, used_a = _padded(items)
    b, used_b = _padded(passages)
    (n, m), k = a.shape, b.shape[1]
    ramp = (np.arange(m + 1, dtype=np.int32) * -GAP)[None, :]
    row = np.zeros((n, m + 1), np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    for j in range(k):
        same = (a == b[:, j : j + 1]) & used_a & used_b[:, j : j + 1]
        new = np.zeros_like(row)
        new[:, 1:] = np.maximum(row[:, :-1] + np.where(same, MATCH, MISMATCH), row[:, 1:] + GAP)
        np.maximum(new, 0, out=new)
        # gaps along the item: a running maximum in coordinates where a gap is free
        row = np.maximum.accumulate(new + ramp, axis=1) - ramp
        top = row.max(axis=1)
        better = top > best
        best[better], end[better] = top[better], j + 1
    return best, end


def _aligner(items: list[tuple[int, str]], seeds: pd.DataFrame) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    ids = np.array([i for i, _ in items], np.int64)
    texts = [t for _, t in items]
    seed_h = seeds["h"].to_numpy(np.uint64)
    seed_item = seeds["item"].to_numpy(np.int64)
    seed_at = seeds["at"].to_numpy(np.int64)
    seed_rare = seeds["rare"].to_numpy(bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(seed_h)
        order = np.argsort(seed_h, kind="stable")
        lo = np.searchsorted(seed_h[order], index.hashes, side="left")
        hi = np.searchsorted(seed_h[order], index.hashes, side="right")
        own = Words(pa.array(texts, pa.string()))
        length = np.diff(own.first)
        slack = np.maximum(8, length // 2)

        def pairs(words: Words, item: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
            return [own.hash[own.first[i] : own.first[i + 1]] for i in item], [words.hash[b:e] for b, e in zip(begin, end)]

        for batch in batches:
            for start, stop in text_slices(batch.column("text")):
                words = Words(batch.column("text").slice(start, stop - start))
                at, h = words.grams(GRAM)
                places, whiches = index.find(h)
                running = np.cumsum(hi[whiches] - lo[whiches])
                cuts = np.unique(np.searchsorted(running, np.arange(PLACES, running[-1] + 1, PLACES), side="right")) if len(places) else []
                # a text's places stay together
                owner = words.row[at[places]]
                cuts = np.unique(np.searchsorted(owner, owner[cuts[cuts < len(owner)]])) if len(places) else []
                for place, which in zip(np.split(places, cuts), np.split(whiches, cuts)):
                    if not len(place):
                        continue
                    count = hi[which] - lo[which]
                    inside = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                    seed = order[np.repeat(lo[which], count) + inside]
                    word = at[np.repeat(place, count)]
                    item = seed_item[seed]
                    row = words.row[word]
                    begin = word - seed_at[seed] - slack[item]
                    by = np.lexsort((begin, item, row))
                    row, item, begin = row[by], item[by], begin[by]
                    keep = _supported(row, item, begin, seed_at[seed][by], seed_rare[seed][by], slack)
                    row, item, begin = row[keep], item[keep], begin[keep]
                    keep = _spread(row, item, begin, slack)
                    row, item, begin = row[keep], item[keep], begin[keep]
                    end = np.minimum(begin + length[item] + 2 * slack[item], words.first[row + 1])
                    begin = np.maximum(begin, words.first[row])
                    score, until = np.zeros(len(row)), np.zeros(len(row), np.int64)
                    similar = np.argsort(length[item], kind="stable")
                    able = np.zeros(len(row), bool)
                    for s in range(0, len(row), ALIGN_BLOCK):
                        part = similar[s : s + ALIGN_BLOCK]
                        able[part] = present(*pairs(words, item[part], begin[part], end[part])) >= THRESHOLD * length[item[part]]
                    similar = similar[able[similar]]
                    for s in range(0, len(similar), ALIGN_BLOCK):
                        part = similar[s : s + ALIGN_BLOCK]
                        best, stop_at = align(*pairs(words, item[part], begin[part], end[part]))
                        score[part] = best / (MATCH * length[item[part]])
                        until[part] = begin[part] + stop_at - words.first[row[part]]
                    hit = score >= THRESHOLD
                    take = pa.array(row[hit] + start)
                    yield pa.record_batch(
                        [batch.column("id").take(take), batch.column("tk").take(take), pa.array(ids[item[hit]]), pa.array(score[hit]), pa.array(until[hit])],
                        names=["id", "tk", "item_id", "score", "end_word"],
                    )

    return run


def _supported(row: np.ndarray, item: np.ndarray, begin: np.ndarray, at: np.ndarray, rare: np.ndarray, slack: np.ndarray) -> np.ndarray:
    """Of the sorted hits those that are rare or near another one: whose neighbours, each within a slack of the next, hold a rare or a second run."""
    if not len(row):
        return np.zeros(0, bool)
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (begin[1:] - begin[:-1] > slack[item[1:]])
    first = np.flatnonzero(new)
    ok = np.logical_or.reduceat(rare, first) | (np.maximum.reduceat(at, first) > np.minimum.reduceat(at, first))
    return ok[np.cumsum(new) - 1]


def _spread(row: np.ndarray, item: np.ndarray, begin: np.ndarray, slack: np.ndarray) -> np.ndarray:
    """Of the sorted windows of one document and item, those that start half a slack after the last one kept."""
    keep = np.ones(len(row), bool)
    last = 0
    for k in np.flatnonzero((row[1:] == row[:-1]) & (item[1:] == item[:-1])) + 1:
        if keep[k - 1]:
            last = k - 1
        keep[k] = begin[k] - begin[last] > slack[item[k]] // 2
    return keep


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(id, tk, item_id, score, end_word) of every contaminated document and the item it holds."""
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("id"), text_key(F.col("text")).alias("tk"), "text")
    items = pick(benchmark, "item_id", "text").where("item_id is not null and text is not null").distinct().orderBy("item_id", "text")
    found = []
    for block in blocks([(r.item_id, r.text) for r in items.toLocalIterator()]):
        grams = item_grams(block)
        counted = rows.select("text").mapInArrow(_counter(grams["h"].to_numpy(np.uint64)), "h long, documents long").groupBy("h").agg(F.sum("documents").alias("n"))
        seeds = with_rarity(grams, {r.h: r.n for r in counted.collect()})
        found.append(rows.mapInArrow(_aligner(block, seeds), "id long, tk long, item_id long, score double, end_word long"))
    empty = rows.sparkSession.createDataFrame([], "id long, tk long, item_id long, score double, end_word long")
    best = reduce(DataFrame.unionByName, found, empty).groupBy("id", "tk", "item_id")
    return best.agg(F.max("score").alias("score"), F.max_by("end_word", F.struct("score", -F.col("end_word"))).alias("end_word"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, end_word): documents that hold a test item, edited or not.

    ``score`` is the best alignment's share of a full match, at least THRESHOLD;
    ``end_word`` is the number of the document's words up to its end.

    Null and empty texts hold nothing. A null doc_id stays null; repeated rows
    are reported once; documents of one id and different texts each. Items with
    null id or text, or fewer than GRAM words, match nothing; repeated items
    count once, items of one id and different texts together. Of alignments of
    one score the first to end is reported. Texts are read whole. A copy whose
    only surviving run is a common one is not found. Extra columns are ignored. An empty table on either side gives no rows.
    """
    return matches(docs, benchmark).select(F.col("id").alias("doc_id"), "item_id", F.round("score", 6).alias("score"), "end_word")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no test item, with all their columns; nulls as in ``contaminated``."""
    renamed, names = numbered(docs)
    id_at, text_at = (f"__c{position(names, c)}" for c in ("doc_id", "text"))
    gone = stored(matches(docs, benchmark).select(sortable_id(F.col("id")).alias("__id"), F.col("tk").alias("__tk")).distinct(), "contaminated")
    keys = {"__id": sortable_id(F.col(id_at).cast("long")), "__tk": text_key(F.col(text_at))}
    return renamed.withColumns(keys).join(gone, ["__id", "__tk"], "left_anti").drop("__id", "__tk").toDF(*names)
