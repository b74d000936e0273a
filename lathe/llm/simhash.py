"""Near-duplicate search by SimHash and multi-index hashing.

Each text gets a 128-bit fingerprint. Two texts are near copies when their
fingerprints differ in at most ``radius`` bits. Pairs are found by multi-index
hashing: the fingerprint is cut into segments, every text is filed in one table
per segment, and it looks into each table at all values within ``ball`` bits of
its own segment. Whatever it meets there is verified on the complete
fingerprints.

Shape at scale: one narrow scan computes fingerprints; equal fingerprints
collapse before the search, so a group of a million exact copies is one entry.
Rows are routed by the high bits of a segment (only flips of those bits send a
second row); flips of the low bits are looked up inside the group with sorted
arrays. A group emits a spanning forest, never all pairs, so big families of
copies stay linear in what is shuffled. Texts travel once, to drop the copies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lathe.llm.common import forget, numbered, pick, position, sortable_id, stored, text_key
from lathe.llm.kernels import Words, mix, text_slices

BITS = 128
#: Bits by which near copies may differ.
RADIUS = 24
#: Segments; two fingerprints within 2 * SEGMENTS - 1 bits are always found
#: (some segment then differs in at most one bit), further ones up to RADIUS
#: with the probability in the README (recall against brute force above 0.9).
SEGMENTS = 7
#: High bits of a segment that choose the group a row goes to: as many as leave
#: about GROUP_ROWS fingerprints with one value of them. What pairs are met does
#: not depend on it.
LEAST_ROUTE_BITS, MOST_ROUTE_BITS = 4, 14
GROUP_ROWS = 1 << 15
#: Words shorter than this many bytes are function words: they count only in
#: texts that have no longer word.
LONG_WORD = 5
#: Candidate pairs that are expanded at once.
PAIR_BLOCK = 1 << 20

_EDGES = np.linspace(0, BITS, SEGMENTS + 1).round().astype(int)
_SALT = np.uint64(0xD6E8FEB86659FD93)


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n, 16) bytes of fingerprint and a flag that is False for texts without a word.

    Features are the distinct long words, each with weight one: bit b is set
    when more than half of their hashes have it set.
    """
    n = len(texts)
    out, known = np.zeros((n, BITS // 8), np.uint8), np.zeros(n, bool)
    for start, stop in text_slices(texts):
        words = Words(texts.slice(start, stop - start))
        m = stop - start
        long = (words.stop - words.start) >= LONG_WORD
        has_long = np.zeros(m, bool)
        has_long[words.row[long]] = True
        take = long | ~has_long[words.row]
        row, h = words.row[take], words.hash[take]
        if not len(row):
            continue
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
        row, h = row[new], h[new]
        present, at = np.unique(row, return_index=True)
        size = np.diff(np.append(at, len(row)))[:, None]
        halves = []
        for salt in (np.uint64(0), _SALT):
            bits = np.unpackbits(mix(h + salt).view(np.uint8).reshape(-1, 8), axis=1)
            halves.append(2 * np.add.reduceat(bits, at, axis=0, dtype=np.int32) > size)
        out[start + present] = np.packbits(np.concatenate(halves, axis=1), axis=1)
        known[start + present] = True
    return out, known


def _with_fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp, known = fingerprints(batch.column("text"))
        values = pa.FixedSizeBinaryArray.from_buffers(
            pa.binary(BITS // 8), len(fp), [None, pa.py_buffer(np.ascontiguousarray(fp))]
        ).cast(pa.binary())
        values = pa.compute.if_else(pa.array(known), values, pa.scalar(None, pa.binary()))
        yield pa.record_batch([batch.column("id"), batch.column("tk"), values], names=["id", "tk", "fp"])


def segments(fp: np.ndarray) -> list[np.ndarray]:
    """The segments of (n, 16) fingerprints as integers."""
    bits = np.unpackbits(fp, axis=1)
    out = []
    for lo, hi in zip(_EDGES[:-1], _EDGES[1:]):
        weight = np.uint32(1) << np.arange(hi - lo - 1, -1, -1, dtype=np.uint32)
        out.append(bits[:, lo:hi].astype(np.uint32) @ weight)
    return out


def route_bits(fingerprints: int) -> int:
    return min(max((fingerprints // GROUP_ROWS).bit_length(), LEAST_ROUTE_BITS), MOST_ROUTE_BITS)


def _router(route_bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (route, own, low, fp): one for a table entry, which also probes the
    exact high part, and one for each flip of a high bit, which only probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("fp")
            fp = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BITS // 8)
            n = len(fp)
            route, own, low, who = [], [], [], []
            for k, value in enumerate(segments(fp)):
                width = int(_EDGES[k + 1] - _EDGES[k])
                cut = width - route_bits
                high, rest = value >> np.uint32(cut), value & np.uint32((1 << cut) - 1)
                for flip in range(-1, route_bits):
                    part = high if flip < 0 else high ^ np.uint32(1 << flip)
                    route.append(part.astype(np.int32) + (k << route_bits))
                    own.append(np.full(n, flip < 0))
                    low.append(rest.astype(np.int32))
                    who.append(np.arange(n))
            who = np.concatenate(who)
            yield pa.record_batch(
                [pa.array(np.concatenate(route)), pa.array(np.concatenate(own)), pa.array(np.concatenate(low)), column.take(pa.array(who))],
                names=["route", "own", "low", "fp"],
            )

    return run


def _blocks(count: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose counts add up to about PAIR_BLOCK."""
    ends = np.cumsum(count)
    start = 0
    while start < len(count):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + PAIR_BLOCK, side="right")))
        yield start, stop
        start = stop


class _Forest:
    """Union-find over row numbers; keeps the edges that joined two trees."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def _root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        apart = self.parent[a] != self.parent[b]
        for x, y in zip(a[apart].tolist(), b[apart].tolist()):
            rx, ry = self._root(x), self._root(y)
            if rx != ry:
                if rx > ry:
                    rx, ry = ry, rx
                self.parent[ry] = rx
                self.edges.append((x, y))


def group_edges(own: np.ndarray, low: np.ndarray, width: int, words: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest over the verified pairs of one routing group.

    ``own`` rows are table entries and probe their low part and all its
    one-bit flips; other rows spent their flip on the route and probe their low
    part only. ``words`` holds the fingerprints as (n, 2) uint64.
    """
    n = len(low)
    table = np.flatnonzero(own)
    if n < 2 or not len(table):
        return []
    table = table[np.argsort(low[table], kind="stable")]
    keys = low[table]
    forest = _Forest(n)

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(words[a] ^ words[b]).sum(axis=1) <= radius

    # Same value: everything is held against its bucket's first entry, so that in
    # a family of copies only what differs from that entry needs all pairs.
    first = np.searchsorted(keys, low, side="left")
    last = np.searchsorted(keys, low, side="right")
    hit = np.flatnonzero(last > first)
    leader = table[first[hit]]
    close = near(hit, leader)
    forest.join(hit[close], leader[close])
    settled = np.zeros(n, bool)
    settled[hit[close]] = True

    def verify(probe: np.ndarray, lo: np.ndarray, hi: np.ndarray, entries: np.ndarray) -> None:
        """Hold each probe against entries[lo:hi]."""
        count = hi - lo
        for s, e in _blocks(count):
            c = count[s:e]
            a = np.repeat(probe[s:e], c)
            inside = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
            b = entries[np.repeat(lo[s:e], c) + inside]
            ok = (a != b) & near(a, b)
            forest.join(a[ok], b[ok])

    # a row that is not tied to its leader meets the whole bucket
    loose = hit[~close]
    verify(loose, first[loose], last[loose], table)
    # a tied entry has met the loose entries by that; a tied row from outside
    # the table still has to
    loose_entries = table[~settled[table]]
    if len(loose_entries):
        values = low[loose_entries]
        outside = np.flatnonzero(settled & ~own)
        lo = np.searchsorted(values, low[outside], side="left")
        hi = np.searchsorted(values, low[outside], side="right")
        verify(outside, lo, hi, loose_entries)

    open_entries = np.concatenate([[0], np.cumsum(~settled[table])])
    for bit in range(width):
        value = keys ^ np.int32(1 << bit)
        up = value > keys  # each unordered pair of values once
        probe, value = table[up], value[up]
        lo = np.searchsorted(keys, value, side="left")
        hi = np.searchsorted(keys, value, side="right")
        some = hi > lo
        probe, lo, hi = probe[some], lo[some], hi[some]
        if not len(probe):
            continue
        leader = table[lo]
        close = near(probe, leader)
        forest.join(probe[close], leader[close])
        # a probe close to the leader is tied to every entry that is; it meets the
        # bucket only where some entry is not
        whole = ~close | (open_entries[hi] > open_entries[lo])
        verify(probe[whole], lo[whole], hi[whole], table)
    return forest.edges


def _group_searcher(route_bits: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        k = key[0].as_py() >> route_bits
        width = int(_EDGES[k + 1] - _EDGES[k]) - route_bits
        column = rows.column("fp").combine_chunks()
        words = np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, 2)
        own = rows.column("own").to_numpy()
        low = rows.column("low").to_numpy().astype(np.int32)
        edges = np.array(group_edges(own, low, width, words, RADIUS), dtype=np.int64).reshape(-1, 2)
        return pa.table({"a": column.take(pa.array(edges[:, 0])), "b": column.take(pa.array(edges[:, 1]))})

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected component, for nodes that have an edge.

    Alternates large-star and small-star steps until the edges stay the same;
    each round's edges are written to the shared folder.
    """

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = mark(edges)
    node = Window.partitionBy("u")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.withColumn("m", F.least("u", F.min("v").over(node)))
            .where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        down = large.withColumn("m", F.min("v").over(node))
        old, edges = edges, stored(
            down.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).distinct(),
            "edges",
        )
        forget(old)
        after = mark(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_copies(docs: DataFrame) -> DataFrame:
    """(id, tk, fp, keep_id, keep_tk, keep_fp, nth) for every row that has a word.

    ``tk`` is a hash of the text, ``keep_*`` describe the row of its group that
    stays: the one with the smallest id, nulls last, then the smallest ``tk``.
    Repeated rows are numbered by ``nth``; the first of them may stay.
    """
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("id"), text_key(F.col("text")).alias("tk"), "text")
    prints = stored(rows.mapInArrow(_with_fingerprint, "id long, tk long, fp binary").where("fp is not null"), "fingerprints")
    distinct = stored(prints.select("fp").distinct(), "distinct")
    bits = route_bits(distinct.count())
    pairs = (
        distinct.mapInArrow(_router(bits), "route int, own boolean, low int, fp binary")
        .groupBy("route")
        .applyInArrow(_group_searcher(bits), "a binary, b binary")
    )
    roots = components(pairs)
    forget(distinct)
    order = F.struct(sortable_id(F.col("id")).alias("sort"), "tk", "id", "fp")
    # one row for each fingerprint before its group is looked up: exact copies,
    # however many, meet the group as one row
    firsts = prints.groupBy("fp").agg(F.min(order).alias("first"))
    grouped = firsts.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    keepers = grouped.groupBy("root").agg(F.min("first").alias("keep"))
    known = grouped.join(keepers, "root").select(
        "fp", F.col("keep.id").alias("keep_id"), F.col("keep.tk").alias("keep_tk"), F.col("keep.fp").alias("keep_fp")
    )
    same = Window.partitionBy("id", "tk").orderBy(F.lit(1))
    return prints.join(known, "fp").withColumn("nth", F.row_number().over(same))


def stays() -> Column:
    return F.expr("(id <=> keep_id) and tk = keep_tk and nth = 1")


def duplicates(docs: DataFrame) -> DataFrame:
    """One row (doc_id, duplicate_of, hamming) for each document that a near copy makes superfluous.

    Pairs up to 2 * SEGMENTS - 1 bits apart are always found, further ones up to
    RADIUS with a probability that falls with the distance (README: recall 0.945).

    ``duplicate_of`` is the document that stays for its group; ``hamming`` is the
    distance of the two fingerprints, which may exceed RADIUS where documents
    between them chain the group.

    Null, empty and word-less texts have no fingerprint and match nothing. A
    null doc_id sorts last, so it stays only where no other id is in the group.
    Of repeated rows one stays; the others are reported with duplicate_of equal
    to doc_id. Very long texts are read whole. Ties go to the smaller text hash.
    Extra columns are ignored. An empty table gives no rows.
    """
    return (
        near_copies(docs)
        .where(~stays())
        .select(
            F.col("id").alias("doc_id"),
            F.col("keep_id").alias("duplicate_of"),
            _hamming(F.col("fp"), F.col("keep_fp")).alias("hamming"),
        )
    )


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The documents without near copies: one row of each group stays; all columns, any names.

    Rows without a fingerprint (null, empty and word-less texts) all stay. See
    ``duplicates`` for which row of a group stays.
    """
    renamed, names = numbered(docs)
    id_at, text_at = (f"__c{position(names, c)}" for c in ("doc_id", "text"))
    gone = (
        near_copies(docs)
        .where(~stays())
        .groupBy(sortable_id(F.col("id")).alias("__id"), F.col("tk").alias("__tk"))
        .agg(F.count("*").alias("__gone"))
    )
    rows = renamed.withColumns({"__id": sortable_id(F.col(id_at).cast("long")), "__tk": text_key(F.col(text_at))})
    # of rows that are equal in id and text, all but as many as are superfluous
    # stay; the window reuses the join's partitioning and order
    same = Window.partitionBy("__id", "__tk").orderBy(F.lit(1))
    joined = rows.join(gone, ["__id", "__tk"], "left").withColumn("__n", F.row_number().over(same))
    return joined.where("__gone is null or __n > __gone").select(*[f"__c{k}" for k in range(len(names))]).toDF(*names)


def _hamming(a: Column, b: Column) -> Column:
    def half(x: Column, at: int) -> Column:
        return F.conv(F.hex(F.substring(x, at, 8)), 16, -10).cast("long")

    return (F.bit_count(half(a, 1).bitwiseXOR(half(b, 1))) + F.bit_count(half(a, 9).bitwiseXOR(half(b, 9)))).cast("int")
