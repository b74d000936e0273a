"""Best-two-fit packing of documents into sequences of fixed capacity.

A document's length is its number of UTF-8 bytes, the tokens of a byte-level
model; longer documents are cut into full pieces and a rest. Sequences are
filled one at a time: greedily, the longest piece that fits first; when nothing
fits any more, the shortest piece of the sequence is replaced by the two unpacked
pieces that fill its place most tightly, if they fill it better.

A sequence of one piece may lose it that way as any other: its only piece is its
shortest.

Shape at scale: only (id, length) is shuffled, into shards of about
ROWS_PER_SHARD pieces that are packed independently; a shard's lengths lie in a
bit set, so finding the best piece or pair takes microseconds. One shard holds
all pieces of a small table; more of them differ from that only in which pieces
meet, and each leaves at most its last sequences short.
"""

from __future__ import annotations

from collections import defaultdict, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.llm.common import pick, sortable_id, stored, text_key

#: Bytes in a sequence.
CAPACITY = 16384
#: Pieces that are packed together; more shards leave a little more padding.
ROWS_PER_SHARD = 50_000
#: Sums of pairs this far below the largest that fits are tried one by one; pairs
#: of many lengths have some sum there.
NEAR = 64


class Unpacked:
    """Pieces by length, with bit sets of the lengths present: bit l of ``up``, bit capacity - l of ``down``."""

    def __init__(self, lengths: list[int], capacity: int) -> None:
        self.capacity = capacity
        self.queues: dict[int, deque[int]] = defaultdict(deque)
        self.up = self.down = 0
        for k, length in enumerate(lengths):
            self.put(k, length)

    def put(self, k: int, length: int, front: bool = False) -> None:
        queue = self.queues[length]
        if not queue:
            self.up |= 1 << length
            self.down |= 1 << (self.capacity - length)
        queue.appendleft(k) if front else queue.append(k)

    def take(self, length: int) -> int:
        queue = self.queues[length]
        k = queue.popleft()
        if not queue:
            self.up ^= 1 << length
            self.down ^= 1 << (self.capacity - length)
        return k

    def longest(self, most: int) -> int:
        """The longest length of at most this; 0 if there is none."""
        return max((self.up & ((1 << (most + 1)) - 1)).bit_length() - 1, 0)

    def pair(self, least: int, most: int) -> tuple[int, int] | None:
        """Two lengths with the largest sum in least..most; of those the pair with the longest piece."""
        most = min(most, 2 * max(self.up.bit_length() - 1, 0))
        near = max(least, most - NEAR)
        for total in range(most, near - 1, -1):
            # bit a stays where a and total - a are both present
            shift = self.capacity - total
            both = self.up & (self.down >> shift if shift >= 0 else self.down << -shift)
            while both:
                a = both.bit_length() - 1
                if 2 * a != total or len(self.queues[a]) > 1:
                    return a, total - a
                both ^= 1 << a
        return self._distant_pair(least, near - 1)

    def _distant_pair(self, least: int, most: int) -> tuple[int, int] | None:
        """The same by two pointers into the lengths: where sums are sparse, the lengths are few."""
        sizes = sorted(length for length, queue in self.queues.items() if queue and length < most)
        best, i, j = None, 0, len(sizes) - 1
        while i <= j:
            total = sizes[i] + sizes[j]
            if total > most:
                j -= 1
                continue
            if total >= least and (i < j or len(self.queues[sizes[i]]) > 1):
                best, least = (sizes[j], sizes[i]), total + 1
            i += 1
        return best


def pack(lengths: list[int], capacity: int) -> list[list[int]]:
    """Places in ``lengths`` (all in 1..capacity, in order of preference among equals) by sequence."""
    rest = Unpacked(lengths, capacity)
    out = []
    while rest.up:
        chosen: list[int] = []
        gap = capacity
        while length := rest.longest(gap):
            chosen.append(rest.take(length))
            gap -= length
        smallest = lengths[chosen[-1]]
        two = rest.pair(smallest + 1, gap + smallest)
        if two:
            k = chosen.pop()
            chosen += [rest.take(two[0]), rest.take(two[1])]
            rest.put(k, smallest, front=True)
        out.append(chosen)
    return out


def _pack_shard(key: tuple, rows: pa.Table) -> pa.Table:
    size = rows.column("length").to_numpy()
    order = np.lexsort((rows.column("at").to_numpy(), rows.column("tk").to_numpy(), rows.column("sid").to_numpy(), -size))
    rows, size = rows.take(pa.array(order)), size[order]
    bins = pack(size.tolist(), CAPACITY)
    flat = np.array([k for chosen in bins for k in chosen], np.int64)
    ends = np.concatenate([[0], np.cumsum([len(chosen) for chosen in bins])]).astype(np.int32)

    def lists(name: str) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(ends), rows.column(name).combine_chunks().take(pa.array(flat)))

    used = np.add.reduceat(size[flat], ends[:-1]) if len(bins) else np.zeros(0, np.int64)
    return pa.table(
        {
            "shard": pa.array(np.full(len(bins), key[0].as_py(), np.int32)),
            "sequence": pa.array(np.arange(len(bins), dtype=np.int32)),
            "doc_ids": lists("id"),
            "starts": lists("at"),
            "lengths": lists("length"),
            "used": pa.array(used.astype(np.int64)),
        }
    )


def packed(docs: DataFrame) -> DataFrame:
    """One row per sequence: (shard, sequence, doc_ids, starts, lengths, used).

    Entry k of the lists is the piece of lengths[k] bytes from byte starts[k] of
    the document doc_ids[k]; every byte of every document is in exactly one piece.

    Null and empty texts have no piece. A null doc_id stays null in the list.
    Repeated rows are packed each. Among pieces of one length the smaller id,
    then the smaller text hash goes first. Very long texts become several pieces.
    Extra columns are ignored. An empty table gives no rows.
    """
    sizes = pick(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("id"), text_key(F.col("text")).alias("tk"), F.octet_length("text").cast("long").alias("bytes")
    )
    sizes = stored(sizes.where("bytes > 0"), "lengths")
    pieces = sizes.select(
        "id", "tk", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(CAPACITY).cast("long"))).alias("at")
    ).select("id", sortable_id(F.col("id")).alias("sid"), "tk", "at", F.least(F.lit(CAPACITY), F.col("bytes") - F.col("at")).alias("length"))
    n = pieces.count()
    shards = max(1, -(-n // ROWS_PER_SHARD))
    sharded = pieces.withColumn("shard", F.pmod(F.xxhash64("id", "tk", "at"), F.lit(shards)).cast("int"))
    return sharded.groupBy("shard").applyInArrow(
        _pack_shard, "shard int, sequence int, doc_ids array<long>, starts array<long>, lengths array<long>, used long"
    )
