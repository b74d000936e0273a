"""Sharding by histogram sort: equal shards of a sorted table with one exchange.

Splitters are found before any text moves. Candidate boundaries are held
against all keys, the exact bytes below each are counted, and only splitters
that miss their target by more than the tolerance get new candidates, drawn from
the keys that lie between the two nearest boundaries. Then every row goes to its
shard once and is sorted there.

Shape at scale: the rounds read a stored table of keys and sizes (18 bytes a
row and its source) and return one number per candidate; the texts are read twice (sizes, then
the exchange) and shuffled once.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathe.llm.common import forget, numbered, position, sortable_id, stored

#: Bytes of text a shard should have.
SHARD_BYTES = 64 << 20
#: A splitter may miss its place by this share of a shard.
TOLERANCE = 0.01
#: New candidates per unfinished splitter and round; fewer where all together
#: would be more than MAX_PROBES, which bounds what the driver and a task hold.
PROBES, MAX_PROBES = 32, 1 << 18
#: A table that would need more shards gets so many larger ones: they are the
#: partitions of one exchange.
MAX_SHARDS = 1 << 16


def sort_key(source: Column, doc_id: Column) -> Column:
    """Binary key whose byte order is that of (source, doc_id); null ids last, null sources as empty.

    Two zero bytes end the source and a one byte follows every zero byte in it,
    so that no source's bytes run on into another's id.
    """
    whole = F.replace(F.coalesce(source, F.lit("")), F.lit("\0"), F.lit("\0\1")).cast("binary")
    number = sortable_id(doc_id.cast("long")).bitwiseXOR(F.lit(-(1 << 63)))
    return F.concat(whole, F.lit(b"\0\0"), F.unhex(F.lpad(F.hex(number), 16, "0")))


def _interval(bounds: list[bytes]) -> Callable[[str | Column], Column]:
    """How many of the sorted boundaries are at or below a key."""

    @F.pandas_udf("int")
    def interval(key: pd.Series) -> pd.Series:
        # as objects: numpy's byte strings would pad every key to the longest
        edges = np.array([*bounds, None], dtype=object)[:-1]
        return pd.Series(np.searchsorted(edges, key.to_numpy(object), side="right").astype(np.int32))

    return interval


def _inside(bounds: list[bytes]) -> Callable[[str | Column], Column]:
    """The same, but null for a key that is a boundary itself."""

    @F.pandas_udf("int")
    def inside(key: pd.Series) -> pd.Series:
        edges = np.array([*bounds, None], dtype=object)[:-1]
        keys = key.to_numpy(object)
        at = np.searchsorted(edges, keys, side="right")
        same = np.zeros(len(keys), bool)
        if len(edges):
            same = (at > 0) & (edges[np.maximum(at, 1) - 1] == keys)
        return pd.Series(np.where(same, None, at)).astype("Int32")

    return inside


@dataclass
class _Splitter:
    target: float
    low: bytes
    low_bytes: int
    high: bytes | None
    high_bytes: int
    done: bytes | None = None

    def closest(self) -> bytes:
        if self.high is None or self.target - self.low_bytes <= self.high_bytes - self.target:
            return self.low
        return self.high


def splitters(keys: DataFrame, shard_bytes: int, tolerance: float = TOLERANCE) -> list[bytes]:
    """Boundaries that cut the keys (key, bytes) into shards of about ``shard_bytes``, or MAX_SHARDS larger ones.

    A boundary is within the tolerance of its place, or the nearest there is
    when a single key is heavier than that.
    """
    whole = keys.agg(F.sum("bytes")).first()[0] or 0
    n = min(MAX_SHARDS, max(1, -(-int(whole) // shard_bytes)))
    slack = tolerance * whole / n
    todo = [_Splitter(whole * k / n, b"", 0, None, int(whole)) for k in range(1, n)]
    everything = list(todo)
    while todo:
        # candidates: for each open stretch, keys of some random slots
        stretch = {(s.low, s.high) for s in todo}
        edges = sorted({e for pair in stretch for e in pair if e})
        each = max(2, min(PROBES, MAX_PROBES // len(stretch)))
        opened = {bisect_right(edges, low) for low, _ in stretch}
        drawn = (
            keys.withColumn("part", _inside(edges)("key"))
            .where("part is not null")
            .groupBy("part", F.pmod(F.xxhash64("key"), F.lit(each)).alias("slot"))
            .agg(F.min_by("key", F.xxhash64("key", F.lit(7))).alias("key"))
        )
        probes = sorted({bytes(r.key) for r in drawn.collect() if r.part in opened} | set(edges))
        if not probes:
            for s in todo:
                s.done = s.closest()
            break
        sizes = keys.groupBy(_interval(probes)("key").alias("part")).agg(F.sum("bytes").alias("bytes")).collect()
        count = np.zeros(len(probes) + 1, np.int64)
        for r in sizes:
            count[r.part] = r.bytes
        below = np.cumsum(count)[:-1]
        for s in todo:
            before = (s.low, s.high)
            at = int(np.searchsorted(below, s.target, side="right"))
            if at > 0:
                s.low, s.low_bytes = probes[at - 1], int(below[at - 1])
            if at < len(probes):
                s.high, s.high_bytes = probes[at], int(below[at])
            near = s.closest()
            error = abs((s.low_bytes if near == s.low else s.high_bytes) - s.target)
            if error <= slack or before == (s.low, s.high):
                s.done = near
        todo = [s for s in todo if s.done is None]
    return sorted({s.done for s in everything if s.done})


def shards(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The documents with all their columns and ``shard``, one partition per shard, sorted by (source, doc_id) throughout.

    Shards hold about ``shard_bytes`` bytes of text, exactly counted, to within
    TOLERANCE (more in a table of over MAX_SHARDS times that, which gets MAX_SHARDS
    equal ones); rows of one key are never parted, so a key heavier than that
    makes its shard heavier. Shard k's keys are all below shard k + 1's.

    A null source sorts like an empty one, rows of both in order of doc_id; a
    null doc_id sorts after all others. Null
    and empty texts weigh nothing and are kept, as are repeated rows. Sources
    count whole, by their bytes. Ties are in any order.
    An extra column named shard is replaced. An empty table gives no rows.
    """
    renamed, names = numbered(docs)
    id_at, text_at, source_at = (f"__c{position(names, c)}" for c in ("doc_id", "text", "source"))
    key = sort_key(F.col(source_at), F.col(id_at))
    sizes = renamed.select(key.alias("key"), F.coalesce(F.octet_length(text_at), F.lit(0)).cast("long").alias("bytes"))
    keys = stored(sizes, "keys")
    bounds = splitters(keys, shard_bytes)
    forget(keys)
    shard = _interval(bounds)(F.col("__key")) if bounds else F.lit(0)
    kept = [f"__c{k}" for k, name in enumerate(names) if name.lower() != "shard"]
    placed = renamed.withColumn("__key", key).withColumn("__shard", shard).repartitionById(len(bounds) + 1, F.col("__shard"))
    ordered = placed.sortWithinPartitions(F.coalesce(source_at, F.lit("")), sortable_id(F.col(id_at).cast("long")))
    return ordered.select(*kept, "__shard").toDF(*[n for n in names if n.lower() != "shard"], "shard")
