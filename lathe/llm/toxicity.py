"""Toxicity: a linear classifier over character n-grams with naive Bayes scaling.

Features are the hashed n-grams of the lower-cased text, valued by how dense
they are in it. Each is scaled by its naive Bayes log-count ratio between the
two classes, and a logistic regression is fitted on the scaled features. As it is
linear in the densities, a text's score is a sum over its places, with one look
into a table for each n-gram and no counting.

The fit is on the driver over a bounded sample of labelled rows; scoring is one
map over the documents, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.llm.common import numbered, pick, position
from lathe.llm.kernels import text_slices

#: At most so many labelled documents of each class are used for training, the
#: ones whose ids hash lowest.
TRAIN_PER_CLASS = 2000
SIZES = (3, 4, 5, 6)
HASH_BITS = 19
#: Places of training n-grams that are added up at once.
TRAIN_SLICE = 1 << 20
#: Probability from which a document counts as toxic.
THRESHOLD = 0.5
SMOOTHING = 1.0
L2 = 1e-4
#: Most steps of the fit, and the length of a gradient that ends it.
ROUNDS, FLAT = 40, 1e-3
_SEED = 0x5EED

_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0x7FEB352D], np.uint32)


@dataclass
class Model:
    coefficient: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        """Probability of being toxic; 0 for null and empty texts."""
        out = np.zeros(len(texts))
        if self.bias == -np.inf:
            return out
        for start, stop in text_slices(texts):
            code, offsets = codepoints(texts.slice(start, stop - start))
            total = np.zeros(stop - start)
            for n, index in grams(code):
                running = np.concatenate([[0.0], np.cumsum(self.coefficient[index], dtype=np.float64)])
                first = np.minimum(offsets[:-1], len(index))
                total += running[np.clip(offsets[1:] - n + 1, first, len(index))] - running[first]
            size = np.diff(offsets)
            z = self.bias + total * 1000 / np.maximum(size, 1)
            z[size == 0] = -np.inf
            with np.errstate(over="ignore"):
                out[start:stop] = 1 / (1 + np.exp(-z))
        return out


def codepoints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The characters of the lower-cased texts in one array, and n + 1 offsets."""
    lower = pc.fill_null(pc.utf8_lower(texts), "")
    lengths = pc.utf8_length(lower).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    joined = "".join(lower.to_pylist())
    return np.frombuffer(joined.encode("utf-32-le"), np.uint32), offsets


def grams(code: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(n, hashed feature at each position) for each size of n-gram, across text borders."""
    total: np.ndarray | None = None
    done = 0
    for n in SIZES:
        m = len(code) - n + 1
        if m <= 0:
            return
        total = np.zeros(m, np.uint32) if total is None else total[:m].copy()
        for k in range(done, n):
            total += code[k : k + m] * _FACTORS[k]
        done = n
        mixed = (total ^ (total >> np.uint32(15))) * np.uint32((0x2C1B3C6D + 2 * n) & 0xFFFFFFFF)
        yield n, (mixed >> np.uint32(32 - HASH_BITS)).astype(np.int32)


class Sample:
    """The n-grams of the training texts, for each size in one array, text after text; a feature stands there as often as it occurs."""

    def __init__(self, texts: pa.Array) -> None:
        parts = list(text_slices(texts))
        empty = [np.zeros(0, np.int64)]
        lengths = np.concatenate([np.diff(codepoints(texts.slice(start, stop - start))[1]) for start, stop in parts] or empty)
        # what one occurrence adds to a feature: its share of a thousand characters
        self.weight = 1000 / np.maximum(lengths, 1)
        self.ends = [np.concatenate([[0], np.cumsum(np.maximum(lengths - n + 1, 0))]) for n in SIZES]
        # filled in place, as these arrays are most of the driver's memory
        self.index = [np.zeros(ends[-1], np.int32) for ends in self.ends]
        for start, stop in parts:
            code, offsets = codepoints(texts.slice(start, stop - start))
            owner = np.repeat(np.arange(stop - start, dtype=np.int32), np.diff(offsets))
            for (n, index), found, ends in zip(grams(code), self.index, self.ends):
                found[ends[start] : ends[stop]] = index[owner[: len(index)] == owner[n - 1 :]]

    def _slices(self) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
        """(features, ends, first text, text after the last) of about TRAIN_SLICE places each."""
        for index, ends in zip(self.index, self.ends):
            k, n = 0, len(ends) - 1
            while k < n:
                stop = min(n, max(k + 1, int(np.searchsorted(ends, ends[k] + TRAIN_SLICE, side="right")) - 1))
                yield index[ends[k] : ends[stop]], ends[k : stop + 1] - ends[k], k, stop
                k = stop

    def times(self, w: np.ndarray) -> np.ndarray:
        """For each text the sum of its features' values, weighted."""
        out = np.zeros(len(self.weight))
        for index, ends, a, b in self._slices():
            running = np.concatenate([[0.0], np.cumsum(w[index], dtype=np.float64)])
            out[a:b] += running[ends[1:]] - running[ends[:-1]]
        return out * self.weight

    def spread(self, g: np.ndarray) -> np.ndarray:
        """For each feature the sum over the texts of its value times the text's g."""
        out = np.zeros(1 << HASH_BITS)
        for index, ends, a, b in self._slices():
            out += np.bincount(index, weights=np.repeat((g * self.weight)[a:b], np.diff(ends)), minlength=len(out))
        return out


def _minimum(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray) -> np.ndarray:
    """Where a smooth convex function is least, by L-BFGS with five pairs and halved steps."""
    value, g = f(x)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(ROUNDS):
        if np.linalg.norm(g) < FLAT:
            break
        d, alphas = -g, []
        for s, y, r in reversed(pairs):
            alphas.append(r * (s @ d))
            d = d - alphas[-1] * y
        if pairs:
            s, y, r = pairs[-1]
            d = d / (r * (y @ y))
        else:
            d = d / max(1.0, np.linalg.norm(g))
        for (s, y, r), alpha in zip(pairs, reversed(alphas)):
            d = d + s * (alpha - r * (y @ d))
        slope, step = g @ d, 1.0
        while True:
            new_x = x + step * d
            new_value, new_g = f(new_x)
            if new_value <= value + 1e-4 * step * slope or step < 1e-10:
                break
            step /= 2
        s, y = new_x - x, new_g - g
        if s @ y > 1e-12:
            pairs = [*pairs[-4:], (s, y, 1 / (s @ y))]
        if step < 1e-10:
            break
        x, value, g = new_x, new_value, new_g
    return x


def fit(texts: list[str | None], toxic: list[int]) -> Model:
    """The classifier for these labelled texts; with one class only it calls nothing toxic."""
    width = 1 << HASH_BITS
    y = np.array(toxic, dtype=np.float64)
    if len(y) == 0 or y.min() == y.max():
        return Model(np.zeros(width, np.float32), -np.inf)
    sample = Sample(pa.array(texts, pa.string()))
    shares = np.stack([SMOOTHING + sample.spread((y == c).astype(np.float64)) for c in (0, 1)])
    shares /= shares.sum(axis=1, keepdims=True)
    ratio = np.log(shares[1] / shares[0])
    # both classes count alike
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    sign = 2 * y - 1

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        w = x[:-1]
        margin = sign * (sample.times((w * ratio).astype(np.float32)) + x[-1])
        g = -weight * sign / (1 + np.exp(np.clip(margin, -35, 35)))
        value = weight @ np.logaddexp(0, -margin) + 0.5 * L2 * (w @ w)
        return float(value), np.append(ratio * sample.spread(g) + L2 * w, g.sum())

    x = _minimum(loss, np.zeros(width + 1))
    return Model((x[:-1] * ratio).astype(np.float32), float(x[-1]))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on at most TRAIN_PER_CLASS labelled documents of each class.

    A doc_id labelled more than once counts as toxic if one label says so; null
    labels and labels without a document are ignored.
    """
    known = pick(labels, "doc_id", "toxic").dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.col("doc_id"), F.lit(_SEED))
    chosen = known.where("toxic > 0").orderBy(order).limit(TRAIN_PER_CLASS).unionByName(
        known.where("toxic = 0").orderBy(order).limit(TRAIN_PER_CLASS)
    )
    # bounded by 2 * TRAIN_PER_CLASS ids, so it may be broadcast
    sample = pick(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id")
    best = sample.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic"))
    rows = best.orderBy("doc_id").toArrow()
    flags = [int(x > 0) for x in rows.column("toxic").to_pylist()]
    return fit(rows.column("text").to_pylist(), flags)


def _scorer(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(batch.column("text"))
            yield pa.record_batch([batch.column("doc_id"), pa.array(score), pa.array(score >= THRESHOLD)], names=["doc_id", "score", "toxic"])

    return run


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score, toxic) for every row of the documents.

    Null and empty texts score 0 and are not toxic. A null doc_id stays null;
    repeated rows give repeated results; equal texts score equally; texts are
    read whole, however long. Extra columns are ignored. Without labels of both
    classes every score is 0. An empty table gives no rows.
    """
    model = train(docs, labels)
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(_scorer(model), "doc_id long, score double, toxic boolean")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not toxic, with all their columns; nulls as in ``scores``."""
    model = train(docs, labels)
    renamed, names = numbered(docs)
    at = position(names, "text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(batch.column(at)) < THRESHOLD))

    return renamed.mapInArrow(keep, renamed.schema).toDF(*names)
