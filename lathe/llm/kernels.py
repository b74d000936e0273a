"""Vectorised text kernels shared by the operators of this subpackage.

Everything here works on whole Arrow string columns: the UTF-8 bytes of many
texts lie in one buffer, and tokenising or hashing them is a handful of numpy
passes over that buffer instead of a Python loop per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; keeps numpy temporaries near the CPU caches
#: and bounds a worker's memory whatever the Arrow batch size is.
SLICE_BYTES = 1 << 19

_MULT = np.uint64(0x9E3779B97F4A7C15)
_C1 = np.uint64(0xBF58476D1CE4E5B9)
_C2 = np.uint64(0x94D049BB133111EB)

# Bytes that belong to a word: ASCII letters and digits, and every byte of a
# multi-byte UTF-8 character.
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[128:] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over the 64 output bits."""
    h = (h ^ (h >> np.uint64(30))) * _C1
    h = (h ^ (h >> np.uint64(27))) * _C2
    return h ^ (h >> np.uint64(31))


class _Powers:
    """Powers of the rolling multiplier and of its inverse modulo 2**64."""

    def __init__(self) -> None:
        self.up = np.ones(1, dtype=np.uint64)
        self.down = np.ones(1, dtype=np.uint64)
        self.inverse = np.uint64(pow(int(_MULT), -1, 1 << 64))

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, SLICE_BYTES + 1)
            with np.errstate(over="ignore"):
                self.up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, _MULT))])
                self.down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, self.inverse))])
        return self.up, self.down


_POWERS = _Powers()


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each; a longer text is a range of its own."""
    n = len(column)
    if n == 0:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < n:
        base = int(ends[start - 1]) if start else 0
        stop = int(np.searchsorted(ends, base + limit, side="right"))
        stop = min(n, max(stop, start + 1))
        yield start, stop
        start = stop


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without gaps, and its n + 1 offsets; nulls are empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, 8 * column.offset)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """The words of a slice of texts, lower-cased, with a 64-bit hash each.

    ``row[k]`` is the text of word k, ``start[k]`` and ``stop[k]`` are its
    byte offsets in the lower-cased buffer, ``first`` has n + 1 offsets into
    the words, one range per text.
    """

    def __init__(self, column: pa.Array) -> None:
        data, offsets = utf8(pc.utf8_lower(column))
        n = len(offsets) - 1
        inside = _WORD[data]
        # a text's edge ends a word even where two texts touch
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        edge = offsets[1:-1]
        edge = edge[(edge > 0) & (edge < len(data))]
        opens[edge] = inside[edge]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:]
        closes[edge - 1] = inside[edge - 1]
        self.start = np.flatnonzero(opens)
        self.stop = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.row = np.repeat(np.arange(n), np.diff(self.first))
        self.offsets = offsets
        with np.errstate(over="ignore"):
            up, down = _POWERS.upto(len(data) + 1)
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
            raw = (total[self.stop] - total[self.start]) * down[self.start]
            self.hash = mix(raw + (self.stop - self.start).astype(np.uint64) * _C1)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of every run of n words within one text."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.row[:m] == self.row[n - 1 :])
        with np.errstate(over="ignore"):
            h = self.hash[at]
            for k in range(1, n):
                h = mix(h * _MULT + self.hash[at + k])
        return at, h


def word_hash(word: str) -> int:
    """The hash that Words gives this word; for tests and small driver-side tables."""
    return int(Words(pa.array([word])).hash[0])
