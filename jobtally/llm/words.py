"""Words of whole text columns as numpy arrays: places, documents and 64-bit hashes.

Words are runs of bytes other than space and 0x09-0x0D. A hash is the sum over a word's bytes of a random 64-bit
value per byte, times a power for the place, mixed; equal words have equal hashes in every task and run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = 2_000_000


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit over all bits (the finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def slices(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of at most ``limit`` bytes of text; a longer text is a run of its own."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    start = 0
    while start < len(lengths):
        total = np.cumsum(lengths[start:])
        n = max(1, int(np.searchsorted(total, limit, side="right")))
        yield batch.slice(start, n)
        start += n


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offset of each; nulls are empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray, is_gap: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are no gap; texts never share a run."""
    solid = ~is_gap[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = solid
    before[offsets] = False
    starts = np.flatnonzero(solid & ~before[:-1])
    after = np.zeros(len(data) + 1, bool)
    after[: len(data)] = solid
    after[offsets] = False
    return starts, np.flatnonzero(solid & ~after[1:]) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A hash of each span's bytes."""
    out = np.empty(len(starts), np.uint64)
    values = _VALUES[_LOWER] if lower else _VALUES
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + STEP, side="right")))
        low, high = int(starts[at]), int(ends[to - 1])
        powers = np.full(high - low + 1, BASE, np.uint64)
        powers[0] = 1
        np.cumprod(powers, out=powers)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(values[data[low:high]] * powers[:-1], out=sums[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        unscale = np.full(high - low + 1, _INVERSE, np.uint64)
        unscale[0] = 1
        np.cumprod(unscale, out=unscale)
        out[at:to] = mix((sums[e] - sums[s]) * unscale[s])
        at = to
    return out


@dataclass
class Words:
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # number of words before each text, and of all words

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owners(self) -> np.ndarray:
        """For each word, the place of its text."""
        return np.repeat(np.arange(len(self.first) - 1, dtype=np.int64), self.counts)


def words(texts: pa.Array, lower: bool = False) -> Words:
    data, offsets = raw(texts)
    starts, ends = spans(data, offsets)
    return Words(data, starts, ends, span_hashes(data, starts, ends, lower), np.searchsorted(starts, offsets))


def windows(w: Words, size: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers at which ``size`` consecutive words of one text start, and a hash of each such window."""
    n = len(w.hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    factors = np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    total = w.hashes[:n] * factors[0]
    for j in range(1, size):
        total += w.hashes[j : j + n] * factors[j]
    room = np.repeat(w.first[1:], w.counts)[:n]
    at = np.flatnonzero(np.arange(n) + size <= room)
    return at, mix(total[at])


def local_numbers(w: Words) -> np.ndarray:
    """For each word, its number in its own text, from 0."""
    return np.arange(len(w.hashes), dtype=np.int64) - np.repeat(w.first[:-1], w.counts)
