"""Words and word-window hashes of Arrow text columns, as whole-array numpy operations inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: A random 64-bit value for each byte, and odd multipliers with their inverses modulo 2**64.
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(0, 2**64, 256, dtype=np.uint64)
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of a multiplier and of its inverse. Kept for the next call up to a size that idle workers can hold."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(down, out=down)
        if size > 1 << 21:
            return up[:n], down[:n]
        _POWERS[base] = up, down
    up, down = _POWERS[base]
    return up[:n], down[:n]


def _runs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of ``values[s:e]`` for each run, from one running sum."""
    up, down = _powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


@dataclass
class Words:
    """Words of some texts: their bytes are ``data[starts[i]:ends[i]]``; text t has the words ``first[t]:first[t + 1]``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        return _runs(_BYTE[self.data], self.starts, self.ends, _ODD[0])

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(texts: pa.Array, lower: bool = False, space: np.ndarray = SPACE) -> Words:
    """The words of a string column; null is empty. ``space``: which bytes part words."""
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    low, high = (int(offsets[0]), int(offsets[-1])) if len(texts) else (0, 0)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[low:high] if high > low else np.zeros(0, np.uint8)
    if lower:
        data = LOWER[data]
    offsets = offsets - low
    solid = ~space[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | edge[1 : len(data)]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | edge[1 : len(data)]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def _counts(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = np.maximum(np.diff(first) - width + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(n)])
    return n, bounds, np.arange(bounds[-1]) - np.repeat(bounds[:-1], n) + np.repeat(first[:-1], n)


def windows(hashes: np.ndarray, first: np.ndarray, width: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words of one text, the index of their first word, and each text's bounds among them."""
    _, bounds, at = _counts(first, width)
    return _runs(mix(hashes + np.uint64(seed)), at, at + width, _ODD[1 + seed % 2]), at, bounds


def least_of(values: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every ``n`` consecutive values."""
    out, span = values, 1
    while span * 2 <= n:
        out, span = np.minimum(out[:-span], out[span:]), span * 2
    return np.minimum(out[: len(out) - (n - span)], out[n - span :]) if n > span and len(out) > n - span else out


def sampled(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each run of ``width`` words the least hash among its halves' length of words (equal runs have equal ones, neighbours mostly share theirs),
    the index of the run's first word, and each text's bounds among the runs."""
    half = width // 2
    grams, _, inner = windows(hashes, first, half)
    n, bounds, at = _counts(first, width)
    if not len(at):
        return np.zeros(0, np.uint64), at, bounds
    where = np.arange(bounds[-1]) - np.repeat(bounds[:-1], n) + np.repeat(inner[:-1], n)
    return least_of(grams, width - half + 1)[where], at, bounds


def covered(at: np.ndarray, total: int, width: int) -> np.ndarray:
    """Mask over ``total`` words of those inside ``[a, a + width)`` for an ``a`` of ``at``."""
    step = np.zeros(total + 1, np.int32)
    np.add.at(step, at, 1)
    np.add.at(step, np.minimum(at + width, total), -1)
    return np.cumsum(step[:-1]) > 0


def pieces(batch: pa.RecordBatch, text: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of text, so that the arrays over it stay small; a longer text is a slice of its own."""
    sizes = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))])
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def rows(batch: pa.RecordBatch, text: str = "text", most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, Words]]:
    for part in pieces(batch, text, most):
        yield part, words(part.column(text))
