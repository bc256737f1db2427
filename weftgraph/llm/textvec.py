"""Whole Arrow batches of text as numpy arrays: words, hashes and sums per document without a loop over words.

Hashes are polynomials modulo 2**64 over a fixed random table of the bytes, finished by an avalanche step, so a
word's hash is the same in every batch, task and run.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: White space that parts words: the blank and the characters 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of letters and digits; all bytes of characters beyond ASCII count.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_TABLE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n + 1, _BASE, np.uint64), np.full(n + 1, pow(_BASE, -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit value over all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def data_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an array of strings without nulls, and where each text begins and the last ends."""
    _, off, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(off, kind, len(texts) + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def characters(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of UTF-8 bytes, and where each text begins and the last ends among them."""
    if not len(raw) or raw.max() < 128:
        return raw.astype(np.uint32), offsets
    before = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32), before[offsets]


def slices(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes, one text at least: what the arrays of one step may hold."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def seg_sum(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of ``values[start:end]``; 0 for empty ranges."""
    out = np.zeros(len(start), values.dtype if values.dtype.kind == "f" else np.int64)
    full = end > start
    if full.any():
        idx = np.stack([start[full], end[full]], 1).ravel()
        out[full] = np.add.reduceat(np.append(values, values.dtype.type(0)), idx)[::2]
    return out


class Words:
    """The words of a few texts: where they begin and end in ``raw``, and the range ``first[i]:first[i+1]`` of text i.

    ``inside`` says which bytes make words; by default all but white space.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray = ~SPACE):
        self.raw, self.offsets = raw, offsets
        n = len(raw)
        is_in = inside[raw]
        begins, ends = is_in.copy(), is_in.copy()
        begins[1:] &= ~is_in[:-1]
        ends[:-1] &= ~is_in[1:]
        edge = offsets[1:-1]
        edge = edge[(edge > 0) & (edge < n)]
        begins[edge] |= is_in[edge]
        ends[edge - 1] |= is_in[edge - 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self._sums: np.ndarray | None = None
        self._leads: tuple[np.ndarray, np.ndarray] | None = None

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    def _range(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = len(self.raw)
        up, down = _powers(1 << max(20, n.bit_length()))
        if self._sums is None:
            self._sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_TABLE[LOWER[self.raw]] * up[:n], out=self._sums[1:])
        return (self._sums[end] - self._sums[start]) * down[start]

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word with A-Z in lower case."""
        return mix(self._range(self.start, self.end))

    def prefix_hashes(self, n: int) -> np.ndarray:
        """A hash of the first ``n`` characters of each word; 0 for words that are not longer."""
        cut = self.start + n
        if len(self.raw) and self.raw.max() >= 128:
            if self._leads is None:
                begins = (self.raw & 0xC0) != 0x80
                self._leads = np.append(np.flatnonzero(begins), len(self.raw)), (np.cumsum(begins) - 1)[self.start]
            leads, number = self._leads
            cut = leads[np.minimum(number + n, len(leads) - 1)]
        long = cut < self.end
        out = np.zeros(len(self), np.uint64)
        out[long] = mix(self._range(self.start[long], cut[long]) ^ np.uint64(n * 0x51ED27))
        return out


def words_of(texts: pa.Array, inside: np.ndarray = ~SPACE, most: int = 1 << 20) -> Iterator[tuple[int, int, Words]]:
    """(i, j, words of texts i to j - 1) for the whole array, in steps of about ``most`` bytes."""
    raw, off = data_of(texts)
    for i, j in slices(off, most):
        yield i, j, Words(raw[off[i] : off[j]], off[i : j + 1] - off[i], inside)
