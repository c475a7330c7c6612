"""Whole texts as Arrow buffers, cut into words by NumPy.

A word is a run of bytes other than space and \\x09-\\x0D in the UTF-8 text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text that are hashed at a time; hashes do not depend on it.
CHUNK = 4_000_000
#: Bytes of text that the pipeline's operators take on at a time: their arrays come to 50 to 100 bytes for each.
SLICE = 500_000
#: Rows of whole texts or sets in an Arrow batch, where an operator writes it: a batch is bounded by rows only.
ROWS = 2_000


def slices(batches, column: str, max_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The record batches, cut so that the texts of each have about ``max_bytes`` at most (one row at least)."""
    for batch in batches:
        n, k = batch.num_rows, batch.schema.get_field_index(column)
        if not n:
            continue
        texts = batch.column(k).fill_null("")
        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + max_bytes, "right")) - 1)
            to = min(to, n)
            yield batch.slice(at, to - at)
            at = to


class Words:
    """Words of an array of texts: ``data`` bytes, ``start``/``end`` per word, ``first`` (n + 1) word numbers per text."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = texts.fill_null("")
        n = len(texts)
        off = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
        buf = texts.buffers()[2]
        data = np.frombuffer(buf, np.uint8)[off[0] : off[-1]] if buf is not None else np.zeros(0, np.uint8)
        off = off - off[0]
        self.off = off
        self.data = LOWER[data] if lower else data
        if not len(data):
            self.start = self.end = np.zeros(0, np.int64)
            self.first = np.zeros(n + 1, np.int64)
            return
        space = _SPACE[data]
        before = np.empty_like(space)
        before[0] = True
        before[1:] = space[:-1]
        edges = off[:-1][off[:-1] < len(data)]
        before[edges] = True
        after = np.empty_like(space)
        after[-1] = True
        after[:-1] = space[1:]
        after[off[1:][off[1:] > 0] - 1] = True
        self.start = np.flatnonzero(before & ~space)
        self.end = np.flatnonzero(after & ~space) + 1
        self.first = np.searchsorted(self.start, off)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, seed: int) -> np.ndarray:
        """A 64-bit hash of each word, the same on every machine."""
        if not len(self.start):
            return np.zeros(0, U64)
        # a few million bytes at a time: the arrays below take about 40 bytes for each
        cuts = np.unique(np.searchsorted(self.start, np.arange(0, len(self.data), CHUNK)))
        parts = [self._hashes(seed, int(i), int(j)) for i, j in zip(cuts, [*cuts[1:], len(self.start)]) if i < j]
        return np.concatenate(parts)

    def _hashes(self, seed: int, i: int, j: int) -> np.ndarray:
        rng = np.random.default_rng(seed)
        table = rng.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
        mult = U64(int(rng.integers(1, 2**62)) * 2 + 1)
        low, high = int(self.start[i]), int(self.end[j - 1])
        start, end, data = self.start[i:j] - low, self.end[i:j] - low, self.data[low:high]
        size = end - start
        power = np.empty(int(size.max()), U64)
        power[0] = 1
        if len(power) > 1:
            power[1:] = mult
            power = np.multiply.accumulate(power)
        n = len(data)
        where = np.zeros(n, np.int64)
        where[start] = start
        inside = np.zeros(n + 1, np.int8)
        inside[start] = 1
        inside[end] -= 1
        inside = np.cumsum(inside[:-1], dtype=np.int8).view(bool)
        pos = np.arange(n) - np.maximum.accumulate(where)
        pos[~inside] = 0
        terms = table[data] * power[pos]
        terms[~inside] = 0
        return mix(np.add.reduceat(terms, start) + size.astype(U64) * U64(0x9E3779B97F4A7C15))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of the ordered pairs (a[i], b[i])."""
    return mix(a * U64(0x9FB21C651E98DF25) + mix(b + U64(0x2545F4914F6CDD1D)))


def strings(values: list, kind: pa.DataType | None = None) -> pa.Array:
    return pa.array(values, kind or pa.string())
