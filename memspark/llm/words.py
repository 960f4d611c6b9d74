"""Words of a batch of texts as arrays: found and hashed for the whole batch at once.

A word is a run of bytes other than U+0020 and U+0009 to U+000D. Words are hashed by a polynomial
over a random 64-bit value for each byte, so a word's hash does not depend on where it
stands. Work is done in blocks of BLOCK bytes that end between words, which bounds the
memory beside the text itself (a block grows only for a single word longer than it).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 9, 10, 11, 12, 13]] = True

_random = np.random.default_rng(20240611)
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_STEP = np.uint64(0x9E3779B97F4A7C15)
_STEP_BACK = np.uint64(pow(int(_STEP), -1, 2**64))
_WINDOW = _random.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that lets every input bit reach every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 * BLOCK) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have about ``limit`` bytes (one row at least)."""
    if not batch.num_rows:
        return
    _, offsets = utf8(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def _powers(n: int, base: np.uint64) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    if n:
        steps[0] = 1
    return np.multiply.accumulate(steps)


class Words:
    """``hash`` and ``doc`` (row number) of each word; ``first`` and ``count`` for each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool):
        values = _BYTE_LOWER if lower else _BYTE
        starts, hashes = [], []
        at, total = 0, len(data)
        while at < total:
            end = self._cut(data, offsets, at, min(at + BLOCK, total))
            s, h = self._block(data[at:end], offsets, at, values)
            starts.append(s)
            hashes.append(h)
            at = end
        start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.doc = np.searchsorted(offsets, start, side="right") - 1
        self.count = np.bincount(self.doc, minlength=len(offsets) - 1).astype(np.int64)
        self.first = np.cumsum(self.count) - self.count

    @staticmethod
    def _cut(data: np.ndarray, offsets: np.ndarray, at: int, end: int) -> int:
        """The last place up to ``end`` where no word goes on, else the first one after it."""
        if end == len(data):
            return end
        row = int(offsets[np.searchsorted(offsets, end, side="right") - 1])
        low = max(at, row)
        gaps = np.flatnonzero(SEPARATOR[data[low:end]])
        if len(gaps):
            return low + int(gaps[-1]) + 1
        if low > at:
            return low
        after = int(offsets[np.searchsorted(offsets, end, side="left")])
        gaps = np.flatnonzero(SEPARATOR[data[end:after]])
        return end + int(gaps[0]) if len(gaps) else after

    @staticmethod
    def _block(data: np.ndarray, offsets: np.ndarray, at: int, values: np.ndarray):
        inside = ~SEPARATOR[data]
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        rows = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, at + len(data))] - at
        opens[rows] = inside[rows]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:] | opens[1:]
        start, stop = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * _powers(len(data), _STEP), out=sums[1:])
        raw = (sums[stop] - sums[start]) * _powers(len(data), _STEP_BACK)[start]
        return start + at, mix(raw + (stop - start).astype(np.uint64))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of ``size`` words of one row, in order."""
        n = len(self.hash) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        value = np.full(n, size, np.uint64)
        for j in range(size):
            value += self.hash[j : j + n] * _WINDOW[j]
        at = np.flatnonzero(self.doc[:n] == self.doc[size - 1 :])
        return at, mix(value[at])

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Row and hash of every run of ``size`` words; of rows with fewer, the whole sequence."""
        at, value = self.windows(size)
        docs, values = [self.doc[at]], [value]
        for few in range(1, size):
            row = np.flatnonzero(self.count == few)
            whole = np.full(len(row), few, np.uint64)
            for j in range(few):
                whole += self.hash[self.first[row] + j] * _WINDOW[j]
            docs.append(row)
            values.append(mix(whole))
        return np.concatenate(docs), np.concatenate(values)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The set of lower-cased shingles of each row: all sets one after another, each in
    rising order, and the offset of each row's set."""
    doc, value = Words(data, offsets, lower=True).shingles(size)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    doc, value = doc[new], value[new]
    counts = np.bincount(doc, minlength=len(offsets) - 1)
    return value, np.concatenate([[0], np.cumsum(counts)])
