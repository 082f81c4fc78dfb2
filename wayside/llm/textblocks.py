"""Texts of an Arrow batch as byte arrays, and their words as spans and 64-bit hashes, in numpy.

Work goes over slices of a few megabytes, so memory is bounded by the slice or by one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
_PIECE = 1 << 17
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = _LOWER.astype(np.uint64) + _U(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW, _INV = _powers(_BASE, _PIECE + 1), _powers(pow(_BASE, -1, 1 << 64), _PIECE + 1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all rows, row offsets); null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batch with at most so many bytes of text, or one row."""
    if batch.num_rows == 0:
        return
    _, off = texts_of(batch[column])
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends) of all words, and for each row the index of its first word (rows + 1 values)."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    space = _SPACE[data]
    before = np.empty(n, bool)
    before[0], before[1:] = True, space[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, space[1:]
    inner = off[(off > 0) & (off < n)]
    before[inner] = True
    after[inner - 1] = True
    word = ~space
    starts, ends = np.flatnonzero(word & before), np.flatnonzero(word & after) + 1
    return starts, ends, np.searchsorted(starts, off)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span with A-Z in lower case; spans are in order and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        lo = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, lo + _PIECE, "right")))
        n = int(ends[to - 1] - lo)
        pw, inv = (_POW, _INV) if n <= _PIECE else (_powers(_BASE, n + 1), _powers(pow(_BASE, -1, 1 << 64), n + 1))
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUE[data[lo : lo + n]] * pw[:n], out=total[1:])
        s, e = starts[at:to] - lo, ends[at:to] - lo
        out[at:to] = (total[e] - total[s]) * inv[s] + (e - s).astype(np.uint64) * _U(0xD6E8FEB86659FD93)
        at = to
    return mix(out)


def windows_of(h: np.ndarray, first: np.ndarray, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows of each row, and where each row's begin (rows + 1 values). With
    short, a row of 1 to k - 1 words has one window, its whole sequence."""
    n = np.diff(first)
    many = np.maximum(n - k + 1, 0)
    if short:
        many = np.where((n > 0) & (n < k), 1, many)
    begin = np.concatenate(([0], np.cumsum(many)))
    row = np.repeat(np.arange(len(n)), many)
    at = np.arange(begin[-1]) - begin[row] + first[row]
    last = first[row + 1]
    padded = np.concatenate((h, np.zeros(k, np.uint64)))
    out = np.zeros(len(at), np.uint64)
    for j in range(k):
        word = padded[at + j]
        if short:
            word = np.where(at + j < last, word, _U(j))
        out = mix(out * _U(0x9FB21C651E98DF25) + word)
    return out, begin
