"""NumPy kernels over the UTF-8 bytes of whole Arrow batches: words, lines, hashes, windows.

A word is a maximal run of bytes other than space and \\x09-\\x0D; no text is decoded, copied per row or cut.
Batches are worked off in slices of about CHUNK bytes at document borders, so memory follows the longest text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def _spread(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values, all wrapping."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


_BYTE = _spread(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_BYTE_LOW = _BYTE.copy()
_BYTE_LOW[65:91] = _BYTE[97:123]
_STEP = np.uint64(0x9E3779B97F4A7C55)
_POWERS = [np.cumprod(np.full(4096, _STEP, dtype=np.uint64))]


def _powers(n: int) -> np.ndarray:
    if n > len(_POWERS[0]):
        _POWERS[0] = np.cumprod(np.full(1 << int(n - 1).bit_length(), _STEP, dtype=np.uint64))
    return _POWERS[0]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets; a null is an empty row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = CHUNK):
    """Row ranges of about `limit` bytes, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def text_slices(batch: pa.RecordBatch, name: str = "text", limit: int = CHUNK):
    """(first row, last row + 1, bytes, offsets) for each slice of a batch."""
    data, off = text_bytes(batch.column(name))
    for i, j in slices(off, limit):
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]


def per_row(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of a byte-wise array over each row."""
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    white = _WHITE[data]
    before = np.empty(len(data), dtype=bool)
    before[0], before[1:] = True, white[:-1]
    after = np.empty(len(data), dtype=bool)
    after[-1], after[:-1] = True, white[1:]
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    before[inner] = True
    after[inner - 1] = True
    start = np.flatnonzero(~white & before)
    end = np.flatnonzero(~white & after) + 1
    return start, end, np.searchsorted(off[1:], start, side="right")


def segment_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of data[start:end]; segments are in order and do not overlap; empty ones hash to a constant."""
    out = np.zeros(len(start), dtype=np.uint64)
    length = end - start
    some = np.flatnonzero(length > 0)
    if len(some):
        s, n = start[some], length[some]
        first = np.zeros(len(n) + 1, dtype=np.int64)
        np.cumsum(n, out=first[1:])
        within = np.arange(first[-1]) - np.repeat(first[:-1], n)
        value = (_BYTE_LOW if lower else _BYTE)[data[within + np.repeat(s, n)]]
        value *= _powers(int(n.max()))[within]
        out[some] = np.add.reduceat(value, first[:-1])
    return _spread(out + length.astype(np.uint64))


def lines(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each \\n-split line; every row has one at least."""
    cuts = np.flatnonzero(data == 10)
    start = np.concatenate([off[:-1], cuts + 1])
    row = np.concatenate([np.arange(len(off) - 1), np.searchsorted(off[1:], cuts, side="right")])
    order = np.lexsort((start, row))
    start, row = start[order], row[order]
    end = np.empty(len(start), dtype=np.int64)
    last = np.ones(len(start), dtype=bool)
    last[:-1] = row[1:] != row[:-1]
    end[last] = off[1:][row[last]]
    keep = np.flatnonzero(~last)
    end[keep] = start[keep + 1] - 1
    return start, end, row


_MULT = np.uint64(0xD6E8FEB86659FD93)


def windows(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word and the hash of each n-word window that stays within its row."""
    if len(hashes) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :])
    value = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
    for k in range(n):
        value = value * _MULT + hashes[k : len(hashes) - n + 1 + k]
    return first, _spread(value[first])


def salted(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Hashes that differ between rows, for grouping within rows by one sort."""
    return _spread(hashes + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether it occurs twice or more, and whether this is not its first place."""
    if not len(keys):
        z = np.zeros(0, dtype=bool)
        return z, z
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = np.zeros(len(k), dtype=bool)
    same[1:] = k[1:] == k[:-1]
    twice = same.copy()
    twice[:-1] |= same[1:]
    a, b = np.empty(len(k), dtype=bool), np.empty(len(k), dtype=bool)
    a[order], b[order] = twice, same
    return a, b


def covered(first: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of `total` words lie in one of the n-word windows that begin at `first`."""
    step = np.zeros(total + 1, dtype=np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, np.minimum(first + n, total), -1)
    return np.cumsum(step[:-1]) > 0
