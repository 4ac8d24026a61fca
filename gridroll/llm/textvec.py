"""Vectorised byte work on Arrow string columns: words, word hashes, shingles."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: White space of the word definition: space and the ASCII controls 9 to 13.
BLANKS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``batches``, after which the worker, which serves further tasks, gives unused memory back to the system."""
    yield from batches
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def odd_constants(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd 64-bit numbers."""
    return mix64(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


_BYTE = odd_constants(256, 11)
_STEP = 0x9E3779B97F4A7C15 | 1
_powers = np.ones(1, U64)


def powers(n: int) -> np.ndarray:
    """_STEP ** 0 .. n-1 modulo 2 ** 64."""
    global _powers
    if len(_powers) < n:
        p = np.full(max(n, 4096), _STEP, U64)
        p[0] = 1
        _powers = np.multiply.accumulate(p)
    return _powers


def flat(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and the n + 1 offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    a = pc.fill_null(col.cast(pa.large_string()), "")
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    if not len(a) or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(len(a) + 1, np.int64)
    return np.frombuffer(a.buffers()[2], np.uint8)[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str, target: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that no part has much more text than ``target`` bytes (a longer text is alone)."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, base + target, side="right")))
        yield batch.slice(at, to - at)
        at = to


def words(data: np.ndarray, off: np.ndarray, blanks: tuple[int, ...] = BLANKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the n + 1 offsets of each text's words among them. No word spans two texts."""
    n = len(off) - 1
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    lut = np.ones(256, bool)
    lut[list(blanks)] = False
    solid = lut[data]
    first = np.zeros(len(data), bool)
    first[off[:-1][off[:-1] < len(data)]] = True
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | first[1:]
    starts = np.flatnonzero(begin)
    end = solid
    last = np.empty(len(data), bool)
    last[:-1] = ~solid[1:] | first[1:]
    last[-1] = True
    ends = np.flatnonzero(end & last) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes; ``lower`` folds A-Z."""
    if not len(starts):
        return np.zeros(0, U64)
    table = _BYTE.copy()
    if lower:
        table[65:91] = table[97:123]
    size = ends - starts
    # the bytes of the words alone, end to end
    base = np.cumsum(size) - size
    rel = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(base, size)
    v = table[data[rel + np.repeat(starts, size)]]
    v *= powers(int(size.max()))[rel]
    return mix64(np.add.reduceat(v, base) + size.astype(U64))


def shingles(w: np.ndarray, off: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words of each text, and the offsets by text; a text of fewer words gives one of them all, an empty one none."""
    n = len(off) - 1
    count = np.diff(off)
    each = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    out = np.concatenate([[0], np.cumsum(each)])
    c = odd_constants(k, 77)
    rolled = np.zeros(max(0, len(w) - k + 1), U64)
    for j in range(k):
        rolled += w[j : j + len(rolled)] * c[j]
    rolled = mix64(rolled)
    h = np.zeros(int(out[-1]), U64)
    full = np.flatnonzero(count >= k)
    if len(full):
        m = each[full]
        rel = np.arange(int(m.sum()), dtype=np.int64) - np.repeat(np.cumsum(m) - m, m)
        h[rel + np.repeat(out[full], m)] = rolled[rel + np.repeat(off[full], m)]
    for i in np.flatnonzero((count > 0) & (count < k)):
        part = w[off[i] : off[i + 1]]
        h[out[i]] = mix64((part * c[: len(part)]).sum(dtype=U64, keepdims=True) + np.array([len(part)], U64) * U64(0xD1342543DE82EF95))[0]
    return h, out


def distinct_by_text(h: np.ndarray, off: np.ndarray) -> Iterator[np.ndarray]:
    """For each text its sorted distinct hashes."""
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        s = h[a:b]
        if b - a > 1:
            s = np.sort(s)
            s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        yield s
