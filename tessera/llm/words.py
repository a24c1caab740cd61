"""Hashes of all words of a batch at once, from the bytes of an Arrow column.

A word is a run of bytes other than ASCII white space; A-Z count as a-z. Its
hash is a polynomial over 64-bit values of its bytes, taken as a difference of
running sums, and mixed. No Python object is made for a text or a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that are hashed at once; a longer word is taken whole.
CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_CODE = np.random.default_rng(4099).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.random.default_rng(4111).integers(0, 2, 256, dtype=np.uint64)
_CODE[65:91] = _CODE[97:123]
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers: list[np.ndarray] = []


def mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``h``."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n``."""
    if not _powers or len(_powers[0]) < n:
        steps = [np.full(max(n, CHUNK + 1), b, np.uint64) for b in (_BASE, pow(_BASE, -1, 2**64))]
        for x in steps:
            x[0] = 1
        _powers[:] = [np.cumprod(x, dtype=np.uint64) for x in steps]
    return _powers[0], _powers[1]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and the size of each text; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.empty(0, np.uint8), np.empty(0, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return flat, np.diff(at)


def word_hashes(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts laid end to end, in order, and each text's number of words."""
    ends = np.cumsum(sizes)
    counts = np.zeros(len(sizes), np.int64)
    if not len(flat):
        return np.empty(0, np.uint64), counts
    inner = np.unique(ends[:-1])
    border = np.zeros(len(flat) + 1, bool)  # a text begins here
    border[inner] = True
    gap = _GAP[flat]
    out, a = [], 0
    while a < len(flat):
        b = min(a + CHUNK, len(flat))
        if b < len(flat):  # back to the last place where no word is cut, else on to the next
            back = np.flatnonzero(gap[a:b] | border[a + 1 : b + 1])
            if len(back):
                b = a + int(back[-1]) + 1
            else:
                on = np.flatnonzero(gap[b:] | border[b + 1 :])
                b = b + int(on[0]) + 1 if len(on) else len(flat)
        word = ~gap[a:b]
        starts = word.copy()
        starts[1:] &= gap[a : b - 1] | border[a + 1 : b]
        first = np.flatnonzero(starts)
        stops = word.copy()
        stops[:-1] &= gap[a + 1 : b] | border[a + 1 : b]
        last = np.flatnonzero(stops)
        up, down = power(b - a)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_CODE[flat[a:b]] * up[: b - a], out=sums[1:])
        out.append(mixed((sums[last + 1] - sums[first]) * down[first] + (last - first).astype(np.uint64)))
        counts += np.bincount(np.searchsorted(ends, a + first, side="right"), minlength=len(sizes))
        a = b
    return np.concatenate(out), counts
