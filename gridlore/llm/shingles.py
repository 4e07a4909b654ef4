"""Word and word-shingle hashes of many texts at once, in numpy.

Words are runs of bytes outside ``[\\x20\\x09-\\x0D]`` after A-Z is lower-cased.
A word's hash is a polynomial over random byte values, taken from running sums
and finished with a mixer; a shingle's hash combines those of its words.
"""

from __future__ import annotations

import numpy as np

_M = (1 << 64) - 1
_RNG = np.random.default_rng(20_240_229)
_VALUES = _RNG.integers(1, _M, 256, dtype=np.uint64)
_BASE = int(_RNG.integers(1, _M, dtype=np.uint64)) | 1
_POSITION = _RNG.integers(1, _M, 64, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWERED_VALUES = _VALUES[_LOWER]
_POWERS: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit numbers over all bits."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        base = np.full(size, _BASE, np.uint64)
        back = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        base[0] = back[0] = 1
        _POWERS[:] = [np.cumprod(base), np.cumprod(back)]
    return _POWERS[0][:n], _POWERS[1][:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and where each text's words begin.

    ``data`` holds the texts' UTF-8 bytes, text i from offsets[i] to offsets[i + 1].
    """
    n = len(data)
    if n == 0:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    solid = ~_BLANK[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | edge[1:n]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:n]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    up, down = _powers(n)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_LOWERED_VALUES[data] * up, out=sums[1:])
    words = (sums[last] - sums[first]) * down[first]
    words += (last - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(words), np.searchsorted(first, offsets)


def text_blocks(column, limit: int = 1 << 20):
    """Runs of an Arrow string column: (first row, bytes, offsets), about ``limit`` bytes each."""
    column = column.fill_null("")
    size = np.dtype("<i8" if str(column.type).startswith("large") else "<i4")
    buffers = column.buffers()
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(buffers[1], size)[column.offset: column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        stop = min(stop, n)
        yield row, data[offsets[row]: offsets[stop]], offsets[row: stop + 1] - offsets[row]
        row = stop


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, ascending.

    A text with fewer than ``width`` words has its whole sequence as the only
    shingle; one without words has none.
    """
    words, bounds = word_hashes(data, offsets)
    rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        rolled += words[k: k + len(rolled)] * _POSITION[k]
    rolled = mix(rolled)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a: b - width + 1]))
        elif b > a:
            few = (words[a:b] * _POSITION[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.array([few], np.uint64)))
        else:
            out.append(words[:0])
    return out
