"""Words and word shingles of many texts at once, as 64-bit values.

A word is a maximal run of bytes other than space and 0x09-0x0D, with A-Z folded
to a-z.  A shingle is ``width`` consecutive words; a text with fewer words has
one shingle, the whole sequence; a text without words has none.  Everything is
computed on UTF-8 buffers with numpy, block by block, so that memory follows
the block size and not the length of a text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(977))
_BYTE = _rng.integers(1, 2**63, 256, dtype=_U) * _U(2) + _U(1)
_BYTE[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15
_SLOT = _rng.integers(1, 2**63, 16, dtype=_U) * _U(2) + _U(1)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> _U(31))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if len(_powers.get("up", ())) < n:
        size = max(n, BLOCK + 1024)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=_U)
    return _powers["up"], _powers["down"]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null is empty."""
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def _cuts(data: np.ndarray, offsets: np.ndarray):
    """(first row, last row, start, end) of blocks of about BLOCK bytes, cut at rows or separators."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + BLOCK, "right")) - 1
        if end > row:
            yield row, end, int(offsets[row]), int(offsets[end])
            row = end
            continue
        at, stop = int(offsets[row]), int(offsets[row + 1])
        while at < stop:
            to = min(stop, at + BLOCK)
            while to < stop:
                gap = np.flatnonzero(_SEPARATOR[data[at + 1 : to]])
                if len(gap):
                    to = at + 1 + int(gap[-1])
                    break
                to = min(stop, to + BLOCK)
            yield row, row + 1, at, to
            at = to
        row += 1


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words in order, and the number of words of each row."""
    data, offsets = utf8(column)
    found, counts = [], np.zeros(len(offsets) - 1, np.int64)
    for first, last, start, end in _cuts(data, offsets):
        b = data[start:end]
        if not len(b):
            continue
        inside = np.zeros(len(b) + 2, bool)
        inside[1:-1] = ~_SEPARATOR[b]
        rows = offsets[first + 1 : last] - start
        rows = rows[(rows > 0) & (rows < len(b))]
        begins = inside[1:-1] & ~inside[:-2]
        begins[rows] = inside[1 + rows]
        ends = inside[1:-1] & ~inside[2:]
        ends[rows - 1] = inside[rows]
        s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        up, down = powers(len(b))
        total = np.zeros(len(b) + 1, _U)
        np.cumsum(_BYTE[b] * up[: len(b)], out=total[1:])
        found.append(mix((total[e] - total[s]) * down[s] + (e - s).astype(_U)))
        counts[first:last] += np.diff(np.searchsorted(s, np.clip(offsets[first : last + 1] - start, 0, len(b))))
    return (np.concatenate(found) if found else np.zeros(0, _U)), counts


def shingles(column: pa.Array, width: int = 5):
    """For each row its distinct shingles, ascending, as an unsigned 64-bit array."""
    w, counts = words(column)
    padded = np.concatenate([w, np.zeros(width, _U)])
    n = len(w)
    whole = np.zeros(n, _U)
    for j in range(width):
        whole += padded[j : j + n] * _SLOT[j]
    whole = mix(whole + _U(width))
    at = 0
    for c in counts.tolist():
        if c >= width:
            yield np.unique(whole[at : at + c - width + 1])
        elif c:
            yield mix((w[at : at + c] * _SLOT[:c]).sum(dtype=_U, keepdims=True) + _U(c))
        else:
            yield np.zeros(0, _U)
        at += c
