"""Words of many texts at once, with the hashes of their prefixes.

A word is a maximal run of letters and digits (bytes above 127 with them, A-Z
folded) or of signs; in runs of characters of three or four bytes, which may
stand for scripts without spaces, it is every run of one to three characters
that starts at a character and is as long as it can be.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .shingles import _BYTE, _SEPARATOR, _cuts, mix, powers, utf8

#: Prefixes of up to this many characters are nodes of their own; the whole word follows them.
DEPTH = 12
#: Stands behind a whole word.
END = " "

_KIND = np.full(256, 2, np.uint8)
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1
_KIND[_SEPARATOR] = 0
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_ENDED = _BYTE[ord(END)]


def _spans(b: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of all words of a block of bytes; no word crosses the places ``rows``."""
    n = len(b)
    kind = _KIND[b]
    lead = (b & 0xC0) != 0x80
    kind[(b >= 128) & (b[np.maximum.accumulate(np.where(lead, np.arange(n), 0))] >= 0xE0)] = 3
    cut = np.ones(n + 1, bool)
    cut[1:n] = kind[1:] != kind[:-1]
    cut[rows[(rows >= 0) & (rows <= n)]] = True
    edges = np.flatnonzero(cut)
    s, e = edges[:-1], edges[1:]
    plain = (kind[s] > 0) & (kind[s] < 3)
    if not (kind == 3).any():
        return s[plain], e[plain]
    c = np.flatnonzero((kind == 3) & (lead | cut[:n]))
    ends = np.flatnonzero(cut | np.append(lead, True))
    third = ends[np.minimum(np.searchsorted(ends, c, "right") + 2, len(ends) - 1)]
    s, e = np.concatenate([s[plain], c]), np.concatenate([e[plain], np.minimum(third, edges[np.searchsorted(edges, c, "right")])])
    order = np.argsort(s, kind="stable")
    return s[order], e[order]


def words(column: pa.Array):
    """Yield (row, number, folded bytes, start, end, paths) block by block.

    ``row`` and ``number`` pair each text with each of its distinct words; the
    numbers point into the block's distinct words, given by ``start`` and ``end``
    in its bytes.  ``paths`` is a function that gives the hashes of the words'
    nodes, an array for each length of prefix and one for the whole words, 0 where
    there is none.  A word that a row's earlier block had is not given again.
    """
    data, offsets = utf8(column)
    seen, seen_row = np.zeros(0, np.uint64), -1
    for first, last, start, end in _cuts(data, offsets):
        b = data[start:end]
        if not len(b):
            continue
        at = offsets[first : last + 1] - start
        s, e = _spans(b, at)
        if not len(s):
            continue
        up, down = powers(len(b))
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_BYTE[b] * up[: len(b)], out=total[1:])
        whole = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        row = first + np.searchsorted(at, s, "right") - 1
        order = np.lexsort((whole, row))
        new = np.ones(len(order), bool)
        new[1:] = (row[order][1:] != row[order][:-1]) | (whole[order][1:] != whole[order][:-1])
        keep = order[new]
        if last == first + 1:
            if seen_row == first:
                keep = keep[~np.isin(whole[keep], seen)]
            else:
                seen, seen_row = np.zeros(0, np.uint64), first
            if end < int(offsets[first + 1]):
                seen = np.concatenate([seen, whole[keep]])
        if not len(keep):
            continue
        _, where, number = np.unique(whole[keep], return_index=True, return_inverse=True)
        s, e = s[keep][where], e[keep][where]

        def paths(b=b, s=s, e=e, total=total, down=down):
            starts = np.append(np.flatnonzero((b & 0xC0) != 0x80), len(b))
            c = np.searchsorted(starts, s)
            for k in range(1, DEPTH + 1):
                to = starts[np.minimum(c + k, len(starts) - 1)]
                there = (c + k < len(starts)) & (to <= e)
                yield np.where(there, mix((total[to] - total[s]) * down[s] + (to - s).astype(np.uint64)), np.uint64(0))
            size = (e - s).astype(np.uint64)
            yield mix((total[e] - total[s]) * down[s] + _ENDED * powers(int(size.max()) + 1)[0][size.astype(np.int64)] + size + np.uint64(1))

        yield row[keep], number, _FOLD[b], s, e, paths


def node_hashes(nodes: pa.Array) -> np.ndarray:
    """The hashes of nodes given as text, as ``paths`` has them."""
    data, offsets = utf8(nodes)
    out = np.zeros(len(nodes), np.uint64)
    for first, last, start, end in _cuts(data, offsets):
        if last - first > 1 or end - start == offsets[last] - offsets[first]:
            b = data[start:end]
            at = offsets[first : last + 1] - start
            up, down = powers(len(b) + 1)
            total = np.zeros(len(b) + 1, np.uint64)
            np.cumsum(_BYTE[b] * up[: len(b)], out=total[1:])
            s, e = at[:-1], at[1:]
            out[first:last] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
    return out
