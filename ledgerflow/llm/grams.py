"""Symbol histories of whole texts: each byte with the symbols before it, in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .shingles import _cuts, utf8


def histories(column: pa.Array, symbol: np.ndarray, n: int):
    """Yield (first row, last row, byte counts by row, [symbols, previous symbols, ...]).

    Before the start of a text stands symbol 0.  A long text comes in several
    blocks; its histories reach back over their borders.
    """
    data, offsets = utf8(column)
    for first, last, start, end in _cuts(data, offsets):
        if end == start:
            continue
        begin = int(offsets[first])
        back = min(n - 1, start - begin)
        s = symbol[data[start - back : end]]
        size = end - start
        at = np.clip(offsets[first : last + 1] - start, 0, size)
        rows = at[:-1] if start == begin else at[1:-1]
        out = [s[back:]]
        for k in range(1, n):
            p = np.zeros(size, s.dtype)
            if k <= back:
                p[:] = s[back - k : back - k + size]
            else:
                p[k - back :] = s[: size - (k - back)]
            for j in range(k):
                p[(x := rows + j)[x < size]] = 0
            out.append(p)
        yield first, last, np.diff(at), out


def sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The sum of the values of each row, rows having the given lengths."""
    total = np.zeros((len(lengths) + 1, *values.shape[1:]))
    some = np.flatnonzero(lengths)
    if len(some):
        starts = (np.cumsum(lengths) - lengths)[some]
        total[some] = np.add.reduceat(values, starts, axis=0)
    return total[:-1]
