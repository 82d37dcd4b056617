"""Document fingerprints by context-triggered piecewise hashing, compared by edit distance.

A rolling hash of the last seven bytes ends a piece wherever its low bits are all
ones; a piece's own hash gives one character.  With ``level`` such bits pieces are
about 2**level bytes long.  The level is chosen so that a text has 32 to 64
pieces if it can; texts of repeated passages may have only levels with many
more, and then keep all of them, so that a signature always spans the whole
text.  A fingerprint holds the signatures for that level and the next, so texts
of similar length can be compared at a common level.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jobs import Scratch, prepare
from .shingles import _BASE, _BYTE, BLOCK, mix, powers

WINDOW = 7
LONGEST = 64
COMMON = 7
LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)

_U = np.uint64
_ROLL = (_BYTE >> _U(32)).astype(np.uint32)
_STEP = np.uint32(0x01000193)
_ones = np.arange(1 << 16)
_TRAIL = np.zeros(1 << 16, np.uint8)
for _k in range(1, 17):
    _TRAIL[(_ones & ((1 << _k) - 1)) == (1 << _k) - 1] = _k


def _levels(b: np.ndarray) -> np.ndarray:
    """For each byte, the number of trailing one bits of the rolling hash there."""
    out = np.empty(len(b), np.uint8)
    for at in range(0, len(b), BLOCK):
        back = min(at, WINDOW - 1)
        v = _ROLL[b[at - back : at + BLOCK]]
        h = v.copy()
        for k in range(1, min(WINDOW, len(v))):
            v = v * _STEP
            h[k:] += v[: len(v) - k]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        low = h & np.uint32(0xFFFF)
        level = _TRAIL[low]
        full = low == 0xFFFF
        if full.any():
            level[full] += _TRAIL[h[full] >> np.uint32(16)]
        out[at : at + BLOCK] = level[back:]
    return out


def _totals(b: np.ndarray, ends: np.ndarray) -> list[int]:
    """Prefix sums of the polynomial hash at the given places, modulo 2**64."""
    out, total, scale = [], 0, 1
    for at in range(0, max(len(b), 1), BLOCK):
        some = b[at : at + BLOCK]
        up, _ = powers(len(some))
        sums = np.cumsum(_BYTE[some] * up[: len(some)], dtype=_U)
        out += [(total + scale * int(sums[e - at - 1])) % 2**64 for e in ends[(ends > at) & (ends <= at + len(some))].tolist()]
        if len(some):
            total = (total + scale * int(sums[-1])) % 2**64
        scale = scale * pow(_BASE, BLOCK, 2**64) % 2**64
    return out


def _signature(b: np.ndarray, levels: np.ndarray, level: int) -> str:
    ends = np.flatnonzero(levels >= level) + 1
    if not len(ends) or ends[-1] != len(b):
        ends = np.append(ends, len(b))
    totals = np.array([0, *_totals(b, ends)], _U)
    starts = np.append(0, ends[:-1])
    down = np.array([pow(pow(_BASE, -1, 2**64), int(s), 2**64) for s in starts], _U) if len(b) > BLOCK else powers(len(b) + 1)[1][starts]
    h = mix((totals[1:] - totals[:-1]) * down + (ends - starts).astype(_U))
    return LETTERS[(h >> _U(58)).astype(np.int64)].tobytes().decode()


def fingerprint(text: str | None) -> str:
    """``level:signature:signature of the next level``; a null or empty text has empty signatures."""
    b = np.frombuffer((text or "").encode(), np.uint8)
    if not len(b):
        return "0::"
    levels, level = _levels(b), 0
    while len(b) >> level > LONGEST:
        level += 1
    while level and np.count_nonzero(levels >= level) < LONGEST // 2:
        level -= 1
    return f"{level}:{_signature(b, levels, level)}:{_signature(b, levels, level + 1)}"


def _long_distance(x: bytes, y: bytes) -> int:
    """The edit distance of two signatures of any length, bit-parallel in whole numbers of as many bits."""
    n = min(len(x), len(y))
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    same = a[:n] == b[:n]
    first = n if same.all() else int(same.argmin())
    same = (a[len(a) - n :] == b[len(b) - n :])[::-1][: n - first]
    last = len(same) if same.all() else int(same.argmin())
    x, y = sorted((x[first : len(x) - last], y[first : len(y) - last]), key=len)
    if not x:
        return len(y)
    at = {c: int.from_bytes(np.packbits(np.frombuffer(x, np.uint8) == c, bitorder="little").tobytes(), "little") for c in set(x)}
    ones = (1 << len(x)) - 1
    high, up, down, score = 1 << (len(x) - 1), ones, 0, len(x)
    for c in y:
        eq = at.get(c, 0)
        v = eq | down
        h = (((eq & up) + up) ^ up) | eq
        plus, minus = down | (ones & ~(h | up)), up & h
        score += bool(plus & high) - bool(minus & high)
        plus, minus = (plus << 1 | 1) & ones, minus << 1 & ones
        up, down = minus | (ones & ~(v | plus)), plus & v
    return score


def edit_distances(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """Edit distances of pairs, bit-parallel; those of at most 64 characters side by side."""
    long = [i for i, (u, v) in enumerate(zip(x, y)) if max(len(u), len(v)) > LONGEST]
    if long:
        out, short = np.zeros(len(x), np.int64), sorted(set(range(len(x))) - set(long))
        out[short] = edit_distances([x[i] for i in short], [y[i] for i in short])
        out[long] = [_long_distance(x[i], y[i]) for i in long]
        return out
    n = len(x)
    m = np.fromiter(map(len, x), np.int64, n)
    k = np.fromiter(map(len, y), np.int64, n)
    a = np.frombuffer(b"".join(v.ljust(LONGEST, b"\0") for v in x), np.uint8).reshape(n, LONGEST)
    c = np.frombuffer(b"".join(v.ljust(LONGEST, b"\1") for v in y), np.uint8).reshape(n, LONGEST)
    up, down, score = np.full(n, ~_U(0)), np.zeros(n, _U), m.copy()
    high = _U(1) << np.maximum(m - 1, 0).astype(_U)
    for j in range(int(k.max(initial=0))):
        eq = np.packbits(a == c[:, j : j + 1], axis=1, bitorder="little").view(_U).reshape(n)
        v = eq | down
        h = (((eq & up) + up) ^ up) | eq
        plus, minus = down | ~(h | up), up & h
        live = j < k
        score += np.where(live & ((plus & high) != 0), 1, 0) - np.where(live & ((minus & high) != 0), 1, 0)
        plus, minus = (plus << _U(1)) | _U(1), minus << _U(1)
        up, down = minus | ~(v | plus), plus & v
    return np.where(m == 0, k, np.where(k == 0, m, score))


def _share(x: str, y: str) -> bool:
    """A common run of COMMON characters, or of a third of the shorter signature if it is short."""
    n = min(COMMON, max(1, min(len(x), len(y)) // 3))
    some = {x[i : i + n] for i in range(len(x) - n + 1)}
    return any(y[i : i + n] in some for i in range(len(y) - n + 1))


def likeness(x: list[str], y: list[str]) -> np.ndarray:
    """0 to 1 for pairs of fingerprints: 1 less the edit distance over the longer signature, at common levels.

    Equal fingerprints give 1; levels more than one apart, or signatures without
    a common run, give 0.
    """
    out = np.zeros(len(x))
    at, left, right = [], [], []
    for i, (f, g) in enumerate(zip(x, y)):
        if f == g:
            out[i] = 1.0
            continue
        a, a1, a2 = f.split(":")
        b, b1, b2 = g.split(":")
        gap = int(a) - int(b)
        for u, v in ((a1, b1), (a2, b2)) if gap == 0 else ((a1, b2),) if gap == 1 else ((a2, b1),) if gap == -1 else ():
            if u and v and _share(u, v):
                at.append(i)
                left.append(u)
                right.append(v)
    if at:
        d = edit_distances([u.encode() for u in left], [v.encode() for v in right])
        longest = np.fromiter((max(len(u), len(v)) for u, v in zip(left, right)), np.int64, len(at))
        np.maximum.at(out, np.array(at), np.minimum(1 - d / longest, 1 - 1e-6))
    return out


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as many first code points of the following text, or all it has."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


_RESULT = [("doc_id", None), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]


def _judge(rows: list[tuple]) -> list[list]:
    """Result columns for (doc_id, text, fingerprint, next text, next fingerprint)."""
    changed = [edited(t, following) for _, t, _, following, _ in rows]
    prints = [fingerprint(c) for c in changed]
    own = [r[2] for r in rows]
    return [[r[0] for r in rows], [len(r[1]) for r in rows], [hashlib.sha256(c.encode()).hexdigest() for c in changed], own, prints, likeness(own, prints).tolist(), likeness(own, [r[4] for r in rows]).tolist()]


def fingerprint_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of (doc_id, text), of texts edited with the next document's, and their likeness.

    The next document is that of the next lower doc_id, the highest following the
    lowest; rows with equal doc_id follow one another by text, null doc_ids come
    last.  A null text is empty.  Range partitions stream their rows in order; the
    one pair that spans two partitions is made afterwards from the first and last
    document of each, which are written once.
    """
    spark = docs.sparkSession
    prepare(spark)
    key = docs.schema["doc_id"].dataType.simpleString()
    names = [n for n, _ in _RESULT]
    results = f"doc_id {key}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("doc_id").desc_nulls_last()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(parts, order).sortWithinPartitions(order, "text")

    def batch(kind: pa.DataType, cols: list[list], part: int, end: str | None, texts: list) -> pa.RecordBatch:
        n = len(cols[0])
        arrays = [pa.array(c, t or kind) for c, (_, t) in zip(cols, _RESULT)]
        return pa.RecordBatch.from_arrays([*arrays, pa.array([part] * n, pa.int32()), pa.array([end] * n, pa.string()), pa.array(texts, pa.string())], [*names, "part", "end", "text"])

    def stream(batches):
        part, before, kind = TaskContext.get().partitionId(), None, None
        for b in batches:
            kind, ready = b.schema.field("doc_id").type, []
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()):
                f = fingerprint(text)
                if before:
                    ready.append((*before, text, f))
                else:
                    yield batch(kind, [[doc], [None], [None], [f], [None], [None], [None]], part, "head", [text])
                before = (doc, text, f)
            if ready:
                yield batch(kind, _judge(ready), part, None, [None] * len(ready))
        if before:
            yield batch(kind, [[before[0]], [None], [None], [before[2]], [None], [None], [None]], part, "tail", [before[1]])

    scratch = Scratch(spark, "fingerprints")
    first = scratch.save(rows.mapInArrow(stream, f"{results}, part int, end string, text string"), "first")
    heads = first.filter("end = 'head'").select("part", F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print"))
    held = sorted(r["part"] for r in heads.select("part").collect())
    follow = spark.createDataFrame(list(zip(held, held[1:] + held[:1])), "tail_part int, part int")
    tails = first.filter("end = 'tail'").select("doc_id", "text", "fingerprint", F.col("part").alias("tail_part"))
    pairs = tails.join(F.broadcast(follow), "tail_part").join(heads, "part").select("doc_id", "text", "fingerprint", "next_text", "next_print")

    def finish(batches):
        for b in batches:
            if len(b):
                cols = _judge(list(zip(*(b[c].to_pylist() for c in b.schema.names))))
                yield pa.RecordBatch.from_arrays([pa.array(c, t or b.schema.field("doc_id").type) for c, (_, t) in zip(cols, _RESULT)], names)

    return first.filter("end is null").select(*names).unionByName(pairs.mapInArrow(finish, results))
