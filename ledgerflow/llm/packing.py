"""Best-fit packing of documents into sequences of fixed length, by linear grouping.

Lengths are small integers, so the whole corpus is a histogram.  Large lengths
are sorted and cut into groups of equal cardinality, each rounded up to its
longest; a linear programme over configurations of these few sizes (columns made
by a knapsack) says how often to use each.  Actual lengths take the places of
the rounded ones, and what is left, with the small documents, goes best-fit into
the remaining room.  The plan is a list of runs: pieces of one length with ranks
in an interval go, one each, to consecutive sequences at one offset.  Its size
depends on the number of lengths, not of documents.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .jobs import Scratch, prepare, tidy
from .tokens import encoder

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 2048
END = 0
GROUPS = 96
SMALL = 8


def _linear_groups(lengths: list[int], counts: list[int], groups: int) -> list[list[list[int]]]:
    """Descending (length, count) runs, cut into groups of equal cardinality."""
    total = sum(counts)
    out, room = [[]], -(-total // groups)
    for length, n in zip(lengths, counts):
        while n:
            if not room:
                out.append([])
                room = -(-total // groups)
            take = min(n, room)
            out[-1].append([length, take])
            n, room = n - take, room - take
    return [g for g in out if g]


def _best_column(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of greatest value: a knapsack over the few sizes."""
    best = np.zeros(capacity + 1)
    took = np.zeros((len(sizes), capacity + 1), np.int16)
    for i, (size, value) in enumerate(zip(sizes.tolist(), values.tolist())):
        if value <= 1e-12:
            continue
        base = best.copy()
        for k in range(1, capacity // size + 1):
            with_k = base[: capacity + 1 - k * size] + k * value
            better = with_k > best[k * size :] + 1e-12
            best[k * size :][better] = with_k[better]
            took[i, k * size :][better] = k
    column, room = np.zeros(len(sizes), np.int64), int(best.argmax())
    value = float(best[room])
    for i in range(len(sizes) - 1, -1, -1):
        column[i] = took[i, room]
        room -= int(column[i]) * int(sizes[i])
    return value, column


def _configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations and whole numbers of uses, from the rounded-down optimum of the linear programme."""
    basis = np.diag(capacity // sizes).astype(float)
    for _ in range(4000):
        x = np.linalg.solve(basis, demand.astype(float))
        price = np.linalg.solve(basis.T, np.ones(len(sizes)))
        value, column = _best_column(sizes, price, capacity)
        if value <= 1 + 1e-9:
            break
        d = np.linalg.solve(basis, column.astype(float))
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(d > 1e-11, np.maximum(x, 0) / d, np.inf)
        leave = int(ratio.argmin())
        if not np.isfinite(ratio[leave]):
            break
        basis[:, leave] = column
    x = np.linalg.solve(basis, demand.astype(float))
    return [(basis[:, j].round().astype(np.int64), int(np.floor(x[j] + 1e-7))) for j in range(len(sizes)) if x[j] >= 1 - 1e-7]


def plan(histogram: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[tuple[int, ...], int]]:
    """Kinds of sequences, as (lengths, how many), for ``histogram[length]`` pieces of each length up to capacity.

    Of each configuration all lengths, or all but the shortest or the two
    shortest, are held for documents of their groups; the rest is room for the
    best fit.  The plan of fewest sequences is taken.
    """
    large = [int(n) for n in np.flatnonzero(histogram)[::-1] if capacity // SMALL < n < capacity]
    sizes: dict[int, list[list[int]]] = defaultdict(list)
    if large:
        for g in _linear_groups(large, [int(histogram[n]) for n in large], groups):
            sizes[g[0][0]] += g
    rounded = np.array(sorted(sizes, reverse=True), np.int64)
    demand = np.array([sum(n for _, n in sizes[int(s)]) for s in rounded], np.int64)
    uses = _configurations(rounded, demand, capacity) if large else []
    configurations = [([int(s) for s, k in zip(rounded, column) for _ in range(int(k))], n) for column, n in uses]
    return min((_substitute(histogram, capacity, sizes, configurations, open_places) for open_places in (0, 1, 2)), key=lambda kinds: sum(n for _, n in kinds))


def _substitute(histogram: np.ndarray, capacity: int, sizes: dict[int, list[list[int]]], configurations: list[tuple[list[int], int]], open_places: int) -> list[tuple[tuple[int, ...], int]]:
    """Actual lengths into the configurations' places, then the best fit of what is left, longest first."""
    kinds: list[tuple[tuple[int, ...], int]] = []
    left = histogram.astype(np.int64).copy()
    if left[capacity]:
        kinds.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    room: dict[int, list[list]] = defaultdict(list)
    merged = {s: [list(run) for run in runs] for s, runs in sizes.items()}
    for names, uses in configurations:
        names = names[: max(1, len(names) - open_places)]
        places = [merged[s] for s in names]
        uses = min([uses, *(sum(n for _, n in merged[s]) // names.count(s) for s in names)])
        taken = []
        for p in places:
            need, got = uses, []
            while need:
                take = min(need, p[0][1])
                got.append([p[0][0], take])
                p[0][1] -= take
                need -= take
                if not p[0][1]:
                    p.pop(0)
            for length, n in got:
                left[length] -= n
            taken.append(got)
        while taken and taken[0]:
            n = min(t[0][1] for t in taken)
            lengths = tuple(t[0][0] for t in taken)
            room[capacity - sum(lengths)].append([lengths, n])
            for t in taken:
                t[0][1] -= n
                if not t[0][1]:
                    t.pop(0)
    free = np.zeros(capacity + 1, bool)
    free[list(room)] = True
    for length in [int(n) for n in np.flatnonzero(left)[::-1]]:
        n = int(left[length])
        while n:
            fit = np.flatnonzero(free[length:])
            if not len(fit):
                each = capacity // length
                for per, k in ((each, n // each), (n % each, 1)):
                    if per and k:
                        room[capacity - per * length].append([(length,) * per, k])
                        free[capacity - per * length] = True
                break
            r = length + int(fit[0])
            kind = room[r][-1]
            take = min(n, kind[1])
            kind[1] -= take
            if not kind[1]:
                room[r].pop()
                free[r] = bool(room[r])
            room[r - length].append([(*kind[0], length), take])
            free[r - length] = True
            n -= take
    return kinds + [(lengths, n) for r in sorted(room) for lengths, n in room[r]]


def runs_of(kinds: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """Runs sorted by (length, first rank): length, first rank, first sequence, offset."""
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for lengths, n in kinds:
        offset = 0
        for length in lengths:
            rows.append((length, used[length], sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    rows.sort()
    return tuple(np.array(c, np.int64) for c in zip(*rows)) if rows else tuple(np.zeros(0, np.int64) for _ in range(4))


def pieces_of(docs: DataFrame, name: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """part, doc_id, piece, start, length, ids_crc32 and local (its number among the part's pieces of that length)."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        e, part, seen = encoder(name), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            doc, rows = [], []
            for i, text in enumerate(b["text"].to_pylist()):
                ids = np.append(e.encode(text), np.uint16(END)).astype("<u4")
                for k, start in enumerate(range(0, len(ids), capacity)):
                    some = ids[start : start + capacity]
                    doc.append(i)
                    rows.append((part, k, start, len(some), zlib.crc32(some.tobytes()), int(seen[len(some)])))
                    seen[len(some)] += 1
            cols = list(zip(*rows)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int32()), b["doc_id"].take(pa.array(doc, pa.int64())), *(pa.array(c, pa.int32()) for c in cols[1:2]), *(pa.array(c, pa.int64()) for c in cols[2:])],
                ["part", "doc_id", "piece", "start", "length", "ids_crc32", "local"],
            )

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"part int, doc_id {key}, piece int, start long, length long, ids_crc32 long, local long")


def pack(docs: DataFrame, name: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """Per piece of (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is empty: its only token is the end id.  Texts longer than the
    capacity are cut into pieces of it, the last possibly shorter.  Repeated rows
    are packed once each; other columns are ignored; no rows give no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "packing")
    pieces = scratch.save(pieces_of(docs, name, capacity), "pieces")
    counts = scratch.save(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():
        histogram[length] = n
    shared = spark.sparkContext.broadcast(runs_of(plan(histogram, capacity)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(firsts, ["part", "length"]).withColumn("rank", F.col("local") + F.col("before"))

    def run(batches):
        length, first, sequence, offset = shared.value
        keys = (length << 40) + first
        for b in batches:
            rank = b["rank"].to_numpy()
            at = np.searchsorted(keys, (b["length"].to_numpy() << 40) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*(b[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(tidy(run), f"doc_id {key}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
