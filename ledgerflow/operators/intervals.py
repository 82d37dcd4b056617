"""Half-open intervals in microseconds: splitting at midnight, overlaps, transitions and daily totals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400_000_000
HOUR = 3_600_000_000


def split_at_midnight(df: DataFrame, start: str, end: str) -> DataFrame:
    """One row for each UTC day that an interval touches, with ``day`` and the part's bounds; empty parts are left out."""
    first, last = F.floor(F.col(start) / DAY), F.floor((F.col(end) - 1) / DAY)
    days = df.withColumn("_d", F.explode(F.when(F.col(end) > F.col(start), F.sequence(first, last))))
    part_start, part_end = F.greatest(F.col(start), F.col("_d") * DAY), F.least(F.col(end), (F.col("_d") + 1) * DAY)
    return days.withColumn("day", F.date_add(F.lit("1970-01-01").cast("date"), F.col("_d").cast("int"))).withColumn("part_start", part_start).withColumn("part_end", part_end).drop("_d")


def date_span(df: DataFrame, start: str, end: str) -> DataFrame:
    """First and last UTC day of an interval and how many there are."""
    day = lambda c: F.date_add(F.lit("1970-01-01").cast("date"), F.floor(c / DAY).cast("int"))
    first, last = day(F.col(start)), day(F.greatest(F.col(end) - 1, F.col(start)))
    return df.withColumns({"first_day": first, "last_day": last, "n_days": F.datediff(last, first) + 1})


def overlap_pairs(a: DataFrame, b: DataFrame, keys: list[str], a_span: tuple[str, str], b_span: tuple[str, str], margin: int = 0, closed: bool = True, bin: int | None = None) -> DataFrame:
    """Pairs of rows with equal keys whose spans overlap, the second widened by a margin.

    With ``bin`` both sides are dealt by the bins that their spans touch, so a hot
    key is spread; a pair is kept in the first bin that both touch.
    """
    a0, a1 = (F.col(c) for c in a_span)
    b0, b1 = F.col(b_span[0]) - margin, F.col(b_span[1]) + margin
    touch = (a0 <= b1) & (a1 >= b0) if closed else (a0 < b1) & (a1 > b0)
    if bin is None:
        return a.join(b, keys).filter(touch)
    left = a.withColumn("_bin", F.explode(F.sequence(F.floor(a0 / bin), F.floor(a1 / bin))))
    right = b.withColumn("_bin", F.explode(F.sequence(F.floor(b0 / bin), F.floor(b1 / bin))))
    return left.join(right, [*keys, "_bin"]).filter(touch & (F.col("_bin") == F.greatest(F.floor(a0 / bin), F.floor(b0 / bin)))).drop("_bin")


def least_touching(a: DataFrame, b: DataFrame, keys: list[str], a_span: tuple[str, str], b_span: tuple[str, str], of: list[str], order: list[str], k: int = 1, margin: int = 0, bin: int = DAY) -> DataFrame:
    """For each ``of`` of the rows of ``a`` the first ``k`` distinct ``order`` of the rows of ``b`` with equal keys that touch it: of, least (an array of structs).

    Spans are closed whole numbers, the second widened by a margin; who touches
    none has no row.  No pairs are made: both sides are dealt by the bins that
    their spans touch, and in a bin the spans of ``b`` that begin by the end of one
    of ``a`` are an opening stretch of them, so at most one block of each power of
    two.  In each block, ordered by end, the least of those from an end on are
    known beforehand.  Time is n log n squared and memory n for the rows of a bin,
    which must fit in a task.  ``order`` must not be null.
    """
    a0, a1, b0, b1 = F.col(a_span[0]), F.col(a_span[1]), F.col(b_span[0]) - margin, F.col(b_span[1]) + margin
    dealt = lambda df, names, s, e: df.select(*[F.col(c).alias(f"_key{i}") for i, c in enumerate(keys)], *[F.col(c).alias(c) for c in names], s.cast("long").alias("_s"), e.cast("long").alias("_e")).filter("_s is not null and _e is not null").withColumn("_bin", F.explode(F.sequence(F.floor(F.least("_s", "_e") / bin), F.floor(F.greatest("_s", "_e") / bin))))
    left, right = dealt(a, of, a0, a1), dealt(b, order, b0, b1)

    def answer(asks, gives):
        taken = lambda df, c, at: pd.Series(x := df[c].to_numpy()[at], dtype=x.dtype)
        if not len(asks) or not len(gives):
            return pd.DataFrame({c: taken(df, c, np.zeros(0, int)) for df, names in ((asks, of), (gives, order)) for c in names})
        none = np.iinfo(np.int64).max
        names = gives[order].drop_duplicates().sort_values(order, ignore_index=True)
        rank = gives.groupby(order).ngroup().to_numpy().astype(np.int64)
        begin, end = gives["_s"].to_numpy(), gives["_e"].to_numpy()
        by = np.argsort(begin, kind="stable")
        begin, end, rank = begin[by], end[by], rank[by]
        upto = np.searchsorted(begin, asks["_e"].to_numpy(), "right")
        ends, place = np.unique(end, return_inverse=True)
        need = np.searchsorted(ends, asks["_s"].to_numpy())
        least = np.full((len(asks), k), none)
        for level in range(len(begin).bit_length()):
            some = np.flatnonzero(upto >> level & 1)
            blocks, block = len(begin) >> level, (upto[some] >> level) - 1
            inside = np.arange(blocks << level)
            key = (inside >> level) * (len(ends) + 1) + place[inside]
            by = np.argsort(key, kind="stable")
            found = np.searchsorted(key[by], block * (len(ends) + 1) + need[some])
            hit = found < block + 1 << level
            some, found, got = some[hit], found[hit], [least[some[hit]]]
            x = rank[by].reshape(blocks, 1 << level)[:, ::-1]
            for _ in range(k):
                low = np.minimum.accumulate(x, axis=1)
                got.append(low[:, ::-1].ravel()[found, None])
                before = np.concatenate([np.full((blocks, 1), none), low[:, :-1]], axis=1)
                x = np.where(x == before, none, np.maximum(x, before))
            all_ = np.sort(np.concatenate(got, axis=1), axis=1)
            all_[:, 1:][all_[:, 1:] == all_[:, :-1]] = none
            least[some] = np.sort(all_, axis=1)[:, :k]
        row, at = np.nonzero(least < none)
        return pd.DataFrame({c: taken(asks, c, row) for c in of} | {c: taken(names, c, least[row, at]) for c in order})

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for df, names in ((a, of), (b, order)) for c in names)
    place = [*(f"_key{i}" for i in range(len(keys))), "_bin"]
    some = left.groupBy(*place).cogroup(right.groupBy(*place)).applyInPandas(answer, kinds)
    return some.groupBy(*of).agg(F.slice(F.array_sort(F.collect_set(F.struct(*order))), 1, k).alias("least"))


def flag_overlaps(df: DataFrame, lane: str, start: str, end: str, id: str, bin: int = HOUR) -> DataFrame:
    """Adds ``overlaps``: whether another interval of the lane shares time with it (half-open).

    Intervals are dealt by the bins that they touch, so a hot lane is spread; in
    a bin, ordered by start, one overlaps an earlier one if the latest end so far
    lies after its start, and a later one if the next start lies before its end.
    No pairs are made.  Ids are unique.
    """
    spans = df.select(lane, F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(id).alias("_i")).filter("_e > _s")
    dealt = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_s") / bin), F.floor((F.col("_e") - 1) / bin))))
    w = Window.partitionBy(lane, "_bin").orderBy("_s", "_i")
    earlier = F.max("_e").over(w.rowsBetween(Window.unboundedPreceding, -1)) > F.col("_s")
    seen = dealt.withColumn("_hit", F.coalesce(earlier, F.lit(False)) | F.coalesce(F.lead("_s").over(w) < F.col("_e"), F.lit(False)))
    hit = seen.filter("_hit").select(F.col("_i").alias(id)).distinct()
    return df.join(hit.withColumn("overlaps", F.lit(True)), id, "left").withColumn("overlaps", F.coalesce("overlaps", F.lit(False)))


def transitions(df: DataFrame, day: str, entity: str, order: list[str], bin: int = HOUR // 6) -> DataFrame:
    """By day and entity, how often the day's work came to it from another entity.

    A day is cut into bins of its first order column, so that a day that holds most
    of the rows is spread.  Inside a bin each row is held against the one before;
    a bin's first row is stitched to the last row of the nearest bin of the day
    before it that isn't empty.
    """
    dealt = df.withColumn("_bin", F.floor(F.col(order[0]) / bin))
    inside = dealt.withColumn("_from", F.lag(entity).over(Window.partitionBy(day, "_bin").orderBy(*order))).select(day, entity, "_from")
    place = F.struct(*order)
    ends = dealt.groupBy(day, "_bin").agg(F.min_by(entity, place).alias(entity), F.max_by(entity, place).alias("_last"))
    stitched = ends.withColumn("_from", F.lag("_last").over(Window.partitionBy(day).orderBy("_bin"))).select(day, entity, "_from")
    moved = inside.unionByName(stitched).filter(F.col("_from").isNotNull() & (F.col("_from") != F.col(entity)))
    return moved.groupBy(day, entity).agg(F.count(F.lit(1)).alias("transitions_in"))


def attention_days(parts: DataFrame, entity: str, mode: str, modes: list[str], order: list[str]) -> DataFrame:
    """By day and entity: microseconds, parts, a struct of microseconds by mode, and transitions into it."""
    size = F.col("part_end") - F.col("part_start")
    by_mode: list[Column] = [F.coalesce(F.sum(F.when(F.col(mode) == m, size)), F.lit(0)).alias(m) for m in modes]
    totals = parts.groupBy("day", entity).agg(F.sum(size).alias("micros"), F.count(F.lit(1)).alias("n_parts"), *by_mode)
    moves = transitions(parts, "day", entity, order)
    return totals.join(moves, ["day", entity], "left").withColumn("transitions_in", F.coalesce("transitions_in", F.lit(0).cast("long")))


def withhold_open(days: DataFrame, open_intervals: DataFrame, start: str, now: int) -> DataFrame:
    """Days that no open interval touches between its start and now."""
    held = open_intervals.select(F.explode(F.sequence(F.floor(F.col(start) / DAY), F.floor(F.lit(now) / DAY))).alias("_d")).distinct()
    return days.join(held.select(F.date_add(F.lit("1970-01-01").cast("date"), F.col("_d").cast("int")).alias("day")), "day", "left_anti")
