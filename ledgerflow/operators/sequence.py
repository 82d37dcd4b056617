"""Operators over ordered rows: carrying forward, differences, matching, durations, gaps, trends and windows of days.

Windows are always partitioned by the given keys, and where a key can be hot by
blocks of it too; a single ordered partition is used only after an aggregation
has made the rows few (days, windows).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .statistics import order_statistics, with_statistics


def _window(keys, order):
    return Window.partitionBy(*keys).orderBy(*order)


def _entering(blocks: DataFrame, df: DataFrame, keys: list[str], block: str) -> DataFrame:
    """The rows with what their block's summary says; keys may be null."""
    same = reduce(lambda x, y: x & y, [F.col(f"_rows.{c}").eqNullSafe(F.col(f"_blocks.{c}")) for c in [*keys, block]])
    return df.alias("_rows").join(blocks.alias("_blocks"), same, "left").select("_rows.*", "_blocks._in")


def carry_forward(df: DataFrame, keys: list[str], order: list[str], cols: list[str], block: str | None = None) -> DataFrame:
    """Nulls in ``cols`` become the last value seen before them in the key.

    With ``block``, a column that never falls in that order, no window holds a
    whole key: each block of a key is summed up by its last values, the summaries,
    one row for each block, are carried over the key, and what enters a block is
    applied inside it.  The largest task then holds one block.
    """
    if block is None:
        w = _window(keys, order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})
    lasts = [F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in cols]
    before = _window(keys, [block]).rowsBetween(Window.unboundedPreceding, -1)
    blocks = df.groupBy(*keys, block).agg(*lasts).select(*keys, block, F.struct(*[F.last(c, ignorenulls=True).over(before).alias(c) for c in cols]).alias("_in"))
    inside = _window([*keys, block], order).rowsBetween(Window.unboundedPreceding, 0)
    return _entering(blocks, df, keys, block).withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(inside), F.col(f"_in.{c}")) for c in cols}).drop("_in")


def cumulative_delta(df: DataFrame, keys: list[str], order: list[str], cols: list[str], suffix: str = "_delta", block: str | None = None) -> DataFrame:
    """Growth of running totals since the row before, never negative; the first row counts from 0.

    ``block`` cuts keys as in ``carry_forward``: a block's summary is its last row,
    and its first row is held against that of the block before.
    """
    if block is None:
        w = _window(keys, order)
        return df.withColumns({c + suffix: F.greatest(F.col(c) - F.lag(c, 1, 0).over(w), F.lit(0)) for c in cols})
    last = df.groupBy(*keys, block).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_last"))
    blocks = last.select(*keys, block, F.lag("_last").over(_window(keys, [block])).alias("_in"))
    inside = _window([*keys, block], order)
    entered = _entering(blocks, df, keys, block).withColumn("_first", F.row_number().over(inside) == 1)
    start = lambda c: F.when(F.col("_in").isNull(), F.lit(0)).otherwise(F.col(f"_in.{c}"))
    grown = entered.withColumns({c + suffix: F.greatest(F.col(c) - F.when(F.col("_first"), start(c)).otherwise(F.lag(c).over(inside)), F.lit(0)) for c in cols})
    return grown.drop("_in", "_first")


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(_window(keys, order))).filter("_n = 1").drop("_n")


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return keep_first(df, keys, [F.col(c).desc() for c in order])


def dedup_events(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row of each event that several files hold: that of the lowest order."""
    return keep_first(df, [key], order)


def previous_mark(df: DataFrame, keys: list[str], order: list[str], pos: str, default: int = 0) -> DataFrame:
    return df.withColumn("previous", F.lag(pos, 1, default).over(_window(keys, order)))


def match_fifo(df: DataFrame, keys: list[str], order: list[str], kind: str, opens: str, closes: str, at: str) -> DataFrame:
    """The k-th matched close with the k-th open of a key, as a queue would pair them.

    With S the running count of opens less closes, a close is unmatched exactly
    when S reaches a new minimum below 0 there.  Returns the keys, pair,
    opened_at and closed_at; opens that are never closed have null closed_at.
    """
    rows = df.filter(F.col(kind).isin(opens, closes))
    w = _window(keys, order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_s", F.sum(F.when(F.col(kind) == opens, 1).otherwise(-1)).over(upto))
    rows = rows.withColumn("_lost", (F.col(kind) == closes) & (F.col("_s") < F.least(F.coalesce(F.min("_s").over(before), F.lit(0)), F.lit(0))))
    rows = rows.filter(~F.col("_lost")).withColumn("pair", F.sum(F.lit(1)).over(Window.partitionBy(*keys, kind).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "pair").agg(F.max(F.when(F.col(kind) == opens, F.col(at))).alias("opened_at"), F.max(F.when(F.col(kind) == closes, F.col(at))).alias("closed_at"))


def elapsed_to_terminal(df: DataFrame, key: str, at: str, kind: str, terminals: list[str], cap: int) -> DataFrame:
    """Seconds from a key's first event to its first terminal one, within 0..cap; null without one."""
    end = F.min(F.when(F.col(kind).isin(*terminals), F.col(at)))
    g = df.groupBy(key).agg(F.min(at).alias("first_at"), end.alias("end_at"))
    s = F.col("end_at") - F.col("first_at")
    return g.select(key, F.least(F.greatest(s, F.lit(0)), F.lit(cap)).alias("seconds"), F.coalesce(s > cap, F.lit(False)).alias("clamped"))


def gap_since_previous(df: DataFrame, key: str, order: list[str], at: str, kind: str, only: str, below: int) -> DataFrame:
    """Seconds since the key's event before, for events of one kind, if 0 <= gap < below."""
    g = df.withColumn("gap", F.col(at) - F.lag(at).over(_window([key], order)))
    return g.filter((F.col(kind) == only) & (F.col("gap") >= 0) & (F.col("gap") < below))


def phase_durations(df: DataFrame, key: str, order: list[str], at: str, phase: Column, ends: dict[str, Column], stop: Column) -> DataFrame:
    """Seconds by phase of a key.

    ``phase`` names the phase that a row opens (null: none).  A phase ends at the
    next opener, at the next row for which ``ends[phase]`` holds, or at the key's
    first ``stop`` row, whichever is first; without any it counts nothing.
    """
    w = _window([key], order)
    after = w.rowsBetween(1, Window.unboundedFollowing)
    rows = df.withColumn("_phase", phase).withColumn("_stop", F.min(F.when(stop, F.col(at))).over(Window.partitionBy(key)))
    nexts = {p: F.first(F.when(c, F.col(at)), ignorenulls=True).over(after) for p, c in ends.items()}
    opener = F.first(F.when(F.col("_phase").isNotNull(), F.col(at)), ignorenulls=True).over(after)
    own = F.lit(None).cast("long")
    for p, c in nexts.items():
        own = F.when(F.col("_phase") == p, c).otherwise(own)
    rows = rows.withColumn("_end", F.least(opener, own, F.col("_stop")))
    live = rows.filter(F.col("_phase").isNotNull() & F.col("_end").isNotNull() & (F.col("_end") >= F.col(at)))
    return live.groupBy(key, F.col("_phase").alias("phase")).agg(F.sum(F.col("_end") - F.col(at)).alias("seconds"), F.count(F.lit(1)).alias("parts"))


def _all_gaps(df: DataFrame, keys: list[str], at: str, every: int, limit: int, now: int) -> DataFrame:
    w = _window(keys, [at])
    closed = df.select(*keys, at).distinct().withColumn("since", F.lag(at).over(w)).withColumn("gap", F.col(at) - F.col("since")).filter(F.col("gap") > limit)
    closed = closed.select(*keys, "since", "gap", F.greatest(F.lit(1), F.floor(F.col("gap") / every) - 1).alias("missed"), F.lit(False).alias("open"))
    last = df.groupBy(*keys).agg(F.max(at).alias("since")).withColumn("gap", F.lit(now) - F.col("since")).filter(F.col("gap") > limit)
    return closed.unionByName(last.select(*keys, "since", "gap", F.greatest(F.lit(1), F.floor(F.col("gap") / every)).alias("missed"), F.lit(True).alias("open")))


def cadence_gaps(df: DataFrame, keys: list[str], at: str, every: int, limit: int, now: int, most: int = 20) -> DataFrame:
    """Gaps between starts over ``limit`` seconds, and the open one up to now; the ``most`` last of each key.

    A gap missed max(1, floor(gap / every) - 1) starts, the open one max(1, floor(gap / every)).
    ``cadence_totals`` counts all gaps of a key.
    """
    ranked = _all_gaps(df, keys, at, every, limit, now).withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("since").desc())))
    return ranked.filter(F.col("n") <= most).drop("n")


def cadence_totals(df: DataFrame, keys: list[str], at: str, every: int, limit: int, now: int) -> DataFrame:
    """Of each key, over all its gaps as ``cadence_gaps`` defines them: how many, the starts missed and the longest; zeros without gaps."""
    found = _all_gaps(df, keys, at, every, limit, now).groupBy(*keys).agg(F.count(F.lit(1)).alias("gaps"), F.sum("missed").alias("missed"), F.max("gap").alias("longest"))
    rows = df.select(*keys).distinct().alias("k").join(found.alias("f"), F.expr(" and ".join(f"k.{k} <=> f.{k}" for k in keys)), "left")
    return rows.select(*[f"k.{k}" for k in keys], *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "missed", "longest")])


def bucket_series(days: DataFrame, keys: list[str], day: str, sums: list[str], median: str, n: int = 48) -> DataFrame:
    """At most n consecutive buckets of equally many days by key.

    ``days`` has a row for each raw value: its day, its sums and the value whose
    median is taken over all raw values of the bucket, not over daily medians.
    """
    each = days.select(*keys, day).distinct().withColumn("_i", F.row_number().over(_window(keys, [day])) - 1).withColumn("_all", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    width = F.ceil(F.col("_all") / n)
    places = each.select(*keys, day, F.floor(F.col("_i") / width).alias("bucket"))
    rows = days.join(places, [*keys, day])
    totals = rows.groupBy(*keys, "bucket").agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), *[F.sum(c).alias(c) for c in sums])
    return with_statistics(totals, order_statistics(rows, median, {"median": 0.5}, [*keys, "bucket"]), [*keys, "bucket"])


def bounds(spark, today: str, first: str, sizes: tuple[int, ...] = (7, 30, 90)) -> DataFrame:
    """(window_key, part, from_day, to_day) of the fixed windows up to today, those before them, and all days."""
    rows = []
    for n in sizes:
        rows.append(f"select '{n}' as window_key, 'current' as part, date_sub(date '{today}', {n - 1}) as from_day, date '{today}' as to_day")
        rows.append(f"select '{n}', 'prior', date_sub(date '{today}', {2 * n - 1}), date_sub(date '{today}', {n})")
    rows.append(f"select 'all', 'current', date '{first}', date '{today}'")
    return spark.sql(" union all ".join(rows))


def window_compare(df: DataFrame, day: str, windows: DataFrame, aggregates: dict[str, Column], coverage_from: str) -> DataFrame:
    """Each window's aggregates beside those of the one before; null unless the earlier lies inside the coverage."""
    hit = df.join(F.broadcast(windows), F.col(day).between(F.col("from_day"), F.col("to_day")))
    g = hit.groupBy("window_key", "part").agg(*[c.alias(k) for k, c in aggregates.items()])
    covered = windows.filter((F.col("part") == "prior") & (F.col("from_day") >= F.lit(coverage_from).cast("date"))).select("window_key", F.lit(True).alias("covered"))
    now = windows.filter("part = 'current'").select("window_key").join(g.filter("part = 'current'").drop("part"), "window_key", "left")
    before = g.filter("part = 'prior'").select("window_key", *[F.col(k).alias(f"prior_{k}") for k in aggregates])
    both = now.join(before, "window_key", "left").join(covered, "window_key", "left")
    return both.select("window_key", *aggregates, *[F.when(F.col("covered"), F.col(f"prior_{k}")).alias(f"prior_{k}") for k in aggregates])


def dropoff(df: DataFrame, entity: str, day: str, windows: DataFrame, coverage_from: str) -> DataFrame:
    """How many entities of the prior window are not in the current one; null unless the prior one is covered."""
    hit = df.join(F.broadcast(windows.filter("window_key <> 'all'")), F.col(day).between(F.col("from_day"), F.col("to_day")))
    seen = hit.groupBy("window_key", entity).agg(F.bool_or(F.col("part") == "prior").alias("was"), F.bool_or(F.col("part") == "current").alias("is"))
    gone = seen.groupBy("window_key").agg(F.count_if(F.col("was") & ~F.col("is")).alias("gone"))
    full = windows.filter("part = 'prior'").select("window_key", (F.col("from_day") >= F.lit(coverage_from).cast("date")).alias("covered"))
    return full.join(gone, "window_key", "left").select("window_key", F.when(F.col("covered"), F.coalesce("gone", F.lit(0))).alias("dropped"))


def staleness(df: DataFrame, keys: list[str], at: str, now: int, limit: int) -> DataFrame:
    """Seconds since a key's last event, and whether that is over the limit."""
    g = df.groupBy(*keys).agg(F.max(at).alias("last_at"))
    return g.withColumn("age", F.lit(now) - F.col("last_at")).withColumn("stalled", F.col("age") > limit)


def capacity_state(df: DataFrame, now: int, max_age: int) -> DataFrame:
    """State of quota observations (value, observed_at, resets_at, captured): the first rule that holds.

    An observation is stale from ``max_age`` on, and from its reset on unless it was made after it.
    """
    state = (
        F.when(F.col("value").isNull(), F.when(F.col("captured"), "unavailable").otherwise("error"))
        .when(F.col("observed_at") > now, "stale")
        .when(~F.col("captured"), "retained")
        .when((F.lit(now) - F.col("observed_at") >= max_age) | ((F.col("resets_at") <= now) & (F.col("observed_at") <= F.col("resets_at"))), "stale")
        .otherwise("available")
    )
    return df.withColumn("state", state)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
