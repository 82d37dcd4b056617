"""Rollups of usage, build logs, rounds, attention and observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .statistics import order_statistics, with_statistics

TOKENS = ["input_tokens", "cached_input_tokens", "output_tokens", "cache_write_5m_tokens", "cache_write_1h_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_output_tokens"]


def _sums(cols: list[str]) -> list[Column]:
    return [F.sum(c).alias(c) for c in cols]


def session_rollup(df: DataFrame, extra: list[str] = ()) -> DataFrame:
    """By vendor and session: tokens, times, models, first project and host in time order."""
    order = F.struct("ts", "event_id")
    return df.groupBy("vendor", "session_id").agg(
        *_sums([*TOKENS, *extra]), F.count(F.lit(1)).alias("observations"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.array_sort(F.collect_set("model")).alias("models"), F.min_by("project_id", order).alias("project_id"), F.min_by("host_os", order).alias("host_os"),
    )


def project_rollup(sessions: DataFrame, hosts: list[str], registered: Column) -> DataFrame:
    """By project: sessions, tokens, first time on each host, whether all sessions are registered."""
    return sessions.groupBy("project_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("input_tokens").alias("input_tokens"), *[F.min(F.when(F.col("host_os") == h, F.col("first_ts"))).alias(f"first_{h}") for h in hosts], F.bool_and(registered).alias("all_registered"))


def daily_rollup(df: DataFrame, extra: list[str] = ()) -> DataFrame:
    """By day, project, vendor and host: distinct sessions, tokens and other sums; rows without a day are left out."""
    return df.filter("day_utc is not null").groupBy("day_utc", "project_id", "vendor", "host_os").agg(F.count_distinct("session_id").alias("sessions"), *_sums([*TOKENS, *extra]))


def splits(df: DataFrame, sets: list[list[str]], sums: list[str]) -> DataFrame:
    """Sums for each set of columns in one pass; columns outside a set are null and ``set_id`` tells the sets apart."""
    cols = list(dict.fromkeys(c for s in sets for c in s))
    chosen = [[F.col(c) for c in s] for s in sets]
    return df.groupingSets(chosen, *cols).agg(F.grouping_id().alias("set_id"), F.count(F.lit(1)).alias("n"), *_sums(sums))


def dup_counts(df: DataFrame, key: str | Column) -> DataFrame:
    g = df.groupBy(key if isinstance(key, Column) else F.col(key)).agg(F.count(F.lit(1)).alias("_n"))
    return g.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("raw"), F.count(F.lit(1)).alias("distinct_keys")).select("raw", F.col("distinct_keys").alias("unique"), (F.col("raw") - F.col("distinct_keys")).alias("duplicates"))


def activity_hours(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys, F.weekday("ts").alias("weekday"), F.hour("ts").alias("hour_of_day")).agg(F.count(F.lit(1)).alias("n"))


def heatmap(df: DataFrame) -> DataFrame:
    """All 7 x 24 cells, zeros where nothing happened."""
    grid = df.sparkSession.range(168).select(F.expr("cast(id div 24 as int)").alias("weekday"), F.expr("cast(id % 24 as int)").alias("hour_of_day"))
    return grid.join(activity_hours(df, []), ["weekday", "hour_of_day"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def hour_slots(df: DataFrame) -> DataFrame:
    """By day an array of 24 counts."""
    return df.groupBy("day_utc").agg(*[F.count_if(F.hour("ts") == h).alias(f"_h{h}") for h in range(24)]).select("day_utc", F.array(*[f"_h{h}" for h in range(24)]).alias("slots"))


def event_days(log: DataFrame) -> DataFrame:
    k, s, x = F.col("kind"), F.col("state"), F.col("exit_code")
    return log.groupBy("day_utc").agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("row_id").alias("rows_touched"), F.count_if(k == "merged").alias("merges"), F.count_if(k == "proof").alias("proofs"),
        F.count_if((k == "proof") & (x != 0)).alias("failures"), F.count_if((k == "verdict") & (s == "DISPATCHED_ACCEPT")).alias("accepts"), F.count_if((k == "verdict") & (s == "DISPATCHED_REJECT")).alias("rejects"),
    )


def count_by(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def distribution(df: DataFrame, value: str, keys: list[str] = ()) -> DataFrame:
    """Count, least, quartiles, 95th percentile and greatest, with linear interpolation."""
    quartiles = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
    g = df.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("greatest"))
    return with_statistics(g, order_statistics(df, value, quartiles, keys), keys).select(*keys, "n", "least", *quartiles, "greatest")


def nested_counts(df: DataFrame, outer: str, inner: str) -> DataFrame:
    """By outer value a map from inner value to count."""
    g = df.groupBy(outer, inner).agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy(outer).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(inner, "n")))).alias("counts"))


def floor_adherence(df: DataFrame, levels: str, floor: str, keys: list[str]) -> DataFrame:
    """How many rows have all levels at the floor, of those that have any."""
    met = F.forall(levels, lambda x: x == floor)
    g = df.groupBy(*keys).agg(F.count_if(F.size(levels) > 0).alias("evaluated"), F.count_if(F.size(levels) == 0).alias("unverified"), F.count_if((F.size(levels) > 0) & met).alias("met"))
    return g.withColumn("rate", F.when(F.col("evaluated") > 0, F.floor(F.col("met") / F.col("evaluated") * 10000 + 0.5) / 10000))


def dense_daily(df: DataFrame, day: str, defaults: dict, to: str) -> DataFrame:
    """A row for each day from the first to ``to``; days without one get the defaults."""
    spine = df.agg(F.min(day).alias("_a")).select(F.explode(F.sequence("_a", F.lit(to).cast("date"))).alias(day))
    return spine.join(df, day, "left").select(day, *[F.coalesce(c, F.lit(v)).alias(c) for c, v in defaults.items()])


def merge_daily(series: dict[str, DataFrame], day: str, columns: dict[str, tuple[str, str, object]], to: str) -> DataFrame:
    """Many daily series as one row for each day, from the first day of any to the last one or ``to``.

    ``columns`` names for each column its series, how it is gathered (sum, or
    latest by the series' column ``at``) and its default on days without it.  All
    series go through one shuffle: a tagged union and one aggregation.  Rows
    without a day are left out.
    """
    tagged = None
    for name, df in series.items():
        own = [c for c, (s, _, _) in columns.items() if s == name]
        rows = df.filter(F.col(day).isNotNull()).select(F.col(day).cast("date").alias(day), F.lit(name).alias("_series"), *([F.col("at").alias("_at")] if "at" in df.columns else []), *own)
        tagged = rows if tagged is None else tagged.unionByName(rows, allowMissingColumns=True)
    mine = lambda s, c: F.when(F.col("_series") == s, F.col(c))
    gathered = [(F.sum(mine(s, c)) if how == "sum" else F.max_by(F.col(c), mine(s, "_at"))).alias(c) for c, (s, how, _) in columns.items()]
    g = tagged.groupBy(day).agg(*gathered)
    spine = g.agg(F.min(day).alias("_a"), F.greatest(F.max(day), F.lit(to).cast("date")).alias("_b")).filter("_a is not null").select(F.explode(F.sequence("_a", "_b")).alias(day))
    return spine.join(g, day, "left").select(day, *[F.coalesce(c, F.lit(d)).alias(c) if d is not None else F.col(c) for c, (_, _, d) in columns.items()])


def attribution_coverage(df: DataFrame, role_keys: list[str], tiers: list[str]) -> DataFrame:
    """Counts and money by role, a column for each tier."""
    return df.groupBy(*role_keys).agg(*[F.count_if(F.col("tier") == t).alias(f"n_{t}") for t in tiers], *[F.coalesce(F.sum(F.when(F.col("tier") == t, F.col("cents"))), F.lit(0)).alias(f"cents_{t}") for t in tiers])


def week_over_week(df: DataFrame, day: str, now: str, aggregates: dict[str, Column]) -> DataFrame:
    """Each aggregate of the last seven days and of the seven before, their difference, and why it is missing."""
    age = F.datediff(F.lit(now).cast("date"), F.col(day))
    rows = df.withColumn("_w", F.when(age.between(0, 6), "this").when(age.between(7, 13), "last")).filter("_w is not null")
    g = rows.groupBy("_w").agg(F.count(F.lit(1)).alias("_n"), *[c.cast("long").alias(k) for k, c in aggregates.items()])
    one = g.agg(*[F.max(F.when(F.col("_w") == w, F.col(c))).alias(f"{w}_{c}") for w in ("this", "last") for c in ["_n", *aggregates]])
    reason = F.when(F.col("this__n").isNull(), "nothing this week").when(F.col("last__n").isNull(), "nothing last week").otherwise("")
    return one.select(*[F.col(f"{w}_{k}") for k in aggregates for w in ("this", "last")], *[(F.col(f"this_{k}") - F.col(f"last_{k}")).alias(f"delta_{k}") for k in aggregates], reason.alias("reason"))


def measurement_days(df: DataFrame) -> DataFrame:
    """By day: observations, a map of counts for each source's status, the latest status, and the sources with gaps."""
    each = df.groupBy("day_utc", "source", "status").agg(F.count(F.lit(1)).alias("n"))
    maps = each.groupBy("day_utc").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat_ws(":", "source", "status").alias("k"), "n")))).alias("counts"), F.array_sort(F.collect_set(F.when(F.col("status") != "ok", F.col("source")))).alias("gaps"))
    latest = df.groupBy("day_utc").agg(F.count(F.lit(1)).alias("observations"), F.max_by("status", F.struct("ts", "event_id")).alias("latest"))
    return latest.join(maps, "day_utc")


def fold_observations(df: DataFrame, day: str, at: list[str]) -> DataFrame:
    """Measurement days: all observations of a day as maps of counts, its latest observation and that one's gaps.

    ``df`` has a row for each observation: ``day``, the columns ``at`` that order a day's
    observations, ``sources`` (name, status, skips by reason), ``vendors`` (name,
    quota, remaining and capture status), publish, doctor, cadence, missed and clock.
    Names are joined with colons in the keys: status_counts by source:status, skip_counts by source:reason,
    quota_counts by vendor:quota|remaining|capture:status, publish_counts and doctor_counts by status.
    A gap is a source that is neither ok nor disabled, a quota that is not available, a gap or
    missed starts in cadence, a skewed clock or a failed doctor.  A status that is null
    is never for publish, unavailable for quotas, not_applicable for captures, else unknown; rows without a day are left out.

    All counts go through one aggregation over (day, kind, key), combined before the
    shuffle, so a day with most rows is no task of its own.
    """
    said = lambda c, default: F.coalesce(c, F.lit(default))
    cell = lambda kind, n, *key: F.struct(F.lit(kind).alias("kind"), F.concat_ws(":", *key).alias("key"), F.coalesce(n, F.lit(0)).cast("long").alias("n"))
    one = F.lit(1)
    quota = lambda v: F.array(cell("quota", one, v["name"], F.lit("quota"), said(v["quota"], "unavailable")), cell("quota", one, v["name"], F.lit("remaining"), said(v["remaining"], "unavailable")), cell("quota", one, v["name"], F.lit("capture"), said(v["capture"], "not_applicable")))
    none = F.array().cast("array<struct<kind: string, key: string, n: bigint>>")
    cells = F.concat(
        F.coalesce(F.transform("sources", lambda s: cell("status", one, s["name"], said(s["status"], "unknown"))), none),
        F.coalesce(F.flatten(F.transform("sources", lambda s: F.coalesce(F.transform(F.map_entries(s["skips"]), lambda e: cell("skip", e["value"], s["name"], e["key"])), none))), none),
        F.coalesce(F.flatten(F.transform("vendors", quota)), none),
        F.array(cell("publish", one, said(F.col("publish"), "never")), cell("doctor", one, said(F.col("doctor"), "unknown"))),
    )
    rows = df.filter(F.col(day).isNotNull())
    counted = rows.select(day, F.explode(cells).alias("c")).groupBy(day, "c.kind", "c.key").agg(F.sum("c.n").alias("n"))
    of = lambda kind: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("key", "n"))))).alias(f"{kind}_counts")
    maps = counted.groupBy(day).agg(*[of(k) for k in ("status", "skip", "quota", "publish", "doctor")])
    bad = F.filter("sources", lambda s: ~said(s["status"], "unknown").isin("ok", "disabled"))
    short = F.filter("vendors", lambda v: said(v["quota"], "unavailable") != "available")
    when = lambda c, name: F.when(c, F.lit(name))
    empty = F.array().cast("array<string>")
    gaps = F.concat(
        F.coalesce(F.transform(bad, lambda s: F.concat_ws("_", F.lit("source"), s["name"], said(s["status"], "unknown"))), empty), F.coalesce(F.transform(short, lambda v: F.concat_ws("_", F.lit("quota"), v["name"], said(v["quota"], "unavailable"))), empty),
        F.array_compact(F.array(when((F.col("cadence") == "gap") | (F.col("missed") != 0), "collection_cadence_gap"), when(F.col("clock") == "clock_skew", "clock_skew"), when(F.col("doctor") == "fail", "doctor_failure"))),
    )
    last = F.max_by(F.struct(*at, "publish", "doctor", F.array_sort(F.array_distinct(gaps)).alias("gaps")), F.struct(*at))
    ends = rows.groupBy(day).agg(F.count(F.lit(1)).alias("observations"), F.min(at[0]).alias("first_at"), F.max(at[0]).alias("last_at"), last.alias("latest"))
    return ends.join(maps, day)


def quota_status(df: DataFrame, keys: list[str]) -> DataFrame:
    """The status of a provider and the least that remains of its windows.

    Retained if any window is, else available if any is, else stale; rows in
    error or unavailable stand for no window and count only where there is none.
    """
    order = ["unavailable", "error", "stale", "available", "retained"]
    rank = F.max(F.array_position(F.array(*map(F.lit, order)), F.col("state")))
    left = F.min(F.when(F.col("state").isin(*order[2:]), F.lit(100) - F.col("used")))
    g = df.groupBy(*keys).agg(rank.cast("int").alias("_r"), left.alias("remaining"))
    return g.select(*keys, F.get(F.array(*map(F.lit, order)), F.col("_r") - 1).alias("status"), "remaining")


def latest(df: DataFrame, keys: list[str], order: list[str], cols: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_l")).select(*keys, "_l.*")


def growth(files: DataFrame, size: str, day: str, now: str, days: int, free_bytes: int) -> DataFrame:
    """Bytes, oldest and newest day, bytes of the last ``days``, by day, in a year, and how long the free space lasts."""
    recent = F.coalesce(F.sum(F.when(F.col(day) > F.date_sub(F.lit(now).cast("date"), days), F.col(size))), F.lit(0))
    g = files.agg(F.sum(size).alias("bytes"), F.min(day).alias("oldest"), F.max(day).alias("newest"), recent.alias("recent_bytes"))
    per_day = F.col("recent_bytes") / F.lit(days)
    return g.withColumn("per_day", per_day).withColumn("year_bound", F.col("bytes") + F.ceil(per_day * 365)).withColumn("runway_days", F.when(F.col("recent_bytes") > 0, F.floor(F.lit(free_bytes) / per_day)))


def worst_status(checks: DataFrame, keys: list[str]) -> DataFrame:
    rank = F.max(F.when(F.col("status") == "fail", 2).when(F.col("status") == "warn", 1).otherwise(0))
    return checks.groupBy(*keys).agg(F.element_at(F.array(F.lit("ok"), F.lit("warn"), F.lit("fail")), rank + 1).alias("status"), F.count(F.lit(1)).alias("checks"))


def set_digest(df: DataFrame, cols: list[str]) -> DataFrame:
    """A digest of a table that doesn't depend on the order of its rows: their number and the sum of their md5s' first 60 bits.

    A row's text is its columns joined by NUL; nulls are empty.
    """
    row = F.md5(F.concat_ws("\0", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]))
    return df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"))


def window_sums(days: DataFrame, day: str, windows: DataFrame, aggregates: dict[str, Column], keys: list[str] = ()) -> DataFrame:
    """Aggregates of every window in one pass over the days."""
    hit = days.join(F.broadcast(windows), F.col(day).between(F.col("from_day"), F.col("to_day")))
    return hit.groupBy("window_key", "part", *keys).agg(*[c.alias(k) for k, c in aggregates.items()])


def recent_specs(rounds: DataFrame, windows: DataFrame, n: int = 6) -> DataFrame:
    """By window the n specs that ended last, with their latest round's verdict."""
    hit = rounds.join(F.broadcast(windows.filter("part = 'current'")), F.col("ended_on").between(F.col("from_day"), F.col("to_day")))
    g = hit.groupBy("window_key", "spec").agg(F.max("ended_on").alias("latest"), F.max_by("verdict", "round").alias("verdict"), F.sum("cents").alias("cents"))
    w = Window.partitionBy("window_key").orderBy(F.col("latest").desc(), F.col("spec").desc())
    return g.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= n)


def candidate_rollup(sessions: DataFrame, unregistered: Column) -> DataFrame:
    """Sessions and tokens of projects that no rule names."""
    return sessions.filter(unregistered).groupBy("project_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("input_tokens").alias("input_tokens"))


def round_stats(rounds: DataFrame, keys: list[str]) -> DataFrame:
    return rounds.groupBy(*keys).agg(F.count(F.lit(1)).alias("rounds"), F.count_distinct("spec").alias("specs"), F.min(F.when(F.col("accepted"), F.col("round"))).alias("first_accepted"), F.sum("findings").alias("findings"), F.max("round").alias("last_round"))


def scope_usage(df: DataFrame, scope: str, loop: str, value: str) -> DataFrame:
    """Sums by scope, model and day, by model and day, and over all, with the loop's share."""
    sets = [[F.col(scope), F.col("model"), F.col("day_utc")], [F.col("model"), F.col("day_utc")], []]
    rows = df.withColumn("_loop", F.when(F.col(scope) == loop, F.col(value)))
    return rows.groupingSets(sets, scope, "model", "day_utc").agg(F.sum(value).alias(value), (F.floor(F.sum("_loop") / F.sum(value) * 10000 + 0.5) / 10000).alias("loop_share"))


def round_totals(rounds: DataFrame, key: str, flags: list[str], sums: list[str]) -> DataFrame:
    """Sums by key and the sorted union of several flag columns."""
    union = F.array_distinct(F.flatten(F.array(*[F.collect_set(f) for f in flags])))
    return rounds.groupBy(key).agg(*_sums(sums), F.array_sort(union).alias("flags"))


def spec_totals(rounds: DataFrame, key: str, by: str, value: str) -> DataFrame:
    """The sum by key, and its parts as a map."""
    g = rounds.groupBy(key, by).agg(F.sum(value).alias(value))
    return g.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(by, value)))).alias("parts"), F.sum(value).alias(value))


def headline(specs: DataFrame) -> DataFrame:
    """One row: specs, accepted ones, money, money by accepted spec, median rounds and efficiency; null where nothing was accepted."""
    n = F.count_if("accepted")
    paid = F.sum(F.when(F.col("accepted"), F.col("cents")))
    g = specs.agg(F.count(F.lit(1)).alias("specs"), n.alias("accepted_specs"), F.sum("cents").alias("cents"), F.when(n > 0, paid / n).alias("cents_per_accepted"), (n / F.sum("rounds")).alias("efficiency"))
    return with_statistics(g, order_statistics(specs, "rounds", {"median_rounds": 0.5})).select("specs", "accepted_specs", "cents", "cents_per_accepted", "median_rounds", "efficiency")


def window_outcomes(rounds: DataFrame, windows: DataFrame, valid_days: int = 60) -> DataFrame:
    """By window: rounds, accepted specs, findings, the median of valid durations and money by accepted spec."""
    n = F.count_distinct(F.when(F.col("accepted"), F.col("spec")))
    valid = F.when(F.col("raw_days").between(0, valid_days), F.col("raw_days").cast("double"))
    sums = window_sums(rounds, "ended_on", windows, {"rounds": F.count(F.lit(1)), "accepted_specs": n, "findings": F.sum("findings"), "cents_per_accepted": F.when(n > 0, F.sum("cents") / n)})
    hit = rounds.join(F.broadcast(windows), F.col("ended_on").between(F.col("from_day"), F.col("to_day")))
    keys = [c for c in ("window_key", "part") if c in sums.columns]
    return with_statistics(sums, order_statistics(hit, valid, {"median_days": 0.5}, keys), keys)


def probe_health(df: DataFrame, keys: list[str], ok: Column, name: str) -> DataFrame:
    """How many probes there were, the share that was fine, and how many names had gaps."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.count_if(ok) / F.count(F.lit(1))).alias("ok_share"), F.count_distinct(F.when(~ok, F.col(name))).alias("gap_names"))


def attention_totals(df: DataFrame, entity: str, size: Column, mode: str, stewardship: list[str], rework: list[str]) -> DataFrame:
    """Hours, stewardship hours, shares of rework and of the largest entity; null, not 0, without records."""
    part = lambda m: F.coalesce(F.sum(F.when(F.col(mode).isin(*m), size)), F.lit(0))
    g = df.groupBy(entity).agg(F.sum(size).alias("m"), part(rework).alias("r"), part(stewardship).alias("s"))
    return g.agg((F.sum("m") / 3.6e9).alias("hours"), (F.sum("s") / 3.6e9).alias("stewardship"), (F.sum("r") / F.sum("m")).alias("rework_share"), (F.max("m") / F.sum("m")).alias("top_share"), F.count(F.lit(1)).alias("projects"))
