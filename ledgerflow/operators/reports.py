"""The report of windows: all measures of each window, and of the one before it, as one long table."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graph import kept
from .ranking import top_n_plus_other
from .statistics import order_statistics, with_statistics

KEYS = ["window_key", "part"]


def coverage(series: dict[str, DataFrame]) -> dict[str, tuple]:
    """First and last day of each series (column ``day``), (None, None) of an empty one; one row a series reaches the driver."""
    spans = None
    for name, df in series.items():
        one = df.agg(F.lit(name).alias("name"), F.min("day").cast("date").alias("a"), F.max("day").cast("date").alias("b"))
        spans = one if spans is None else spans.unionByName(one)
    return {r["name"]: (r["a"], r["b"]) for r in spans.collect()}


def report_windows(spark: SparkSession, spans: dict[str, tuple], today: str, sizes: tuple[int, ...] = (7, 30, 90), pending: bool = False) -> DataFrame:
    """(window_key, part, from_day, to_day) of the windows that end on the last day and of those before them.

    The last day is the later of ``today`` and the last day of any series; a window
    begins no earlier than the first day of any series, and the one before it is as
    long.  It has part usage_prior or rounds_prior, or both, if that series
    began by then.  attention_now and attention_prior are there only if attention
    covers both; they end a day earlier while the last day is ``pending``.
    """
    days = [d for span in spans.values() for d in span if d is not None]
    now = datetime.date.fromisoformat(today)
    first, last = min(days, default=now), max([now, *days])
    day = datetime.timedelta(days=1)
    rows = []
    for n in sizes:
        begin = max(first, last - (n - 1) * day)
        size = (last - begin).days + 1
        rows.append((str(n), "current", begin, last))
        for name in ("usage", "rounds"):
            start = spans[name][0]
            if start is not None and begin - size * day >= start:
                rows.append((str(n), f"{name}_prior", begin - size * day, begin - day))
        end = last - day if pending else last
        cut = end - (size - 1) * day
        start, stop = spans["attention"]
        if start is not None and start <= cut - size * day and stop >= end:
            rows += [(str(n), "attention_now", cut, end), (str(n), "attention_prior", cut - size * day, cut - day)]
    rows.append(("all", "current", first, last))
    return spark.sql("select * from values " + ", ".join(f"('{k}', '{p}', date '{a}', date '{b}')" for k, p, a, b in rows) + " as t(window_key, part, from_day, to_day)")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, F.floor(a / b * 1e6 + 0.5) / 1e6)


def _long(rows: DataFrame, cells: list[tuple]) -> DataFrame:
    """One row for each (section, item, metric, value) of a row of a window; an item is a text or a column."""
    of = lambda s, i, m, v: F.struct(F.lit(s).alias("section"), (F.lit(i) if isinstance(i, str) else i).cast("string").alias("item"), F.lit(m).alias("metric"), v.cast("double").alias("value"))
    return rows.select(*KEYS, F.explode(F.array(*[of(*c) for c in cells])).alias("_c")).select(*KEYS, "_c.*")


def windows_report(
    usage: DataFrame, rounds: DataFrame, attention: DataFrame, probes: DataFrame, windows: DataFrame, *, vendors: list[str], hosts: list[str],
    buckets: list, modes: list[str], stewardship: list[str], rework: str, longest: float, top: int = 6, points: int = 48,
) -> DataFrame:
    """(window_key, part, section, item, metric, value, text): everything that a page of windows shows.

    ``usage``: day, project_id, vendor, host_os, sessions, tokens.  ``rounds``: day,
    spec, round, accepted, verdict, duration, cents, findings.  ``attention``:
    day, project_id, micros, transitions_in and a column for each mode.  ``probes``: day,
    source, status, at.  ``windows`` as ``report_windows`` gives them: a handful of rows,
    broadcast.  Other columns are ignored.

    Sections of a current window: summary, vendors, hosts, buckets (tokens of the projects
    named), projects and specs (the ``top`` greatest and one row of the others), daily
    and rounds_daily (at most ``points`` buckets of equally many calendar days, named by their
    first day, days without rows included; medians are of all valid durations of a bucket),
    outcomes, recent (the specs that ended last), measurement, attention, modes, and ledger
    (attention beside usage by project, null where there is none of one kind).  Of the window before:
    summary, buckets and outcomes.  Sums and counts without rows are 0; shares, medians and
    attention without rows are null.  Durations outside 0 to ``longest`` have no part in medians.
    A null spec counts as unknown, a null project as unknown in usage; the ledger leaves it out.

    Each fact is brought to one row for each window and project, spec, bucket or
    source before anything is ranked; specs, which several sections need, are kept by a
    checkpoint and gathered once.
    """
    current = windows.filter("part = 'current'")
    width = F.greatest(F.lit(1), F.ceil((F.datediff("to_day", "from_day") + 1) / F.lit(points))).cast("int")
    spine = current.withColumn("_width", width).select(*KEYS, "from_day", "_width", F.explode(F.sequence(F.lit(0), F.floor(F.datediff("to_day", "from_day") / F.col("_width")).cast("int"))).alias("_place"))
    first_day = F.expr("date_add(from_day, _place * _width)")

    def hit(df: DataFrame, *parts: str) -> DataFrame:
        wanted = windows.filter(F.col("part").isin(*parts)).withColumn("_width", width)
        rows = df.join(F.broadcast(wanted), F.col("day").between(F.col("from_day"), F.col("to_day")))
        return rows.withColumn("_place", F.floor(F.datediff("day", "from_day") / F.col("_width")).cast("int"))

    def each(sums: DataFrame, *parts: str) -> DataFrame:
        return windows.filter(F.col("part").isin(*parts)).join(F.broadcast(sums), KEYS, "left")

    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    ours = [F.col(c) for c in ("day", "vendor", "host_os", "sessions", "tokens")]
    u = hit(usage.select(*ours, F.coalesce(F.col("project_id").cast("string"), F.lit("unknown")).alias("project_id"), F.col("project_id").isNotNull().alias("_named")), "current", "usage_prior")
    live = (F.coalesce("tokens", F.lit(0)) != 0) | (F.coalesce("sessions", F.lit(0)) != 0)
    of = lambda c, v: F.sum(F.when(F.col(c) == v, F.col("tokens")))
    sums = u.groupBy(*KEYS).agg(
        F.sum("tokens").alias("tokens"), F.sum("sessions").alias("session_days"), F.count_distinct(F.when(live, F.col("day"))).alias("active_days"), F.count_distinct(F.when(live, F.col("project_id"))).alias("projects"),
        *[of("vendor", v).alias(f"_v{i}") for i, v in enumerate(vendors)], *[of("host_os", v).alias(f"_h{i}") for i, v in enumerate(hosts)], *[of("project_id", str(v)).alias(f"_b{i}") for i, v in enumerate(buckets)],
    )
    both = each(sums, "current", "usage_prior")
    shared = [("summary", "", m, zero(m)) for m in ("tokens", "session_days", "active_days", "projects")] + [("buckets", str(v), "tokens", zero(f"_b{i}")) for i, v in enumerate(buckets)]
    own = [("vendors", v, "tokens", zero(f"_v{i}")) for i, v in enumerate(vendors)] + [("hosts", v, "tokens", zero(f"_h{i}")) for i, v in enumerate(hosts)]
    out = [_long(both, shared), _long(both.filter("part = 'current'"), own)]

    by_project = u.filter("part = 'current'").filter(live).groupBy(*KEYS, "project_id", "_named").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("sessions"), F.lit(0)).alias("sessions"))
    named = by_project.groupBy(*KEYS, "project_id").agg(F.sum("tokens").alias("tokens"), F.sum("sessions").alias("sessions"))
    label = F.col("label")
    out.append(_long(top_n_plus_other(named, KEYS, "project_id", "tokens", ["sessions"], top), [("projects", label, m, F.col(m)) for m in ("position", "tokens", "sessions", "other_count")]))
    series = u.filter("part = 'current'").groupBy(*KEYS, "_place").agg(F.sum("tokens").alias("tokens"), F.sum("sessions").alias("sessions"))
    out.append(_long(spine.join(series, [*KEYS, "_place"], "left"), [("daily", first_day, m, zero(m)) for m in ("tokens", "sessions")]))

    ours = ["day", F.coalesce(F.col("spec").cast("string"), F.lit("unknown")).alias("spec"), "round", F.coalesce("accepted", F.lit(False)).alias("accepted"), "verdict", "cents", "findings", F.when(F.col("duration").between(0, longest), F.col("duration").cast("double")).alias("duration")]
    r = hit(rounds.select(*ours), "current", "rounds_prior")
    specs = kept(r.groupBy(*KEYS, "spec").agg(
        F.count(F.lit(1)).alias("rounds"), F.count_if("accepted").alias("accepted_rounds"), F.coalesce(F.sum("cents"), F.lit(0)).alias("cents"), F.coalesce(F.sum("findings"), F.lit(0)).alias("findings"),
        F.max("day").alias("latest"), F.max_by("verdict", F.struct("day", "round")).alias("verdict"),
    ))
    won = F.count_if(F.col("accepted_rounds") > 0)
    sums = specs.groupBy(*KEYS).agg(won.alias("accepted_specs"), F.count(F.lit(1)).alias("specs"), *[F.sum(c).alias(c) for c in ("rounds", "accepted_rounds", "cents", "findings")])
    sums = with_statistics(sums, order_statistics(r, "duration", {"median_duration": 0.5}, KEYS), KEYS)
    cells = [("outcomes", "", m, zero(m)) for m in ("accepted_specs", "specs", "rounds", "accepted_rounds", "findings", "cents")]
    cells += [("outcomes", "", "efficiency", _ratio(F.col("accepted_specs"), F.col("specs"))), ("outcomes", "", "cents_per_accepted", _ratio(F.col("cents"), F.col("accepted_specs"))), ("outcomes", "", "median_duration", F.col("median_duration"))]
    out.append(_long(each(sums, "current", "rounds_prior"), cells))
    now = specs.filter("part = 'current'")
    out.append(_long(top_n_plus_other(now, KEYS, "spec", "cents", ["findings", "rounds"], top), [("specs", label, m, F.col(m)) for m in ("position", "cents", "findings", "rounds", "other_count")]))
    last = now.withColumn("position", F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.col("latest").desc(), F.col("spec").desc()))).filter(F.col("position") <= top)
    said = F.when(F.col("accepted_rounds") > 0, "accepted").otherwise(F.lower(F.coalesce("verdict", F.lit("not accepted"))))
    recent = last.select(*KEYS, F.lit("recent").alias("section"), F.col("spec").alias("item"), said.alias("text"), F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in ("position", "rounds", "cents", "findings")])).alias("_c"))
    recent = recent.select(*KEYS, "section", "item", "_c.metric", "_c.value", "text")
    r = r.filter("part = 'current'")
    series = r.groupBy(*KEYS, "_place").agg(F.count(F.lit(1)).alias("rounds"), F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("not_accepted"))
    places = [*KEYS, "_place"]
    filled = with_statistics(spine.join(series, places, "left"), order_statistics(r, "duration", {"median_duration": 0.5}, places), places)
    out.append(_long(filled, [("rounds_daily", first_day, m, zero(m)) for m in ("rounds", "accepted", "not_accepted")] + [("rounds_daily", first_day, "median_duration", F.col("median_duration"))]))

    seen = probes.groupBy("day", "source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "ok").alias("healthy"), F.max_by("status", "at").alias("_latest"))
    sums = hit(seen, "current").groupBy(*KEYS).agg(F.sum("n").alias("total"), F.sum("healthy").alias("healthy"), F.count_distinct(F.when(F.col("_latest") != "ok", F.col("source"))).alias("gap_sources"))
    out.append(_long(each(sums, "current"), [("measurement", "", m, zero(m)) for m in ("healthy", "total", "gap_sources")] + [("measurement", "", "ratio", _ratio(F.col("healthy"), F.col("total")))]))

    a = hit(attention.select("day", F.col("project_id").cast("string").alias("project_id"), "micros", "transitions_in", *modes), "current", "attention_now", "attention_prior")
    by = a.groupBy(*KEYS, "project_id").agg(*[F.sum(c).alias(c) for c in ("micros", "transitions_in", *modes)])
    mine = by.filter("part = 'current'")
    sums = mine.groupBy(*KEYS).agg(F.max("micros").alias("_top"), *[F.sum(c).alias(c) for c in ("micros", "transitions_in", *modes)])
    parts = by.filter("part <> 'current'").groupBy("window_key", "project_id").agg(F.bool_or(F.col("part") == "attention_prior").alias("was"), F.bool_or(F.col("part") == "attention_now").alias("is"))
    gone = parts.groupBy("window_key").agg(F.count_if(F.col("was") & ~F.col("is")).alias("dropped"))
    covered = windows.filter("part = 'attention_prior'").select("window_key").join(gone, "window_key", "left").select("window_key", zero("dropped").alias("dropped"))
    rows = each(sums, "current").join(F.broadcast(covered), "window_key", "left")
    hours = lambda c: F.floor(c / 3.6e9 * 1e6 + 0.5) / 1e6
    cells = [("attention", "", "hours", hours(F.col("micros"))), ("attention", "", "stewardship_hours", hours(sum((F.col(m) for m in stewardship), F.lit(0)))), ("attention", "", "rework_hours", hours(F.col(rework)))]
    cells += [("attention", "", "rework_share", _ratio(F.col(rework), F.col("micros"))), ("attention", "", "transitions", F.col("transitions_in")), ("attention", "", "top_share", _ratio(F.col("_top"), F.col("micros"))), ("attention", "", "dropped_projects", F.col("dropped"))]
    cells += [c for m in modes for c in (("modes", m, "micros", F.col(m)), ("modes", m, "share", _ratio(F.col(m), F.col("micros"))))]
    out.append(_long(rows, cells))
    spent = by_project.filter("_named").select(*KEYS, "project_id", "tokens", "sessions")
    measures = ["micros", "transitions_in", *modes, "tokens", "sessions"]
    ledger = top_n_plus_other(mine.filter("project_id is not null").join(spent, [*KEYS, "project_id"], "full"), KEYS, "project_id", "micros", measures, top, nulls=True)
    out.append(_long(ledger, [("ledger", label, m, F.col(m)) for m in ("position", *measures, "other_count")]))

    whole = recent
    for rows in out:
        whole = whole.unionByName(rows.withColumn("text", F.lit(None).cast("string")))
    return whole
