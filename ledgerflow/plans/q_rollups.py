"""Queries for rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as I
from ..operators import rollups as G
from . import standins as V
from .q_scalars import PRICED, priced
from .q_sequence import BOUNDS, PARTS, order_bounds, quota, seconds, SEC, _NOW, _QUOTA
from .standins import ATT, LOG, OBS, RND

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def _sum(cols):
    return ", ".join(f"sum({c})::bigint as {c}" for c in cols)


TOK = _sum(G.TOKENS)


@query("pipeline_window_cost", f"""with {PRICED}, w(window_key, from_day, to_day) as (values ('7', date '2024-01-25', date '2024-01-31'), ('30', date '2024-01-02', date '2024-01-31'), ('90', date '2023-11-03', date '2024-01-31'), ('all', date '2024-01-01', date '2024-01-31')),
days as (select day_utc, project_id, vendor, host_os, sum(input_tokens + output_tokens)::bigint as tokens, sum(units)::bigint as units, sum(unpriced_tokens)::bigint as unpriced_tokens from priced group by all)
select window_key, sum(tokens)::bigint as tokens, sum(units)::double / 2e10::double as usd, sum(unpriced_tokens)::bigint as unpriced_tokens, count(distinct day_utc) as active_days from days join w on day_utc between from_day and to_day group by 1""")
def pipeline_window_cost(spark, d):
    """Events seen through two files are made one, priced, rolled up by day and summed by window."""
    from ..functions.pricing import dollars
    from ..functions.pricing import price_usage
    from ..operators.sequence import bounds, dedup_events

    rows = V.obs(spark, d)
    twice = rows.withColumn("file_id", F.lit(1)).unionByName(rows.filter("event_id % 10 = 0").withColumn("file_id", F.lit(0)))
    one = dedup_events(twice, "event_id", ["file_id"]).drop("file_id")
    days = G.daily_rollup(price_usage(one, V.prices(spark)), ["units", "unpriced_tokens"]).withColumn("tokens", F.col("input_tokens") + F.col("output_tokens"))
    windows = bounds(spark, "2024-01-31", "2024-01-01").filter("part = 'current'")
    g = G.window_sums(days, "day_utc", windows, {"tokens": F.sum("tokens"), "units": F.sum("units"), "unpriced_tokens": F.sum("unpriced_tokens"), "active_days": F.count_distinct("day_utc")})
    return g.select("window_key", "tokens", dollars("units").alias("usd"), "unpriced_tokens", "active_days")


@query("ag01_session_rollup", f"with {PRICED}, o as (select obs.*, p.units, p.unpriced_tokens from obs join priced p using (event_id)) select vendor, session_id, {TOK}, sum(units)::bigint as units, count(*) as observations, epoch_us(min(ts)) as first_us, epoch_us(max(ts)) as last_us, list_sort(list(distinct model)) as models, arg_min(project_id, event_id + 1000000 * epoch_us(ts)::hugeint) as project_id, arg_min(host_os, event_id + 1000000 * epoch_us(ts)::hugeint) as host_os from o group by all")
def ag01(spark, d):
    s = G.session_rollup(priced(spark, d), ["units"])
    return s.withColumn("first_us", F.unix_micros("first_ts")).withColumn("last_us", F.unix_micros("last_ts")).drop("first_ts", "last_ts")


@query("ag02_project_rollup", f"with {OBS}, s as (select vendor, session_id, min(ts) as t, sum(input_tokens)::bigint as input_tokens, any_value(project_id) as project_id, any_value(host_os) as host_os from obs group by all) select project_id, count(*) as sessions, sum(input_tokens)::bigint as input_tokens, epoch_us(min(t) filter (host_os = 'windows')) as windows_us, epoch_us(min(t) filter (host_os = 'wsl')) as wsl_us, bool_and(project_id < 10) as all_registered from s group by 1")
def ag02(spark, d):
    p = G.project_rollup(G.session_rollup(V.obs(spark, d)), ["windows", "wsl"], F.col("project_id") < 10)
    return p.select("project_id", "sessions", "input_tokens", F.unix_micros("first_windows").alias("windows_us"), F.unix_micros("first_wsl").alias("wsl_us"), "all_registered")


@query("ag03_candidate_rollup", f"with {OBS} select project_id, count(distinct session_id) as sessions, sum(input_tokens)::bigint as input_tokens from obs where project_id >= 10 group by 1")
def ag03(spark, d):
    return G.candidate_rollup(G.session_rollup(V.obs(spark, d)), F.col("project_id") >= 10)


@query("ag04_daily_rollup", f"with {PRICED}, o as (select obs.*, p.units from obs join priced p using (event_id)) select day_utc, project_id, vendor, host_os, count(distinct session_id) as sessions, {TOK}, sum(units)::bigint as units from o group by all")
def ag04(spark, d):
    return G.daily_rollup(priced(spark, d), ["units"])


@query("ag05_splits", f"with {OBS} select vendor, host_os, model, project_id, grouping(vendor, host_os, model, project_id) as set_id, count(*) as n, sum(input_tokens)::bigint as input_tokens from obs group by grouping sets ((vendor), (host_os), (model), (project_id, vendor), (project_id, host_os), ())")
def ag05(spark, d):
    return G.splits(V.obs(spark, d), [["vendor"], ["host_os"], ["model"], ["project_id", "vendor"], ["project_id", "host_os"], []], ["input_tokens"]).select("vendor", "host_os", "model", "project_id", "set_id", "n", "input_tokens")


@query("ag06_dup_counts", 'select count(*) as raw, count(distinct text) as "unique", count(*) - count(distinct text) as duplicates from documents')
def ag06(spark, d):
    return G.dup_counts(V.read(spark, d, "documents"), F.sha2("text", 256))


@query("ag07_activity_hours", f"with {OBS} select day_utc, vendor, host_os, cast(isodow(ts) - 1 as integer) as weekday, cast(hour(ts) as integer) as hour_of_day, count(*) as n from obs group by all")
def ag07(spark, d):
    return G.activity_hours(V.obs(spark, d), ["day_utc", "vendor", "host_os"])


@query("ag08_heatmap", f"with {LOG}, g as (select w.w::integer as weekday, h.h::integer as hour_of_day from range(7) w(w), range(24) h(h)), a as (select isodow(ts) - 1 as w, hour(ts) as h, count(*) as n from log where kind = 'merged' group by all) select weekday, hour_of_day, coalesce(n, 0) as n from g left join a on w = weekday and h = hour_of_day")
def ag08(spark, d):
    return G.heatmap(V.log(spark, d).filter("kind = 'merged'"))


@query("ag08_hour_slots", f"with {LOG} select day_utc, [{', '.join(f'count(*) filter (hour(ts) = {h})' for h in range(24))}] as slots from log group by 1")
def ag08b(spark, d):
    return G.hour_slots(V.log(spark, d))


@query("ag09_event_days", f"with {LOG} select day_utc, count(*) as events, count(distinct row_id) as rows_touched, count(*) filter (kind = 'merged') as merges, count(*) filter (kind = 'proof') as proofs, count(*) filter (kind = 'proof' and exit_code <> 0) as failures, count(*) filter (kind = 'verdict' and state = 'DISPATCHED_ACCEPT') as accepts, count(*) filter (kind = 'verdict' and state = 'DISPATCHED_REJECT') as rejects from log group by 1")
def ag09(spark, d):
    return G.event_days(V.log(spark, d))


@query("ag10_count_by", f"with {LOG} select kind, state, exit_code, count(*) as n from log group by all")
def ag10(spark, d):
    return G.count_by(V.log(spark, d), ["kind", "state", "exit_code"])


@query("ag11_weekly_rate", f"with {LOG} select printf('%d-W%02d', isoyear(ts), weekofyear(ts)) as week, count(*) filter (kind = 'proof') as proofs, case when count(*) filter (kind = 'proof') > 0 then floor(count(*) filter (kind = 'proof' and exit_code = 1)::double / count(*) filter (kind = 'proof') * 10000 + 0.5) / 10000 end as error_rate from log group by 1")
def ag11(spark, d):
    from ..functions.scalars import rate, week_key

    g = V.log(spark, d).groupBy(week_key("ts").alias("week")).agg(F.count_if(F.col("kind") == "proof").alias("proofs"), F.count_if((F.col("kind") == "proof") & (F.col("exit_code") == 1)).alias("bad"))
    return g.select("week", "proofs", rate("bad", "proofs").alias("error_rate"))


_Q = ", ".join(f"quantile_cont(v, {q}) as p{int(q * 100)}" for q in (0.25, 0.5, 0.75, 0.95))


@query("ag12_distribution", f"select count(v) as n, min(v) as least, {_Q}, max(v) as greatest from (select l_quantity as v from lineitem)")
def ag12(spark, d):
    return G.distribution(V.read(spark, d, "lineitem"), "l_quantity")


_Q3 = ", ".join(f"floor(quantile_cont(v, {q}) * 1000 + 0.5) / 1000 as p{int(q * 100)}" for q in (0.25, 0.5, 0.75, 0.95))


@query("ag13_distribution_by", f"with {RND} select ended_on, count(v) as n, min(v) as least, {_Q3}, max(v) as greatest from (select ended_on, raw_days::double as v from rnd) group by 1")
def ag13(spark, d):
    g = G.distribution(V.rnd(spark, d).withColumn("v", F.col("raw_days").cast("double")), "v", ["ended_on"])
    return g.withColumns({c: F.floor(F.col(c) * 1000 + 0.5) / 1000 for c in ("p25", "p50", "p75", "p95")})


@query("ag14_round_stats", f"with {RND} select builder, verdict, count(*) as rounds, count(distinct spec) as specs, min(case when accepted then round end) as first_accepted, sum(findings)::bigint as findings, max(round) as last_round from rnd group by all")
def ag14(spark, d):
    return G.round_stats(V.rnd(spark, d), ["builder", "verdict"])


@query("ag15_nested_counts", f"with {RND}, g as (select ended_on, builder, count(*) as n from rnd group by all) select ended_on, string_agg(builder || '=' || n, ',' order by builder) as counts from g group by 1")
def ag15(spark, d):
    m = G.nested_counts(V.rnd(spark, d), "ended_on", "builder")
    return m.select("ended_on", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("counts"))


@query("ag16_floor_adherence", """with l as (select l_orderkey, l_suppkey % 3 as g, list(l_returnflag) as levels from (select l_orderkey, l_suppkey, case when l_quantity > 2 then l_returnflag end as l_returnflag from lineitem) group by all),
m as (select g, list_filter(levels, lambda x: x is not null) as levels from l)
select g, count(*) filter (len(levels) > 0) as evaluated, count(*) filter (len(levels) = 0) as unverified, count(*) filter (len(levels) > 0 and len(list_filter(levels, lambda x: x <> 'N')) = 0) as met,
 case when count(*) filter (len(levels) > 0) > 0 then floor(count(*) filter (len(levels) > 0 and len(list_filter(levels, lambda x: x <> 'N')) = 0)::double / count(*) filter (len(levels) > 0) * 10000 + 0.5) / 10000 end as rate from m group by 1""")
def ag16(spark, d):
    li = V.read(spark, d, "lineitem").withColumn("g", F.col("l_suppkey") % 3)
    rows = li.groupBy("l_orderkey", "g").agg(F.collect_list(F.when(F.col("l_quantity") > 2, F.col("l_returnflag"))).alias("levels"))
    return G.floor_adherence(rows, "levels", "N", ["g"])


@query("ag17_dense_daily", f"with {RND}, g as (select ended_on, count(*) as rounds, sum(cents)::bigint as cents from rnd group by 1), s as (select unnest(generate_series((select min(ended_on) from g), date '2001-08-02', interval 1 day))::date as ended_on) select ended_on, coalesce(rounds, 0) as rounds, coalesce(cents, 0) as cents from s left join g using (ended_on)")
def ag17(spark, d):
    g = V.rnd(spark, d).groupBy("ended_on").agg(F.count(F.lit(1)).alias("rounds"), F.sum("cents").alias("cents"))
    return G.dense_daily(g, "ended_on", {"rounds": 0, "cents": 0}, V.ORDERS_NOW)


_SERIES = {
    "events": ("log", "sum", 0), "merged_events": ("log", "sum", 0), "proofs": ("log", "sum", 0), "proof_failures": ("log", "sum", 0), "accepted_steps": ("log", "sum", 0), "rejected_steps": ("log", "sum", 0), "rows_touched": ("touched", "sum", 0),
    "judge_rounds": ("rounds", "sum", 0), "accept_commits": ("rounds", "sum", 0), "floor_evaluated": ("rounds", "sum", 0), "floor_met": ("rounds", "sum", 0), "test_runs": ("tests", "sum", 0), "latest_tests": ("tests", "latest", None),
}


@query("ag17_daily_series", f"""with {LOG}, {RND}, l as (select day_utc as day, count(*) as events, count(*) filter (kind = 'merged') as merged_events, count(*) filter (kind = 'proof') as proofs, count(*) filter (kind = 'proof' and exit_code <> 0) as proof_failures,
  count(*) filter (kind = 'verdict' and state = 'DISPATCHED_ACCEPT') as accepted_steps, count(*) filter (kind = 'verdict' and state = 'DISPATCHED_REJECT') as rejected_steps, count(distinct row_id) as rows_touched from log group by 1),
r as (select ended_on + 8000 as day, count(*) as judge_rounds, count(*) filter (accepted) as accept_commits, count(*) filter (surfaces > 0) as floor_evaluated, count(*) filter (surfaces = 1) as floor_met from rnd group by 1),
t as (select cast(ts as date) as day, count(*) as test_runs, max_by(user_id, event_id) as latest_tests from events where event_type = 'view' and user_id % 7 = 0 group by 1),
days as (select day from l union select day from r union select day from t), s as (select unnest(generate_series((select min(day) from days), greatest((select max(day) from days), date '2024-02-10'), interval 1 day))::date as day)
select day, {', '.join(f'coalesce({c}, 0)::bigint as {c}' for c in _SERIES if c != 'latest_tests')}, latest_tests from s left join l using (day) left join r using (day) left join t using (day)""")
def ag17b(spark, d):
    log, k, s = V.log(spark, d), F.col("kind"), F.col("state")
    one = lambda c: F.when(c, 1).otherwise(0).cast("long")
    of_log = log.select(
        F.col("day_utc").alias("day"), F.lit(1).cast("long").alias("events"), one(k == "merged").alias("merged_events"), one(k == "proof").alias("proofs"), one((k == "proof") & (F.col("exit_code") != 0)).alias("proof_failures"),
        one((k == "verdict") & (s == "DISPATCHED_ACCEPT")).alias("accepted_steps"), one((k == "verdict") & (s == "DISPATCHED_REJECT")).alias("rejected_steps"),
    )
    touched = log.select(F.col("day_utc").alias("day"), "row_id").distinct().select("day", F.lit(1).cast("long").alias("rows_touched"))
    rounds = V.rnd(spark, d).select(F.date_add("ended_on", 8000).alias("day"), F.lit(1).cast("long").alias("judge_rounds"), one(F.col("accepted")).alias("accept_commits"), one(F.col("surfaces") > 0).alias("floor_evaluated"), one(F.col("surfaces") == 1).alias("floor_met"))
    tests = V.read(spark, d, "events").filter("event_type = 'view' and user_id % 7 = 0").select(F.to_date("ts").alias("day"), F.col("event_id").alias("at"), F.lit(1).cast("long").alias("test_runs"), F.col("user_id").alias("latest_tests"))
    return G.merge_daily({"log": of_log, "touched": touched, "rounds": rounds, "tests": tests}, "day", _SERIES, "2024-02-10")


@query("ag18_scope_usage", f"with {OBS}, g as (select case when project_id < 5 then 'loop' else 'other' end as scope, model, day_utc, input_tokens from obs) select scope, model, day_utc, sum(input_tokens)::bigint as input_tokens, floor(sum(input_tokens) filter (scope = 'loop')::double / sum(input_tokens) * 10000 + 0.5) / 10000 as loop_share from g group by grouping sets ((scope, model, day_utc), (model, day_utc), ())")
def ag18(spark, d):
    return G.scope_usage(V.obs(spark, d).withColumn("scope", F.when(F.col("project_id") < 5, "loop").otherwise("other")), "scope", "loop", "input_tokens")


_TIER = "case when verdict = 'F' then 'exact' when verdict = 'O' then 'correlated' else 'unattributed' end"


@query("ag19_attribution_coverage", f"with {RND}, r as (select builder, round % 2 = 0 as judge, {_TIER} as tier, cents from rnd) select builder, judge, " + ", ".join(f"count(*) filter (tier = '{t}') as n_{t}, coalesce(sum(cents) filter (tier = '{t}'), 0)::bigint as cents_{t}" for t in ("exact", "correlated", "unattributed")) + " from r group by all")
def ag19(spark, d):
    rows = V.rnd(spark, d).withColumn("judge", F.col("round") % 2 == 0).withColumn("tier", F.expr(_TIER))
    return G.attribution_coverage(rows, ["builder", "judge"], ["exact", "correlated", "unattributed"])


@query("ag20_round_totals", f"with {RND} select spec, sum(cents)::bigint as cents, sum(findings)::bigint as findings, string_agg(distinct flag, ',' order by flag) as flags from (select spec, cents, findings, unnest([verdict, builder]) as flag, generate_subscripts([verdict, builder], 1) as i from rnd) where i = 1 or i = 2 group by spec")
def ag20(spark, d):
    g = G.round_totals(V.rnd(spark, d).withColumns({"cents": F.col("cents") * 2, "findings": F.col("findings") * 2}), "spec", ["verdict", "builder"], ["cents", "findings"])
    return g.withColumn("flags", F.array_join("flags", ","))


@query("ag21_spec_totals", f"with {RND}, g as (select spec, builder, sum(cents)::bigint as cents from rnd group by all) select spec, sum(cents)::bigint as cents, string_agg(builder || '=' || cents, ',' order by builder) as by_builder from g group by 1")
def ag21(spark, d):
    m = G.spec_totals(V.rnd(spark, d), "spec", "builder", "cents")
    return m.select("spec", "cents", F.array_join(F.transform(F.map_entries("parts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("by_builder"))


@query("ag22_headline", f"with {RND}, s as (select spec, bool_or(accepted) as accepted, count(*) as rounds, sum(cents)::bigint as cents from rnd group by 1) select count(*) as specs, count(*) filter (accepted) as accepted_specs, sum(cents)::bigint as cents, sum(cents) filter (accepted)::double / count(*) filter (accepted) as cents_per_accepted, quantile_cont(rounds::double, 0.5) as median_rounds, count(*) filter (accepted)::double / sum(rounds)::double as efficiency from s")
def ag22(spark, d):
    return G.headline(V.rnd(spark, d).groupBy("spec").agg(F.bool_or("accepted").alias("accepted"), F.count(F.lit(1)).alias("rounds"), F.sum("cents").alias("cents")))


@query("ag23_week_over_week", f"with {RND}, w as (select case when date_diff('day', ended_on, date '2001-08-01') between 0 and 6 then 'this' when date_diff('day', ended_on, date '2001-08-01') between 7 and 13 then 'last' end as w, * from rnd), g as (select count(*) filter (w = 'this') as a, count(*) filter (w = 'last') as b, sum(cents) filter (w = 'this')::bigint as this_cents, sum(cents) filter (w = 'last')::bigint as last_cents, sum(findings) filter (w = 'this')::bigint as this_findings, sum(findings) filter (w = 'last')::bigint as last_findings from w) select this_cents, last_cents, this_findings, last_findings, this_cents - last_cents as delta_cents, this_findings - last_findings as delta_findings, case when a = 0 then 'nothing this week' when b = 0 then 'nothing last week' else '' end as reason from g")
def ag23(spark, d):
    return G.week_over_week(V.rnd(spark, d), "ended_on", "2001-08-01", {"cents": F.sum("cents"), "findings": F.sum("findings")})


_MODES = ["plan", "guide", "review", "rework", "direct"]


@query("ag24_attention_days", f"""with {PARTS}, m as (select day, project_id, lag(project_id) over (partition by day order by part_start, part_end, event_id) as f from parts), t as (select day, project_id, count(*) as transitions_in from m where f <> project_id group by all)
select p.day, p.project_id, sum(part_end - part_start)::bigint as micros, count(*) as n_parts, {', '.join(f"coalesce(sum(part_end - part_start) filter (mode = '{m}'), 0)::bigint as {m}" for m in _MODES)}, coalesce(any_value(transitions_in), 0) as transitions_in from parts p left join t on t.day = p.day and t.project_id = p.project_id group by p.day, p.project_id""")
def ag24(spark, d):
    return I.attention_days(I.split_at_midnight(V.att(spark, d), "start_us", "end_us"), "project_id", "mode", _MODES, ["part_start", "part_end", "event_id"])


@query("ag25_window_summary", f"""with {OBS}, w(window_key, from_day) as (values ('7', date '2024-01-25'), ('30', date '2024-01-02'), ('all', date '2024-01-01')),
days as (select day_utc, project_id, vendor, host_os, count(distinct session_id) as sessions, sum(input_tokens)::bigint as t from obs group by all)
select window_key, sum(t)::bigint as tokens, sum(sessions)::bigint as session_days, count(distinct day_utc) as active_days, count(distinct project_id) as projects, coalesce(sum(t) filter (vendor = 'vendor_a'), 0)::bigint as tokens_a, coalesce(sum(t) filter (host_os = 'wsl'), 0)::bigint as tokens_wsl, coalesce(sum(t) filter (project_id >= 10), 0)::bigint as tokens_adhoc from days join w on day_utc >= from_day group by 1""")
def ag25(spark, d):
    from ..operators.sequence import bounds

    days = G.daily_rollup(V.obs(spark, d))
    w = bounds(spark, "2024-01-31", "2024-01-01", (7, 30)).filter("part = 'current'")
    t = F.col("input_tokens")
    only = lambda c: F.coalesce(F.sum(F.when(c, t)), F.lit(0))
    aggs = {"tokens": F.sum(t), "session_days": F.sum("sessions"), "active_days": F.count_distinct("day_utc"), "projects": F.count_distinct("project_id"), "tokens_a": only(F.col("vendor") == "vendor_a"), "tokens_wsl": only(F.col("host_os") == "wsl"), "tokens_adhoc": only(F.col("project_id") >= 10)}
    return G.window_sums(days, "day_utc", w, aggs).drop("part")


@query("ag26_window_outcomes", f"""with {RND}, {BOUNDS} select window_key, count(*) as rounds, count(distinct case when accepted then spec end) as accepted_specs, sum(findings)::bigint as findings, quantile_cont(case when raw_days between 0 and 60 then raw_days::double end, 0.5) as median_days,
  case when count(distinct case when accepted then spec end) > 0 then sum(cents)::double / count(distinct case when accepted then spec end) end as cents_per_accepted from rnd join bounds on ended_on between from_day and to_day where part = 'current' group by 1""")
def ag26(spark, d):
    return G.window_outcomes(V.rnd(spark, d), order_bounds(spark).filter("part = 'current'")).drop("part")


@query("ag27_recent_specs", f"with {RND}, {BOUNDS}, g as (select window_key, spec, max(ended_on) as latest, arg_max(verdict, round) as verdict, sum(cents)::bigint as cents from rnd join bounds on ended_on between from_day and to_day where part = 'current' group by all) select *, cast(row_number() over (partition by window_key order by latest desc, spec desc) as integer) as position from g qualify position <= 6")
def ag27(spark, d):
    return G.recent_specs(V.rnd(spark, d), order_bounds(spark))


@query("ag28_probe_health", f"with {LOG} select day_utc, count(*) as n, count(*) filter (exit_code = 0)::double / count(*) as ok_share, count(distinct case when exit_code <> 0 then kind end) as gap_names from log group by 1")
def ag28(spark, d):
    return G.probe_health(V.log(spark, d), ["day_utc"], F.col("exit_code") == 0, "kind")


@query("ag29_measurement_days", f"""with {LOG}, o as (select event_id, ts, day_utc, kind as source, case when exit_code = 0 then 'ok' when round = 0 then 'late' else 'failed' end as status from log), e as (select day_utc, source, status, count(*) as n from o group by all),
m as (select day_utc, string_agg(source || ':' || status || '=' || n, ',' order by source || ':' || status) as counts, coalesce(string_agg(distinct source, ',' order by source) filter (status <> 'ok'), '') as gaps from e group by 1)
select day_utc, (select count(*) from o where o.day_utc = m.day_utc) as observations, (select arg_max(status, epoch_us(ts)::hugeint * 1000000 + event_id) from o where o.day_utc = m.day_utc) as latest, counts, gaps from m""")
def ag29(spark, d):
    rows = V.log(spark, d).withColumn("source", F.col("kind")).withColumn("status", F.expr("case when exit_code = 0 then 'ok' when round = 0 then 'late' else 'failed' end"))
    m = G.measurement_days(rows)
    return m.select("day_utc", "observations", "latest", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("counts"), F.array_join("gaps", ",").alias("gaps"))


_KINDS = ["status", "skip", "quota", "publish", "doctor"]


@query("ag29_observation_days", f"""with {LOG}, o as (select event_id, ts, day_utc as day, round, exit_code, row_id, kind, case when exit_code = 0 then 'ok' when round = 0 then 'disabled' else 'partial' end as status, case when round <> 2 then 'available' end as quota, case when round = 1 then 'live' end as capture,
  case when exit_code = 0 then 'published' end as publish, case round when 0 then 'ok' when 1 then 'warn' else 'fail' end as doctor, row_id % 4 as missed, case when row_id % 5 = 0 then 'clock_skew' else 'ok' end as clock from log),
x as (select day, 'status' as kind, 'log:' || status as key, 1 as n from o union all select day, 'status', kind || ':ok', 1 from o union all select day, 'skip', 'log:stale', round from o where exit_code = 1 union all select day, 'skip', 'log:malformed', row_id from o where exit_code = 1
  union all select day, 'quota', 'a:quota:' || coalesce(quota, 'unavailable'), 1 from o union all select day, 'quota', 'a:remaining:ok', 1 from o union all select day, 'quota', 'a:capture:' || coalesce(capture, 'not_applicable'), 1 from o union all select day, 'publish', coalesce(publish, 'never'), 1 from o union all select day, 'doctor', doctor, 1 from o),
c as (select day, kind, key, sum(n)::bigint as n from x group by all), l as (select * from o qualify row_number() over (partition by day order by ts desc, event_id desc) = 1),
e as (select day, count(*) as observations, min(epoch_us(ts)) as first_at, max(epoch_us(ts)) as last_at from o group by 1)
select e.day, observations, first_at, last_at, {", ".join(f"coalesce((select string_agg(key || '=' || n, ',' order by key) from c where c.day = e.day and c.kind = '{k}'), '') as {k}_counts" for k in _KINDS)}, l.event_id as latest_id, coalesce(l.publish, '') as latest_publish,
  array_to_string(list_sort(list_filter([case when l.status = 'partial' then 'source_log_partial' end, case when l.quota is null then 'quota_a_unavailable' end, case when l.missed <> 0 then 'collection_cadence_gap' end, case when l.clock = 'clock_skew' then 'clock_skew' end, case when l.doctor = 'fail' then 'doctor_failure' end], lambda x: x is not null)), ',') as latest_gaps
from e join l using (day)""")
def ag29b(spark, d):
    """Each event as one observation of two sources and a vendor."""
    log, bad = V.log(spark, d), F.col("exit_code") == 1
    skips = F.when(bad, F.create_map(F.lit("stale"), F.col("round").cast("long"), F.lit("malformed"), F.col("row_id").cast("long")))
    source = lambda name, status, skips: F.struct(name.alias("name"), status.alias("status"), skips.cast("map<string, bigint>").alias("skips"))
    text = lambda sql: F.expr(sql)
    rows = log.select(
        "event_id", F.col("day_utc").alias("day"), F.unix_micros("ts").alias("at"), F.array(source(F.lit("log"), text("case when exit_code = 0 then 'ok' when round = 0 then 'disabled' else 'partial' end"), skips), source(F.col("kind"), F.lit("ok"), F.lit(None))).alias("sources"),
        F.array(F.struct(F.lit("a").alias("name"), text("case when round <> 2 then 'available' end").alias("quota"), F.lit("ok").alias("remaining"), text("case when round = 1 then 'live' end").alias("capture"))).alias("vendors"),
        F.when(~bad, "published").alias("publish"), text("case round when 0 then 'ok' when 1 then 'warn' else 'fail' end").alias("doctor"), F.lit(None).cast("string").alias("cadence"), text("row_id % 4").alias("missed"), text("case when row_id % 5 = 0 then 'clock_skew' else 'ok' end").alias("clock"),
    )
    m = G.fold_observations(rows, "day", ["at", "event_id"])
    shown = [F.array_join(F.transform(F.map_entries(f"{k}_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias(f"{k}_counts") for k in _KINDS]
    return m.select("day", "observations", "first_at", "last_at", *shown, F.col("latest.event_id").alias("latest_id"), F.coalesce("latest.publish", F.lit("")).alias("latest_publish"), F.array_join("latest.gaps", ",").alias("latest_gaps"))


@query("ag30_attention_totals", f"with {ATT}, g as (select project_id, sum(end_us - start_us)::bigint as m, coalesce(sum(end_us - start_us) filter (mode = 'rework'), 0)::bigint as r, coalesce(sum(end_us - start_us) filter (mode in ('plan', 'review')), 0)::bigint as s from att group by 1) select sum(m)::double / 3600000000.0::double as hours, sum(s)::double / 3600000000.0::double as stewardship, sum(r)::double / sum(m)::double as rework_share, max(m)::double / sum(m)::double as top_share, count(*) as projects from g")
def ag30(spark, d):
    return G.attention_totals(V.att(spark, d), "project_id", F.col("end_us") - F.col("start_us"), "mode", ["plan", "review"], ["rework"])


@query("ag31_quota_status", f"with {LOG}, q as (select row_id as provider, case when k = 3 then 'error' when k = 4 then 'stale' when k = 5 then 'retained' else 'available' end as state, used from (select row_id, exit_code + round * 3 as k, round * 30 as used from log)) select provider, case when count(*) filter (state = 'retained') > 0 then 'retained' when count(*) filter (state = 'available') > 0 then 'available' when count(*) filter (state = 'stale') > 0 then 'stale' else 'error' end as status, min(100 - used) filter (state <> 'error') as remaining from q group by 1")
def ag31(spark, d):
    q = V.log(spark, d).selectExpr("row_id as provider", "case exit_code + round * 3 when 3 then 'error' when 4 then 'stale' when 5 then 'retained' else 'available' end as state", "round * 30 as used")
    return G.quota_status(q, ["provider"])


@query("ag32_latest", f"with {_QUOTA} select event_id % 9 as provider, max(observed_at) as observed_at, arg_max(event_id, observed_at * 1000000 + event_id) as event_id from quota group by 1")
def ag32(spark, d):
    q = quota(spark, d).withColumn("provider", F.col("event_id") % 9)
    return G.latest(q, ["provider"], ["observed_at", "event_id"], ["observed_at", "event_id"])


@query("ag33_growth", f"""with f as (select n_chars as size, date '2024-01-01' + cast(doc_id % 300 as integer) as day from documents), g as (select sum(size)::bigint as bytes, min(day) as oldest, max(day) as newest, coalesce(sum(size) filter (day > date '2024-11-01' - 30), 0)::bigint as recent_bytes from f)
select *, recent_bytes / 30 as per_day, bytes + cast(ceil(recent_bytes / 30 * 365) as bigint) as year_bound, case when recent_bytes > 0 then cast(floor(1000000000 / (recent_bytes / 30)) as bigint) end as runway_days from g""")
def ag33(spark, d):
    f = V.read(spark, d, "documents").select(F.col("n_chars").alias("size"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 300).cast("int")).alias("day"))
    return G.growth(f, "size", "day", "2024-11-01", 30, 1_000_000_000)


@query("ag34_worst_status", f"with {LOG} select row_id, case max(case exit_code + round when 3 then 2 when 2 then 1 else 0 end) when 2 then 'fail' when 1 then 'warn' else 'ok' end as status, count(*) as checks from log group by 1")
def ag34(spark, d):
    return G.worst_status(V.log(spark, d).withColumn("status", F.expr("case exit_code + round when 3 then 'fail' when 2 then 'warn' else 'ok' end")), ["row_id"])


@query("ag35_set_digest", "select count(*) as n, coalesce(sum(('0x' || substr(md5(o_orderkey || chr(0) || o_custkey || chr(0) || o_orderstatus || chr(0) || cast(o_orderdate as date) || chr(0) || o_orderpriority), 1, 15))::bigint), 0)::varchar as digest from orders")
def ag35(spark, d):
    o = V.read(spark, d, "orders").withColumn("o_orderdate", F.to_date("o_orderdate"))
    return G.set_digest(o, ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"])
