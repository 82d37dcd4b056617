"""Queries for ordered rows, intervals and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as I
from ..operators import ranking as R
from ..operators import sequence as W
from . import standins as V
from .standins import ATT, LOG, OBS, RND

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def seconds(spark, d):
    """The log with whole seconds ``at``."""
    return V.log(spark, d).withColumn("s_at", F.unix_seconds("ts"))


SEC = LOG + ", sec as (select *, cast(floor(epoch_us(ts) / 1000000.0) as bigint) as s_at from log)"


@query("w01_carry_forward", f"with {OBS} select event_id, last_value(case when model <> 'error' then model end ignore nulls) over (partition by session_id order by ts, event_id rows between unbounded preceding and current row) as model from obs")
def w01(spark, d):
    rows = V.obs(spark, d).withColumn("model", F.when(F.col("model") != "error", F.col("model")))
    rows = rows.withColumn("day", F.to_date("ts"))
    return W.carry_forward(rows, ["session_id"], ["ts", "event_id"], ["model"], block="day").select("event_id", "model")


@query("w02_cumulative_delta", f"with {OBS}, c as (select event_id, ts, session_id, case when event_id % 50 = 0 then 0 else sum(input_tokens) over (partition by session_id order by ts, event_id rows between unbounded preceding and current row) end as total from obs) select event_id, cast(greatest(total - lag(total, 1, 0) over (partition by session_id order by ts, event_id), 0) as bigint) as total_delta from c")
def w02(spark, d):
    running = F.sum("input_tokens").over(W._window(["session_id"], ["ts", "event_id"]).rowsBetween(W.Window.unboundedPreceding, 0))
    rows = V.obs(spark, d).withColumn("total", F.when(F.col("event_id") % 50 == 0, F.lit(0)).otherwise(running))
    rows = rows.withColumn("day", F.to_date("ts"))
    return W.cumulative_delta(rows, ["session_id"], ["ts", "event_id"], ["total"], block="day").select("event_id", F.col("total_delta").cast("long").alias("total_delta"))


@query("w03_first_of_signature", "select doc_id, source from (select doc_id, source, row_number() over (partition by text order by doc_id) as n from documents) where n = 1")
def w03(spark, d):
    docs = V.read(spark, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("signature"))
    return W.keep_first(docs, ["signature"], ["doc_id"]).select("doc_id", "source")


@query("w04_latest_snapshot", "select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as n from orders) where n = 1")
def w04(spark, d):
    return W.keep_last(V.read(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("w05_previous_mark", f"with {RND} select order_id, cast(lag(round * 10, 1, 0) over (partition by spec order by round) as bigint) as previous from rnd")
def w05(spark, d):
    rows = V.rnd(spark, d).withColumn("mark", (F.col("round") * 10).cast("long"))
    return W.previous_mark(rows, ["spec"], ["round"], "mark").select("order_id", "previous")


@query("w06_dedup_cross_source", "select event_id, min(f) as file_id from (select event_id, 1 as f from events union all select event_id, 0 from events where event_id % 10 = 0) group by 1")
def w06(spark, d):
    e = V.read(spark, d, "events").select("event_id")
    both = e.withColumn("file_id", F.lit(1)).unionByName(e.filter("event_id % 10 = 0").withColumn("file_id", F.lit(0)))
    return W.dedup_events(both, "event_id", ["file_id"])


@query("w07_flag_overlaps", f"with {ATT} select a.event_id, exists (select 1 from att b where b.lane = a.lane and b.event_id <> a.event_id and b.start_us < a.end_us and b.end_us > a.start_us and b.end_us > b.start_us and a.end_us > a.start_us) as overlaps from att a")
def w07(spark, d):
    return I.flag_overlaps(V.att(spark, d), "lane", "start_us", "end_us", "event_id").select("event_id", "overlaps")


@query("w08_transitions", f"with {ATT}, t as (select cast(make_timestamp(start_us) as date) as day, project_id, lag(project_id) over (partition by cast(make_timestamp(start_us) as date) order by start_us, event_id) as f from att) select day, project_id, count(*) as transitions_in from t where f <> project_id group by all")
def w08(spark, d):
    rows = V.att(spark, d).withColumn("day", F.to_date(F.timestamp_micros("start_us")))
    return I.transitions(rows, "day", "project_id", ["start_us", "event_id"])


@query("w09_match_fifo", f"""with {SEC}, s as (select *, sum(case kind when 'dispatch' then 1 else -1 end) over (partition by row_id, round order by s_at, event_id rows between unbounded preceding and current row) as s from sec where kind in ('dispatch', 'verdict')),
m as (select *, kind = 'verdict' and s < least(coalesce(min(s) over (partition by row_id, round order by s_at, event_id rows between unbounded preceding and 1 preceding), 0), 0) as lost from s),
r as (select *, row_number() over (partition by row_id, round, kind order by s_at, event_id) as pair from m where not lost)
select row_id, round, pair, max(case when kind = 'dispatch' then s_at end) as opened_at, max(case when kind = 'verdict' then s_at end) as closed_at from r group by all""")
def w09(spark, d):
    return W.match_fifo(seconds(spark, d), ["row_id", "round"], ["s_at", "event_id"], "kind", "dispatch", "verdict", "s_at")


@query("w10_elapsed_to_terminal", f"with {SEC}, g as (select row_id, min(case when kind = 'merged' then s_at end) - min(s_at) as s from sec group by 1) select row_id, least(greatest(s, 0), 86400) as seconds, coalesce(s > 86400, false) as clamped from g")
def w10(spark, d):
    return W.elapsed_to_terminal(seconds(spark, d), "row_id", "s_at", "kind", ["merged"], 86400)


@query("w11_gap_since_previous", f"with {SEC}, g as (select *, s_at - lag(s_at) over (partition by row_id order by s_at, event_id) as gap from sec) select event_id, gap from g where kind = 'proof' and gap >= 0 and gap < 7200")
def w11(spark, d):
    return W.gap_since_previous(seconds(spark, d), "row_id", ["s_at", "event_id"], "s_at", "kind", "proof", 7200).select("event_id", "gap")


@query("w12_phase_durations", f"""with {SEC}, p as (select *, case when kind = 'step' and state in ('BUILD', 'REPAIR') then 'build' when kind = 'dispatch' then 'judge' end as phase, min(case when kind = 'merged' and exit_code = 1 then s_at end) over (partition by row_id) as stop from sec),
n as (select *, first_value(case when phase is not null then s_at end ignore nulls) over w as opener, first_value(case when kind = 'merged' then s_at end ignore nulls) over w as merged, first_value(case when kind in ('merged', 'verdict') then s_at end ignore nulls) over w as judged from p window w as (partition by row_id order by s_at, event_id rows between 1 following and unbounded following)),
e as (select *, least(opener, case phase when 'build' then merged when 'judge' then judged end, stop) as ended from n)
select row_id, phase, sum(ended - s_at)::bigint as seconds, count(*) as parts from e where phase is not null and ended is not null and ended >= s_at group by all""")
def w12(spark, d):
    kind = F.col("kind")
    phase = F.when((kind == "step") & F.col("state").isin("BUILD", "REPAIR"), "build").when(kind == "dispatch", "judge")
    ends = {"build": kind == "merged", "judge": kind.isin("merged", "verdict")}
    return W.phase_durations(seconds(spark, d), "row_id", ["s_at", "event_id"], "s_at", phase, ends, (kind == "merged") & (F.col("exit_code") == 1))


_NOW = 1706659200


@query("w13_cadence_gaps", f"""with {SEC}, d as (select distinct kind, row_id, s_at from sec), g as (select kind, row_id, lag(s_at) over (partition by kind, row_id order by s_at) as since, s_at - lag(s_at) over (partition by kind, row_id order by s_at) as gap from d),
b as (select kind, row_id, since, gap, cast(greatest(1, floor(gap / 1800.0) - 1) as bigint) as missed, false as open from g where gap > 2700 union all
  select kind, row_id, max(s_at), {_NOW} - max(s_at), cast(greatest(1, floor(({_NOW} - max(s_at)) / 1800.0)) as bigint), true from d group by all having {_NOW} - max(s_at) > 2700)
select * from b qualify row_number() over (partition by kind, row_id order by since desc) <= 20""")
def w13(spark, d):
    return W.cadence_gaps(seconds(spark, d), ["kind", "row_id"], "s_at", 1800, 2700, _NOW)


@query("w14_bucket_series", f"""with {RND}, days as (select builder, ended_on, row_number() over (partition by builder order by ended_on) - 1 as i, count(*) over (partition by builder) as n from (select distinct builder, ended_on from rnd)),
b as (select builder, ended_on, cast(floor(i / ceil(n / 48.0)) as bigint) as bucket from days)
select builder, bucket, min(ended_on) as first_day, max(ended_on) as last_day, sum(cents)::bigint as cents, sum(findings)::bigint as findings, quantile_cont(raw_days::double, 0.5) as median from rnd join b using (builder, ended_on) group by all""")
def w14(spark, d):
    return W.bucket_series(V.rnd(spark, d).withColumn("raw_days", F.col("raw_days").cast("double")), ["builder"], "ended_on", ["cents", "findings"], "raw_days")


BOUNDS = "bounds(window_key, part, from_day, to_day) as (values " + ", ".join(f"('{n}', 'current', date '2001-08-02' - {n - 1}, date '2001-08-02'), ('{n}', 'prior', date '2001-08-02' - {2 * n - 1}, date '2001-08-02' - {n})" for n in (7, 30, 90)) + ", ('all', 'current', date '1995-01-01', date '2001-08-02'))"


def order_bounds(spark):
    return W.bounds(spark, V.ORDERS_NOW, "1995-01-01")


@query("w15_prior_window_compare", f"""with {RND}, {BOUNDS}, g as (select window_key, part, sum(cents)::bigint as cents, count(*) filter (accepted) as accepted from rnd join bounds on ended_on between from_day and to_day group by all)
select b.window_key, c.cents, c.accepted, case when p.from_day >= date '2001-06-01' then q.cents end as prior_cents, case when p.from_day >= date '2001-06-01' then q.accepted end as prior_accepted
from bounds b left join g c on c.window_key = b.window_key and c.part = 'current' left join bounds p on p.window_key = b.window_key and p.part = 'prior' left join g q on q.window_key = b.window_key and q.part = 'prior' where b.part = 'current'""")
def w15(spark, d):
    return W.window_compare(V.rnd(spark, d), "ended_on", order_bounds(spark), {"cents": F.sum("cents"), "accepted": F.count_if("accepted")}, "2001-06-01")


@query("w16_dropoff", f"""with {RND}, {BOUNDS}, e as (select window_key, spec, bool_or(part = 'prior') as was, bool_or(part = 'current') as cur from rnd join bounds on ended_on between from_day and to_day where window_key <> 'all' group by all),
g as (select window_key, count(*) filter (was and not cur) as gone from e group by 1)
select b.window_key, case when from_day >= date '2001-06-01' then coalesce(gone, 0) end as dropped from bounds b left join g using (window_key) where part = 'prior'""")
def w16(spark, d):
    return W.dropoff(V.rnd(spark, d), "spec", "ended_on", order_bounds(spark), "2001-06-01")


@query("w17_staleness", f"with {SEC} select row_id, max(s_at) as last_at, {_NOW} - max(s_at) as age, {_NOW} - max(s_at) > 5400 as stalled from sec group by 1")
def w17(spark, d):
    return W.staleness(seconds(spark, d), ["row_id"], "s_at", _NOW, 5400)


_QUOTA = f"{SEC}, quota as (select event_id, case when event_id % 7 <> 0 then exit_code end as value, s_at + case when event_id % 11 = 0 then 86400 * 40 else 0 end as observed_at, s_at + 86400 * (case when event_id % 3 = 0 then -1 else 20 end) as resets_at, event_id % 5 <> 0 as captured from sec)"


def quota(spark, d):
    return seconds(spark, d).selectExpr("event_id", "case when event_id % 7 <> 0 then exit_code end as value", "s_at + case when event_id % 11 = 0 then 86400 * 40 else 0 end as observed_at", "s_at + 86400 * (case when event_id % 3 = 0 then -1 else 20 end) as resets_at", "event_id % 5 <> 0 as captured")


@query("w18_capacity_state", f"""with {_QUOTA} select event_id, case when value is null then case when captured then 'unavailable' else 'error' end when observed_at > {_NOW} then 'stale' when not captured then 'retained' when {_NOW} - observed_at >= 1296000 or (resets_at <= {_NOW} and observed_at <= resets_at) then 'stale' else 'available' end as state from quota""")
def w18(spark, d):
    return W.capacity_state(quota(spark, d), _NOW, 1296000).select("event_id", "state")


PARTS = f"""{ATT}, parts as (select event_id, project_id, mode, cast(make_timestamp(x * 86400000000) as date) as day, greatest(start_us, x * 86400000000) as part_start, least(end_us, (x + 1) * 86400000000) as part_end
  from (select *, unnest(range(cast(floor(start_us / 86400000000.0) as bigint), cast(floor((end_us - 1) / 86400000000.0) as bigint) + 1)) as x from att where end_us > start_us))"""


@query("iv01_split_at_midnight", f"with {PARTS} select event_id, day, part_start, part_end from parts")
def iv01(spark, d):
    return I.split_at_midnight(V.att(spark, d), "start_us", "end_us").select("event_id", "day", "part_start", "part_end")


@query("iv02_date_span", f"with {ATT} select event_id, cast(make_timestamp(start_us) as date) as first_day, cast(make_timestamp(greatest(end_us - 1, start_us)) as date) as last_day, cast(date_diff('day', cast(make_timestamp(start_us) as date), cast(make_timestamp(greatest(end_us - 1, start_us)) as date)) + 1 as integer) as n_days from att")
def iv02(spark, d):
    return I.date_span(V.att(spark, d), "start_us", "end_us").select("event_id", "first_day", "last_day", "n_days")


@query("iv03_overlaps_by_lane", f"with {ATT} select lane, count(distinct a.event_id) as n from att a join att b using (lane) where a.event_id <> b.event_id and a.start_us < b.end_us and a.end_us > b.start_us and a.end_us > a.start_us and b.end_us > b.start_us group by 1")
def iv03(spark, d):
    return I.flag_overlaps(V.att(spark, d), "lane", "start_us", "end_us", "event_id").filter("overlaps").groupBy("lane").agg(F.count(F.lit(1)).alias("n"))


@query("iv04_overlap_with_margin", f"with {ATT} select a.event_id as left_id, b.event_id as right_id from att a join att b using (project_id) where a.mode = 'plan' and b.mode = 'guide' and a.start_us <= b.end_us + 300000000 and a.end_us >= b.start_us - 300000000")
def iv04(spark, d):
    a = V.att(spark, d).filter("mode = 'plan'").selectExpr("project_id", "event_id as left_id", "start_us as s1", "end_us as e1")
    b = V.att(spark, d).filter("mode = 'guide'").selectExpr("project_id", "event_id as right_id", "start_us as s2", "end_us as e2")
    return I.overlap_pairs(a, b, ["project_id"], ("s1", "e1"), ("s2", "e2"), margin=300_000_000, bin=I.HOUR).select("left_id", "right_id")


@query("tk01_top_n_plus_other", f"""with {RND}, g as (select builder, spec, sum(cents)::bigint as cents, count(*) as n from rnd group by all), r as (select *, row_number() over (partition by builder order by cents desc, spec) as rn from g)
select builder, cast(least(rn, 7) as integer) as position, case when min(rn) <= 6 then min(cast(spec as varchar)) else 'other' end as label, sum(cents)::bigint as cents, sum(n)::bigint as n, count(*) filter (rn > 6) as other_count from r group by builder, least(rn, 7)""")
def tk01(spark, d):
    g = V.rnd(spark, d).groupBy("builder", "spec").agg(F.sum("cents").alias("cents"), F.count(F.lit(1)).alias("n"))
    return R.top_n_plus_other(g, ["builder"], "spec", "cents", ["n"])


@query("tk02_top_n_nullable", f"""with {ATT}, g as (select lane, project_id, sum(case when project_id < 10 then end_us - start_us end)::bigint as micros, count(*) as n from att group by all), r as (select *, row_number() over (partition by lane order by micros desc nulls last, project_id) as rn from g)
select lane, cast(least(rn, 4) as integer) as position, case when min(rn) <= 3 then min(cast(project_id as varchar)) else 'other' end as label, sum(micros)::bigint as micros, sum(n)::bigint as n, count(*) filter (rn > 3) as other_count from r group by lane, least(rn, 4)""")
def tk02(spark, d):
    g = V.att(spark, d).groupBy("lane", "project_id").agg(F.sum(F.when(F.col("project_id") < 10, F.col("end_us") - F.col("start_us"))).alias("micros"), F.count(F.lit(1)).alias("n"))
    return R.top_n_plus_other(g, ["lane"], "project_id", "micros", ["n"], n=3, nulls=True)


@query("tk03_recent_n", "select o_custkey, max(cast(o_orderdate as date)) as latest from orders group by 1 order by latest desc, o_custkey desc limit 6")
def tk03(spark, d):
    g = V.read(spark, d, "orders").groupBy("o_custkey").agg(F.max(F.to_date("o_orderdate")).alias("latest"))
    return R.recent_n(g, [F.col("latest").desc(), F.col("o_custkey").desc()])


@query("tk04_select_windows", """with g as (select p_brand, p_type, max(p_size)::bigint as size from part group by all), r as (select *, case p_type when 'STANDARD' then 0 when 'SMALL' then 1 else 2 end as p, row_number() over (partition by p_brand order by size, p_type) as u, row_number() over (partition by p_brand order by size desc, p_type desc) as d from g)
select p_brand, p_type, size from r qualify row_number() over (partition by p_brand order by p, case when u = 1 then 0 when d = 1 then 1 else u end, p_type) <= 2""")
def tk04(spark, d):
    g = V.read(spark, d, "part").groupBy("p_brand", "p_type").agg(F.max("p_size").cast("long").alias("size"))
    return R.select_windows(g, ["p_brand"], "p_type", "size", ["STANDARD", "SMALL"])


@query("tk05_stable_order", "select row_number() over (order by c_mktsegment, c_nationkey desc, c_custkey) as place, c_custkey from customer")
def tk05(spark, d):
    return R.place_in_order(V.read(spark, d, "customer"), {"c_mktsegment": True, "c_nationkey": False}, ["c_custkey"]).select("place", "c_custkey")


@query("tk06_latest_of_series", f"with {OBS} select session_id, max_by(event_id, ts::varchar || lpad(event_id::varchar, 12, '0')) as event_id from obs group by 1")
def tk06(spark, d):
    return V.obs(spark, d).groupBy("session_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("tk07_older_than", "select o_orderkey from orders where o_custkey in (select o_custkey from orders group by 1 having max(cast(o_orderdate as date)) < date '2001-08-02' - 400)")
def tk07(spark, d):
    rows = V.read(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    return R.older_than(rows, "day", V.ORDERS_NOW, 400, unit="o_custkey").select("o_orderkey")
