"""Queries for data quality, sinks and the report of windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as I
from ..operators import quality as Q
from ..operators import ranking as R
from ..operators import reports
from ..operators import rollups as G
from ..operators.graph import kept
from . import standins as V
from .q_scalars import _RE2
from .q_sequence import BOUNDS, PARTS, order_bounds
from .standins import ATT, LOG, OBS, RND

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


_SCHEMA = {
    "additionalProperties": False,
    "required": ["c_custkey", "c_name", "tier"],
    "properties": {
        "c_custkey": {"type": "integer", "minimum": 10},
        "c_name": {"type": "string", "minLength": 5, "pattern": "[02468]$"},
        "c_mktsegment": {"type": "string", "enum": ["BUILDING", "MACHINERY", "FURNITURE"]},
        "c_acctbal": {"type": "integer"},
        "version": {"type": "integer", "const": 1},
    },
}


@query("dq01_validate", """select c_custkey, unnest(list_filter(['additional:c_nationkey', 'required:tier', case when c_custkey < 10 then 'minimum:c_custkey' end, case when not regexp_matches(c_name, '[02468]$') then 'pattern:c_name' end, case when c_mktsegment not in ('BUILDING', 'MACHINERY', 'FURNITURE') then 'enum:c_mktsegment' end, 'type:c_acctbal', case when c_custkey % 7 <> 1 then 'const:version' end], lambda x: x is not null)) as violation from customer""")
def dq01(spark, d):
    return Q.validate(V.read(spark, d, "customer").withColumn("version", F.col("c_custkey") % 7), _SCHEMA, ["c_custkey"])


@query("dq02_invariants", f"with {ATT}, g as (select project_id, sum(end_us - start_us)::bigint as total, sum(end_us - start_us) filter (mode <> 'direct')::bigint as parts, count(*) as n from att group by 1) select project_id, unnest(list_filter([case when not coalesce(total = parts, false) then 'total is the sum of modes' end, case when n % 2 <> 0 then 'even' end], lambda x: x is not null)) as rule from g")
def dq02(spark, d):
    size = F.col("end_us") - F.col("start_us")
    g = V.att(spark, d).groupBy("project_id").agg(F.sum(size).alias("total"), F.sum(F.when(F.col("mode") != "direct", size)).alias("parts"), F.count(F.lit(1)).alias("n"))
    return Q.check_invariants(g, {"total is the sum of modes": F.col("total") == F.col("parts"), "even": F.col("n") % 2 == 0}, ["project_id"])


@query("dq03_reconcile", """with o as (select count(*) as n, sum(cast(round(o_totalprice * 100) as bigint))::bigint as cents from orders), l as (select count(distinct l_orderkey) as n, sum(cast(round(l_extendedprice * 100) as bigint))::bigint as cents from lineitem)
select 'n' as measure, o.n as orders, o.n as by_day, l.n as lines, greatest(o.n, l.n) - least(o.n, l.n) <= 0 as agrees from o, l union all select 'cents', o.cents, o.cents, l.cents, abs(o.cents - l.cents) <= 0 from o, l""")
def dq03(spark, d):
    o = V.read(spark, d, "orders").select(F.round(F.col("o_totalprice") * 100).cast("long").alias("c"), F.lit(1).alias("k"), "o_orderdate")
    li = V.read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("c"), F.lit(1).alias("k"))
    by_day = o.groupBy("o_orderdate").agg(F.sum("c").alias("c"), F.sum("k").alias("k"))
    return Q.reconcile({"orders": o, "by_day": by_day, "lines": li}, {"n": F.sum("k"), "cents": F.sum("c")})


@query("dq04_manifest", "select 'orders' as dataset, count(*) as n, min(cast(o_orderdate as date)) as covers_from, max(cast(o_orderdate as date)) as covers_to from orders union all select 'events', count(*), min(cast(ts as date)), max(cast(ts as date)) from events union all select 'customer', count(*), null, null from customer")
def dq04(spark, d):
    return Q.manifest({"orders": (V.read(spark, d, "orders"), "o_orderdate"), "events": (V.read(spark, d, "events"), "ts"), "customer": (V.read(spark, d, "customer"), None)})


_DIGEST = "coalesce(sum(('0x' || substr(md5({}), 1, 15))::bigint), 0)::varchar"


@query("dq04_manifest_check", f"""with o as (select *, year(cast(o_orderdate as date))::varchar as part, o_custkey + case when o_orderkey % 1000 = 7 and year(cast(o_orderdate as date)) = 1995 then 1 else 0 end as other from orders),
stored as (select 'orders' as dataset, part, count(*) as n, {_DIGEST.format("o_orderkey || chr(0) || other || chr(0) || o_orderstatus")} as digest from o where part <> '1993' group by 2 union all select 'customer', 'all', count(*), {_DIGEST.format("c_custkey || chr(0) || c_mktsegment")} from customer union all select 'old', 'all', 1, '5'),
fresh as (select 'orders' as dataset, part, count(*) as n, {_DIGEST.format("o_orderkey || chr(0) || o_custkey || chr(0) || o_orderstatus")} as digest from o group by 2 union all select 'customer', 'all', count(*), {_DIGEST.format("c_custkey || chr(0) || c_mktsegment")} from customer)
select coalesce(s.dataset, f.dataset) as dataset, coalesce(s.part, f.part) as part, case when s.n is null then 'added' when f.n is null then 'gone' when s.n = f.n and s.digest = f.digest then 'same' else 'changed' end as state, s.n as stored_n, f.n as n
from stored s full join fresh f on s.dataset = f.dataset and s.part = f.part""")
def dq04b(spark, d):
    o = V.read(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    then = o.filter("year <> 1993").withColumn("o_custkey", F.col("o_custkey") + F.when((F.col("o_orderkey") % 1000 == 7) & (F.col("year") == 1995), 1).otherwise(0))
    c = (V.read(spark, d, "customer"), ["c_custkey", "c_mktsegment"], None)
    of = lambda rows: Q.digests({"orders": (rows, ["o_orderkey", "o_custkey", "o_orderstatus"], "year"), "customer": c})
    to = _folder(spark, "manifest")
    of(then).unionByName(spark.sql("select 'old' as dataset, 'all' as part, 1L as n, '5' as digest")).write.parquet(to)
    return Q.verify_manifest(spark.read.parquet(to), of(o))


@query("dq05_public_projection", "select c_custkey, c_mktsegment, c_nationkey from customer")
def dq05(spark, d):
    return Q.project_public(V.read(spark, d, "customer"), ["c_custkey", "c_mktsegment", "c_nationkey", "not_there"])


_TEXTS = "t as (select text from documents union all select html from pages union all select text from conversations)"


@query("dq06_privacy_report", f"with {_TEXTS} select reason, count(*) as n from (select unnest(list_filter([" + ", ".join(f"case when regexp_matches(text, '{p}') then '{c}' end" for c, p in sorted(_RE2.items())) + "], lambda x: x is not null)) as reason from t) group by 1")
def dq06(spark, d):
    t = V.read(spark, d, "documents").select("text").unionByName(V.read(spark, d, "pages").select(F.col("html").alias("text"))).unionByName(V.read(spark, d, "conversations").select("text"))
    return Q.privacy_report(t, "text")


@query("dq07_freshness", "select o_custkey, max(cast(o_orderdate as date)) as newest, cast(date_diff('day', max(cast(o_orderdate as date)), date '2001-08-02') as integer) as age_days, date_diff('day', max(cast(o_orderdate as date)), date '2001-08-02') > 90 as stale from orders group by 1")
def dq07(spark, d):
    return Q.freshness(V.read(spark, d, "orders").withColumn("day", F.to_date("o_orderdate")), ["o_custkey"], "day", V.ORDERS_NOW, 90)


@query("dq08_version_agreement", "select count(distinct c_nationkey // 100) <= 1 as agrees, count(distinct c_nationkey // 100) as versions from customer")
def dq08(spark, d):
    return Q.version_agreement(V.read(spark, d, "customer").withColumn("v", F.expr("c_nationkey div 100")), "v")


@query("dq09_completeness", f"with {LOG} select kind, count(*) filter (row_id % 2 = 0) as enabled, count(*) filter (row_id % 2 = 0 and round < 2) as available, count(*) filter (row_id % 2 = 0 and exit_code = 1) as errors, count(*) filter (row_id % 2 = 0) = count(*) filter (row_id % 2 = 0 and round < 2) and count(*) filter (row_id % 2 = 0 and exit_code = 1) = 0 as complete from log group by 1")
def dq09(spark, d):
    return Q.completeness(V.log(spark, d), ["kind"], F.col("row_id") % 2 == 0, F.col("round") < 2, F.col("exit_code") == 1)


def _folder(spark, name: str) -> str:
    """A folder of our own in the shared one."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("dq10_write_lines", "select c_custkey, c_mktsegment, c_name from customer")
def dq10(spark, d):
    to = _folder(spark, "lines")
    Q.write_lines(V.read(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_name"), to, ["c_custkey"])
    return spark.read.schema("c_custkey long, c_mktsegment string, c_name string").json(to)


@query("dq11_history_days", "select cast(ts as date) as day, event_id % 3 as part, count(*) as n, 1 + (cast(ts as date) >= date '2024-01-25')::integer as version from events group by all")
def dq11(spark, d):
    e = V.read(spark, d, "events").groupBy(F.to_date("ts").alias("day"), (F.col("event_id") % 3).alias("part")).agg(F.count(F.lit(1)).alias("n"))
    to = _folder(spark, "history")
    Q.write_days(e.withColumn("version", F.lit(1)), to, "day", ["part"])
    Q.write_days(e.filter("day >= date '2024-01-25'").withColumn("version", F.lit(2)), to, "day", ["part"])
    return spark.read.schema("part long, n long, version int, day date").parquet(to).select("day", "part", "n", "version")


@query("dq12_definitions_complete", "select 'fields' as check, count(*) as n, count(*) filter (p_name is not null and p_type is not null and p_brand is not null and p_size is not null) as complete, count(distinct p_partkey) = count(*) as ids_unique from part")
def dq12(spark, d):
    """The catalogue check over part as metric rows: all fields present, ids unique."""
    p = V.read(spark, d, "part")
    ok = F.col("p_name").isNotNull() & F.col("p_type").isNotNull() & F.col("p_brand").isNotNull() & F.col("p_size").isNotNull()
    return p.agg(F.lit("fields").alias("check"), F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("complete"), (F.count_distinct("p_partkey") == F.count(F.lit(1))).alias("ids_unique"))


@query("dq13_refuse_older", "select event_id, 'newer' as batch from events where ts >= timestamp '2024-01-20' union all select event_id, 'older' from events where false")
def dq13(spark, d):
    e = V.read(spark, d, "events")
    stored = e.filter("ts < timestamp_ntz '2024-01-20 00:00:00'")
    newer = Q.refuse_older(e.filter("ts >= timestamp_ntz '2024-01-20 00:00:00'"), "ts", stored).select("event_id", F.lit("newer").alias("batch"))
    older = Q.refuse_older(e.filter("ts < timestamp_ntz '2024-01-05 00:00:00'"), "ts", stored).select("event_id", F.lit("older").alias("batch"))
    return newer.unionByName(older)


_METRICS = ["rounds", "cents", "findings", "accepted", "specs"]


@query("dq14_windows_report", f"""with {RND}, {BOUNDS}, g as (select window_key, part, count(*)::bigint as rounds, sum(cents)::bigint as cents, sum(findings)::bigint as findings, count(*) filter (accepted)::bigint as accepted, count(distinct spec)::bigint as specs from rnd join bounds on ended_on between from_day and to_day group by all),
t as (select window_key, part, spec, sum(cents)::bigint as cents, row_number() over (partition by window_key, part order by sum(cents) desc, spec) as rn from rnd join bounds on ended_on between from_day and to_day group by window_key, part, spec)
select window_key, part, unnest([{', '.join(f"'{m}'" for m in _METRICS)}]) as metric, unnest([{', '.join(_METRICS)}]) as value from g
union all select window_key, part, 'top:' || case when min(rn) <= 6 then min(cast(spec as varchar)) else 'other' end, sum(cents)::bigint from t group by window_key, part, least(rn, 7)""")
def dq14(spark, d):
    r, w = V.rnd(spark, d), order_bounds(spark)
    g = G.window_sums(r, "ended_on", w, {"rounds": F.count(F.lit(1)), "cents": F.sum("cents"), "findings": F.sum("findings"), "accepted": F.count_if("accepted"), "specs": F.count_distinct("spec")})
    by_spec = G.window_sums(r, "ended_on", w, {"cents": F.sum("cents")}, ["spec"])
    top = R.top_n_plus_other(by_spec, ["window_key", "part"], "spec", "cents", [])
    return Q.unpivot_windows(g, ["window_key", "part"], _METRICS).unionByName(top.select("window_key", "part", F.concat(F.lit("top:"), "label").alias("metric"), F.col("cents").alias("value")))


_TODAY = "2024-02-02"
_MODES = ["plan", "guide", "review", "rework", "direct"]
_R6 = "floor({} * 1e6::double + 0.5::double) / 1e6::double"


def _share(a: str, b: str) -> str:
    return f"case when {b} <> 0 then " + _R6.format(f"({a}::double / {b}::double)") + " end"


def _cells(source: str, rows: list[tuple[str, str, str, str]]) -> str:
    """SQL of one row for each (section, item, metric, value) of each row of a source."""
    return " union all ".join(f"select window_key, part, '{s}' as section, ({i})::varchar as item, '{m}' as metric, ({v})::double as value, null::varchar as text from {source}" for s, i, m, v in rows)


def _top_sql(name: str, source: str, key: str, value: str, measures: list[str], nulls: bool = False) -> str:
    sums = ", ".join((f"sum({m})" if nulls else f"coalesce(sum({m}), 0)") + f"::bigint as {m}" for m in measures)
    return f"""{name}_r as (select *, row_number() over (partition by window_key, part order by {value} desc nulls last, {key}) as rn from {source}),
{name} as (select window_key, part, least(rn, 7) as position, case when min(rn) <= 6 then min({key}) else 'other' end as label, {sums}, count(*) filter (rn > 6) as other_count from {name}_r group by window_key, part, least(rn, 7))"""


_USAGE_CELLS = [("summary", "''", m, f"coalesce({m}, 0)") for m in ("tokens", "session_days", "active_days", "projects")] + [("buckets", f"'{b}'", "tokens", f"coalesce(b{b}, 0)") for b in (0, 1)]
_OWN_CELLS = [("vendors", f"'{v}'", "tokens", f"coalesce({v}, 0)") for v in ("vendor_a", "vendor_b")] + [("hosts", f"'{h}'", "tokens", f"coalesce({h}, 0)") for h in ("wsl", "windows")]
_OUTCOME_CELLS = [("outcomes", "''", m, f"coalesce({m}, 0)") for m in ("accepted_specs", "specs", "rounds", "accepted_rounds", "findings", "cents")] + [("outcomes", "''", "efficiency", _share("accepted_specs", "specs")), ("outcomes", "''", "cents_per_accepted", _share("cents", "accepted_specs")), ("outcomes", "''", "median_duration", "median_duration")]
_HOURS = [("hours", "micros"), ("stewardship_hours", "(guide + review + rework)"), ("rework_hours", "rework")]
_ATTENTION_CELLS = [("attention", "''", n, _R6.format(f"({c}::double / 3600000000.0::double)")) for n, c in _HOURS] + [("attention", "''", "rework_share", _share("rework", "micros")), ("attention", "''", "transitions", "transitions_in"), ("attention", "''", "top_share", _share("top_micros", "micros")), ("attention", "''", "dropped_projects", "dropped")]
_ATTENTION_CELLS += [c for m in _MODES for c in (("modes", f"'{m}'", "micros", m), ("modes", f"'{m}'", "share", _share(m, "micros")))]
_LEDGER = ["micros", "transitions_in", *_MODES, "tokens", "sessions"]
_PRIOR = "select window_key, '{0}_prior', (from_day - n)::date, (from_day - 1)::date from base, cov where window_key <> 'all' and from_day - n >= {0}_from"


@query("dq14_window_sections", f"""with {OBS}, {RND}, {LOG}, {PARTS},
usage as (select day_utc as day, project_id::varchar as project_id, vendor, host_os, count(distinct session_id) as sessions, sum(input_tokens)::bigint as tokens from obs where day_utc is not null group by all),
rounds as (select ended_on + 8218 as day, spec::varchar as spec, round, accepted, verdict, cents, findings, case when raw_days between 0 and 60 then raw_days::double end as duration from rnd),
moves as (select day, project_id, lag(project_id) over (partition by day order by part_start, part_end, event_id) as f from parts), moved as (select day, project_id, count(*) as transitions_in from moves where f <> project_id group by all),
attention as (select p.day, p.project_id::varchar as project_id, sum(part_end - part_start)::bigint as micros, coalesce(any_value(transitions_in), 0) as transitions_in, {', '.join(f"coalesce(sum(part_end - part_start) filter (mode = '{m}'), 0)::bigint as {m}" for m in _MODES)} from parts p left join moved t on t.day = p.day and t.project_id = p.project_id group by p.day, p.project_id),
ext as (select (select min(day) from usage) as usage_from, (select min(day) from rounds) as rounds_from, (select min(day) from attention) as att_from, (select max(day) from attention) as att_to, (select greatest(max(day), date '{_TODAY}') from (select day from usage union all select day from rounds union all select day from attention)) as hi), cov as (select *, least(usage_from, rounds_from, att_from) as lo from ext),
base as (select k as window_key, from_day, hi as to_day, date_diff('day', from_day, hi)::integer + 1 as n, date_diff('day', from_day, hi)::integer // greatest(1, ceil((date_diff('day', from_day, hi) + 1) / 48.0))::integer as last_place, greatest(1, ceil((date_diff('day', from_day, hi) + 1) / 48.0))::integer as width from (select k, greatest(lo, (hi - s)::date) as from_day, hi from cov, (values ('7', 6), ('30', 29), ('90', 89), ('all', 100000)) v(k, s))),
win as (select window_key, 'current' as part, from_day, to_day from base union all {_PRIOR.format('usage')} union all {_PRIOR.format('rounds')}),
ends as (select window_key, (to_day - 1)::date as e, n from base, cov where window_key <> 'all' and att_from <= to_day - 2 * n and att_to >= to_day - 1),
u as (select * from usage join win on day between from_day and to_day and part in ('current', 'usage_prior')),
us as (select window_key, part, sum(tokens)::bigint as tokens, sum(sessions)::bigint as session_days, count(distinct case when tokens <> 0 or sessions <> 0 then day end) as active_days, count(distinct case when tokens <> 0 or sessions <> 0 then project_id end) as projects, sum(tokens) filter (vendor = 'vendor_a') as vendor_a, sum(tokens) filter (vendor = 'vendor_b') as vendor_b, sum(tokens) filter (host_os = 'wsl') as wsl, sum(tokens) filter (host_os = 'windows') as windows, sum(tokens) filter (project_id = '0') as b0, sum(tokens) filter (project_id = '1') as b1 from u group by all),
uw as (select window_key, part, us.* exclude (window_key, part) from win left join us using (window_key, part) where part in ('current', 'usage_prior')), uc as (select * from uw where part = 'current'),
up as (select window_key, part, project_id, sum(tokens)::bigint as tokens, sum(sessions)::bigint as sessions from u where part = 'current' and (tokens <> 0 or sessions <> 0) group by all),
{_top_sql('ut', 'up', 'project_id', 'tokens', ['tokens', 'sessions'])},
spine as (select window_key, 'current' as part, place, width, from_day + (place * width)::integer as first_day from (select *, unnest(range(0, last_place + 1)) as place from base)),
ud as (select s.*, tokens, sessions from spine s left join (select u.window_key, date_diff('day', u.from_day, day) // width as place, sum(tokens)::bigint as tokens, sum(sessions)::bigint as sessions from u join base b on b.window_key = u.window_key where part = 'current' group by all) x using (window_key, place)),
r as (select * from rounds join win on day between from_day and to_day and part in ('current', 'rounds_prior')),
specs as (select window_key, part, spec, count(*) as rounds, count(*) filter (accepted) as accepted_rounds, sum(cents)::bigint as cents, sum(findings)::bigint as findings, max(day) as latest, arg_max(verdict, round) as verdict from r group by all),
rs as (select window_key, part, count(distinct spec) filter (accepted) as accepted_specs, count(distinct spec) as specs, count(*) as rounds, count(*) filter (accepted) as accepted_rounds, sum(cents)::bigint as cents, sum(findings)::bigint as findings, quantile_cont(duration, 0.5) as median_duration from r group by all),
rw as (select window_key, part, rs.* exclude (window_key, part) from win left join rs using (window_key, part) where part in ('current', 'rounds_prior')),
now as (select * from specs where part = 'current'),
{_top_sql('rt', 'now', 'spec', 'cents', ['cents', 'findings', 'rounds'])},
recent as (select *, row_number() over (partition by window_key order by latest desc, spec desc) as position, case when accepted_rounds > 0 then 'accepted' else lower(verdict) end as said from now qualify position <= 6),
rd as (select s.*, rounds, accepted, not_accepted, median_duration from spine s left join (select r.window_key, date_diff('day', r.from_day, day) // width as place, count(*) as rounds, count(*) filter (accepted) as accepted, count(*) filter (not accepted) as not_accepted, quantile_cont(duration, 0.5) as median_duration from r join base b on b.window_key = r.window_key where part = 'current' group by all) x using (window_key, place)),
probe as (select day_utc as day, kind as source, count(*) as n, count(*) filter (exit_code = 0) as healthy, arg_max(exit_code, event_id) as latest from log group by all),
mw as (select b.window_key, 'current' as part, coalesce(sum(probe.n), 0) as total, coalesce(sum(healthy), 0) as healthy, count(distinct case when latest <> 0 then source end) as gap_sources from base b left join probe on day between from_day and to_day group by 1),
ap as (select window_key, 'current' as part, project_id, sum(micros)::bigint as micros, sum(transitions_in)::bigint as transitions_in, {', '.join(f'sum({m})::bigint as {m}' for m in _MODES)} from attention join base on day between from_day and to_day group by all),
pj as (select e.window_key, project_id, bool_or(day <= e - n) as was, bool_or(day > e - n) as cur from attention join ends e on day > e.e - 2 * n and day <= e.e group by all),
dropped as (select e.window_key, count(*) filter (was and not cur) as dropped from ends e left join pj using (window_key) group by 1),
aw as (select b.window_key, 'current' as part, max(micros) as top_micros, sum(micros) as micros, sum(transitions_in) as transitions_in, {', '.join(f'sum({m}) as {m}' for m in _MODES)}, any_value(dropped) as dropped from base b left join ap using (window_key) left join dropped using (window_key) group by 1),
lj as (select window_key, part, project_id, ap.* exclude (window_key, part, project_id), tokens, sessions from ap full join up using (window_key, part, project_id)),
{_top_sql('lt', 'lj', 'project_id', 'micros', _LEDGER, True)}
{_cells('uw', _USAGE_CELLS)} union all {_cells('uc', _OWN_CELLS)} union all {_cells('ut', [('projects', 'label', m, m) for m in ('position', 'tokens', 'sessions', 'other_count')])}
union all {_cells('ud', [('daily', 'first_day', m, f'coalesce({m}, 0)') for m in ('tokens', 'sessions')])} union all {_cells('rw', _OUTCOME_CELLS)} union all {_cells('rt', [('specs', 'label', m, m) for m in ('position', 'cents', 'findings', 'rounds', 'other_count')])}
union all {' union all '.join(f"select window_key, part, 'recent', spec, '{m}', {m}::double, said from recent" for m in ('position', 'rounds', 'cents', 'findings'))}
union all {_cells('rd', [('rounds_daily', 'first_day', m, f'coalesce({m}, 0)') for m in ('rounds', 'accepted', 'not_accepted')] + [('rounds_daily', 'first_day', 'median_duration', 'median_duration')])}
union all {_cells('mw', [('measurement', "''", m, m) for m in ('healthy', 'total', 'gap_sources')] + [('measurement', "''", 'ratio', _share('healthy', 'total'))])}
union all {_cells('aw', _ATTENTION_CELLS)} union all {_cells('lt', [('ledger', 'label', m, m) for m in ('position', *_LEDGER, 'other_count')])}""")
def dq14b(spark, d):
    """All sections of the windows' page over usage, rounds, attention and probes, with comparisons where they are covered."""
    usage = kept(G.daily_rollup(V.obs(spark, d)).select(F.col("day_utc").alias("day"), "project_id", "vendor", "host_os", "sessions", F.col("input_tokens").alias("tokens")))
    rounds = kept(V.rnd(spark, d).withColumn("day", F.date_add("ended_on", 8218)).withColumnRenamed("raw_days", "duration"))
    attention = kept(I.attention_days(I.split_at_midnight(V.att(spark, d), "start_us", "end_us"), "project_id", "mode", _MODES, ["part_start", "part_end", "event_id"]))
    probes = V.log(spark, d).select(F.col("day_utc").alias("day"), F.col("kind").alias("source"), F.expr("case when exit_code = 0 then 'ok' else 'failed' end").alias("status"), F.col("event_id").alias("at"))
    windows = reports.report_windows(spark, reports.coverage({"usage": usage, "rounds": rounds, "attention": attention}), _TODAY, pending=True)
    return reports.windows_report(usage, rounds, attention, probes, windows, vendors=["vendor_a", "vendor_b"], hosts=["wsl", "windows"], buckets=[0, 1], modes=_MODES, stewardship=["guide", "review", "rework"], rework="rework", longest=60)
