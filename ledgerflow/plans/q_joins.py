"""Queries for joins, set operations and merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import merge as M
from ..operators.intervals import least_touching
from . import standins as V
from .standins import ATT, OBS, RND

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


@query("j01_observation_source", "select l_orderkey, l_linenumber, o_custkey from lineitem join orders on l_orderkey = o_orderkey")
def j01(spark, d):
    li = V.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("file_id"), "l_linenumber")
    return li.join(V.read(spark, d, "orders").select(F.col("o_orderkey").alias("file_id"), "o_custkey"), "file_id").select(F.col("file_id").alias("l_orderkey"), "l_linenumber", "o_custkey")


@query("j02_resolve_project", """with p as (select page_id, case when page_id % 13 = 0 then null else '/' || rtrim(case when page_id % 2 = 1 then upper(regexp_replace(url, '^[a-z]+://', '')) else regexp_replace(url, '^[a-z]+://', '') end, '/') end as path,
  case when page_id % 11 = 0 then 'SSH-box' else 'local' || page_id % 5 end || '/one.jsonl' as source from pages), f as (select *, lower(path) as folded, lower(split_part(source, '/', 1)) as top from p),
rules as (select distinct 'path' as kind, '/' || split_part(folded, '/', 2) as key, 'host-' || split_part(folded, '/', 2) as project, false as exact from f where length(split_part(folded, '/', 2)) % 2 = 0
  union all select distinct 'path', '/' || split_part(folded, '/', 2) || '/' || split_part(folded, '/', 3), 'dir-' || split_part(folded, '/', 3), false from f where page_id % 3 = 0 and folded is not null
  union all select distinct 'path', folded, 'page', true from f where page_id % 10 = 0 and folded is not null
  union all select distinct 'tail', string_split(folded, '/')[-1], 'tail-' || length(folded), false from f where page_id % 50 = 1 and folded is not null),
h as (select page_id, project, kind, key, folded from f join rules on (kind = 'tail' and key = string_split(folded, '/')[-1]) or (kind = 'path' and (key = folded or (not exact and starts_with(folded, key || '/'))))),
b as (select page_id, project, case when kind = 'tail' then 'public_tail' when key = folded then 'registry_exact' else 'registry_rollup' end as how from h qualify row_number() over (partition by page_id order by kind = 'tail' desc, length(key) desc, project) = 1)
select page_id, case when starts_with(top, 'ssh-') then 'remote' else coalesce(project, 'ad-hoc') end as project,
  case when starts_with(top, 'ssh-') then 'remote_source' when how is not null then how when folded is not null then 'unregistered_cwd' else 'cwd_unavailable' end as resolution,
  case when not starts_with(top, 'ssh-') and how is null then 'proj-' || sha256('salt' || chr(0) || coalesce(folded, 'source:' || top))[1:8] end as candidate_code, starts_with(top, 'ssh-') or how is not null as registered
from f left join b using (page_id)""")
def j02(spark, d):
    bare = F.regexp_replace("url", "^[a-z]+://", "")
    p = V.read(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 13 != 0, F.concat(F.lit("/"), F.rtrim(F.when(F.col("page_id") % 2 == 1, F.upper(bare)).otherwise(bare), F.lit("/")))).alias("path"), F.concat(F.when(F.col("page_id") % 11 == 0, "SSH-box").otherwise(F.concat(F.lit("local"), F.col("page_id") % 5)), F.lit("/one.jsonl")).alias("source"))
    f = p.filter("path is not null").withColumn("folded", F.lower("path"))
    part = lambda i: F.split_part("folded", F.lit("/"), F.lit(i))
    host = f.filter(F.length(part(2)) % 2 == 0).select(F.concat(F.lit("/"), part(2)).alias("root"), F.concat(F.lit("host-"), part(2)).alias("project"), F.lit(False).alias("exact"))
    two = f.filter("page_id % 3 = 0").select(F.concat(F.lit("/"), part(2), F.lit("/"), part(3)).alias("root"), F.concat(F.lit("dir-"), part(3)).alias("project"), F.lit(False).alias("exact"))
    page = f.filter("page_id % 10 = 0").select(F.col("path").alias("root"), F.lit("page").alias("project"), F.lit(True).alias("exact"))
    tails = f.filter("page_id % 50 = 1").select(F.element_at(F.split("path", "/"), -1).alias("tail"), F.concat(F.lit("tail-"), F.length("folded")).alias("project")).distinct()
    return J.resolve_project(p, tails, host.unionByName(two).unionByName(page).distinct(), "path", "source", "salt").select("page_id", "project", "resolution", "candidate_code", "registered")


_MARKED = "turns as (select session_id, row_number() over (partition by session_id order by ts, event_id) as pos, input_tokens from obs), marks as (select distinct session_id, pos - pos % 7 as mark from turns where pos % 7 = 0 or pos = 10)"


@query("j03_usage_between_marks", f"with {OBS}, {_MARKED}, m as (select session_id, mark, lag(mark, 1, 0) over (partition by session_id order by mark) as previous from marks) select m.session_id, m.mark, coalesce(sum(input_tokens), 0)::bigint as input_tokens, count(t.pos) as turns from m left join turns t on t.session_id = m.session_id and t.pos > previous and t.pos <= mark group by all")
def j03(spark, d):
    w = F.row_number().over(M.Window.partitionBy("session_id").orderBy("ts", "event_id"))
    turns = V.obs(spark, d).withColumn("pos", w.cast("long"))
    marks = turns.filter("pos % 7 = 0 or pos = 10").select("session_id", (F.col("pos") - F.col("pos") % 7).alias("mark")).distinct()
    return J.usage_between_marks(turns, marks, ["session_id"], "pos", ["input_tokens"])


_CORR = "r as (select event_id as round_id, project_id, start_us as started, end_us + 60000000 as ended from att where mode = 'plan'), s as (select event_id as session_id, project_id, start_us as first, end_us as last, mode from att where mode in ('guide', 'review')), pairs as (select round_id, session_id, ended, session_id % 4 = 0 as exact, project_id from r join s using (project_id) where first - 300000000 <= ended and last + 300000000 >= started)"


def _spans(spark, d):
    a = V.att(spark, d)
    r = a.filter("mode = 'plan'").selectExpr("event_id as round_id", "project_id", "start_us as started", "end_us + 60000000 as ended")
    return r, a.filter("mode in ('guide', 'review')").selectExpr("event_id as session_id", "project_id", "start_us as first", "end_us as last")


def _pairs(spark, d):
    return J.correlate_sessions(*_spans(spark, d), ["project_id"], 300_000_000, bin=3_600_000_000).withColumn("exact", F.col("session_id") % 4 == 0)


@query("j04_correlate_sessions", f"with {ATT}, {_CORR} select round_id, session_id from pairs")
def j04(spark, d):
    return _pairs(spark, d).select("round_id", "session_id")


@query("j05_assign_once", f"with {ATT}, {_CORR} select round_id, session_id, case when exact then 'exact' else 'correlated' end as tier from pairs where session_id % 13 <> 0 qualify row_number() over (partition by session_id order by exact desc, ended, round_id) = 1")
def j05(spark, d):
    reserved = V.att(spark, d).filter("event_id % 13 = 0").select(F.col("event_id").alias("session_id"))
    return J.assign_once(_pairs(spark, d), reserved)


@query("j05_assign_once_strict")
def j05b(spark, d):
    a = V.att(spark, d).withColumn("vendor", F.when(F.col("project_id") % 19 == 0, "future").when(F.col("project_id") % 2 == 0, "vendor_a").otherwise("vendor_b"))
    sessions = a.filter("mode in ('guide', 'review')").selectExpr("vendor", "event_id as session_id")
    overlaps = J.Overlaps(*_spans(spark, d), ["project_id"], 300_000_000)
    some = overlaps.sessions.filter("session_id % 4 = 0")
    own = least_touching(overlaps.rounds, some, ["project_id"], ("started", "ended"), ("first", "last"), ["round_id"], ["session_id"], 2, 300_000_000).select("round_id", F.transform("least", lambda x: x["session_id"]).alias("own"))
    rounds = a.filter("mode = 'plan'").select(F.col("event_id").alias("round_id"), "vendor", F.col("end_us").alias("ended")).join(own, "round_id", "left")
    rounds = rounds.withColumn("expected", F.when(F.col("round_id") % 9 == 0, 3).otherwise(F.size(F.coalesce("own", F.array().cast("array<long>")))))
    return J.assign_once_strict(rounds, sessions, overlaps, sessions.filter("session_id % 17 = 0"), ["vendor_a", "vendor_b"])


@query("j06_day_project", f"with {OBS} select day_utc, c_name, sum(input_tokens)::bigint as input_tokens from obs join customer on project_id = c_custkey group by all")
def j06(spark, d):
    days = V.obs(spark, d).groupBy("day_utc", "project_id").agg(F.sum("input_tokens").alias("input_tokens"))
    c = V.read(spark, d, "customer").select(F.col("c_custkey").alias("project_id"), "c_name")
    return days.join(c, "project_id").groupBy("day_utc", "c_name").agg(F.sum("input_tokens").alias("input_tokens"))


@query("j07_rounds_windows", f"with {RND} select r.spec, r.round, n.order_id as next_order from rnd r left join rnd n on n.spec = r.spec and n.round = r.round + 1")
def j07(spark, d):
    r = V.rnd(spark, d)
    n = r.select("spec", (F.col("round") - 1).alias("round"), F.col("order_id").alias("next_order"))
    return r.select("spec", "round").join(n, ["spec", "round"], "left")


@query("j08_spec_ledger", f"with {RND}, g as (select spec, count(*) as rounds, sum(cents)::bigint as cents, sum(findings)::bigint as findings from rnd group by 1), c as (select spec, min(ended_on) as created_on from rnd where round <= 3 group by 1), a as (select spec, min(ended_on) as accepted_on from rnd where accepted group by 1), t as (select spec, max(raw_days)::integer as slowest from rnd where raw_days > 0 group by 1) select g.*, created_on, accepted_on, slowest, cast(case when created_on is not null and accepted_on is not null then greatest(0, date_diff('day', created_on, accepted_on)) else 0 end as integer) as lead_days from g left join c using (spec) left join a using (spec) left join t using (spec)")
def j08(spark, d):
    r = V.rnd(spark, d)
    day = lambda f, n: r.filter(f).groupBy("spec").agg(F.min("ended_on").alias(n))
    t = r.filter("raw_days > 0").groupBy("spec").agg(F.max("raw_days").alias("slowest"))
    return J.spec_ledger(r, day("round <= 3", "created_on"), day("accepted", "accepted_on"), t)


@query("j09_attention_cost", f"with {ATT}, a as (select event_id % 200 as code, sum(end_us - start_us)::bigint as micros from att group by 1), c as (select o_custkey as code, count(*) as orders from orders group by 1) select coalesce(a.code, c.code) as code, micros, orders from a full join c on a.code = c.code")
def j09(spark, d):
    a = V.att(spark, d).groupBy((F.col("event_id") % 200).alias("code")).agg(F.sum(F.col("end_us") - F.col("start_us")).alias("micros"))
    c = V.read(spark, d, "orders").groupBy(F.col("o_custkey").alias("code")).agg(F.count(F.lit(1)).alias("orders"))
    return J.attention_cost_ledger(a, c, "code")


@query("j09_two_way", f"""with {ATT}, ids as (select distinct 'c' || c_custkey as code, 'p' || (c_custkey // 2 + case when c_custkey % 10 < 6 then 100000 + c_custkey else 0 end) as public_id from customer),
names as (select public_id as k, min(code) as code, count(*) as n from ids where public_id not in (select code from ids) group by 1), known as (select distinct code as k, code, 'resolved' as state from ids union all select k, case when n = 1 then code end, case when n = 1 then 'resolved' else 'ambiguous' end from names),
a as (select case event_id % 3 when 0 then 'c' || (event_id % 400) when 1 then 'p' || ((event_id % 400) // 2) else 'p' || ((event_id % 400) // 2 + 100000 + event_id % 400) end as k, end_us - start_us as micros from att), c as (select 'c' || o_custkey as k from orders),
x as (select coalesce(code, a.k) as code, coalesce(state, 'unknown') as state, sum(micros)::bigint as micros from a left join known using (k) group by 1, 2), y as (select coalesce(code, c.k) as code, coalesce(state, 'unknown') as state, count(*) as orders from c left join known using (k) group by 1, 2)
select coalesce(x.code, y.code) as code, coalesce(x.state, y.state) as state, micros, orders from x full join y on x.code = y.code and x.state = y.state""")
def j09b(spark, d):
    key = F.col("c_custkey")
    half = F.floor(key / 2)
    ids = V.read(spark, d, "customer").select(F.concat(F.lit("c"), key).alias("code"), F.concat(F.lit("p"), half + F.when(key % 10 < 6, 100000 + key).otherwise(0)).alias("public_id"))
    e = F.col("event_id") % 400
    name = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("c"), e)).when(F.col("event_id") % 3 == 1, F.concat(F.lit("p"), F.floor(e / 2))).otherwise(F.concat(F.lit("p"), F.floor(e / 2) + 100000 + e))
    a = V.att(spark, d).select(name.alias("k"), (F.col("end_us") - F.col("start_us")).alias("micros"))
    c = V.read(spark, d, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("k"), F.lit(1).cast("long").alias("orders"))
    return J.two_way_ledger(a, c, ids, "k", ["micros"], ["orders"])


@query("j10_add_missing", "select c_custkey, case when count(o_orderkey) > 0 then count(o_orderkey) end as orders from customer left join orders on c_custkey = o_custkey group by 1")
def j10(spark, d):
    g = V.read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("orders"))
    return J.add_missing(g, V.read(spark, d, "customer"), "c_custkey")


@query("j11_membership", "select c_custkey, c_custkey in (select o_custkey from orders where o_orderstatus = 'F') as has_f from customer")
def j11(spark, d):
    c = V.read(spark, d, "customer").select("c_custkey")
    ids = V.read(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return J.keep_in(c, ids, "c_custkey").withColumn("has_f", F.lit(True)).unionByName(J.keep_not_in(c, ids, "c_custkey").withColumn("has_f", F.lit(False)))


@query("j12_orphans", "select distinct o_custkey from orders where o_custkey not in (select c_custkey from customer where c_nationkey <> 3)")
def j12(spark, d):
    return J.orphans(V.read(spark, d, "orders"), V.read(spark, d, "customer").filter("c_nationkey <> 3"), "o_custkey", "c_custkey")


@query("set1_union_all", "select c_custkey as id, c_name as name, c_mktsegment from customer union all select s_suppkey, s_name, null from supplier")
def set1(spark, d):
    c = V.read(spark, d, "customer").selectExpr("c_custkey as id", "c_name as name", "c_mktsegment")
    return M.union_all([c, V.read(spark, d, "supplier").selectExpr("s_suppkey as id", "s_name as name")])


@query("set2_id_sets", "select 'except' as op, count(*) as n from (select c_custkey from customer except select o_custkey from orders) union all select 'intersect', count(*) from (select c_custkey from customer intersect select o_custkey from orders) union all select 'distinct', count(distinct o_custkey) from orders")
def set2(spark, d):
    c, o = V.read(spark, d, "customer").select("c_custkey"), V.read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    count = lambda op, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(op).alias("op"), "n")
    return count("except", c.exceptAll(o.distinct()).distinct()).unionByName(count("intersect", c.intersect(o))).unionByName(count("distinct", o.distinct()))


_DAILY = "daily as (select cast(o_orderdate as date) as day, o_custkey % 5 as project, count(*) as n, sum(cast(round(o_totalprice * 100) as bigint))::bigint as cents from orders group by all), old as (select day, project, n, cents + case when project = 3 then 1 else 0 end as cents from daily where day < date '2001-08-02' and not (project = 4 and year(day) = 1999) and (year(day) <> 1998 or month(day) <> 2)), new as (select * from daily where project <> 1)"


def _daily(spark, d):
    o = V.read(spark, d, "orders")
    daily = o.groupBy(F.to_date("o_orderdate").alias("day"), (F.col("o_custkey") % 5).alias("project")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))
    old = daily.filter("day < date '2001-08-02' and not (project = 4 and year(day) = 1999) and (year(day) <> 1998 or month(day) <> 2)").withColumn("cents", F.col("cents") + F.when(F.col("project") == 3, 1).otherwise(0))
    return old, daily.filter("project <> 1")


@query("set3_upsert", f"with {_DAILY} select coalesce(new.day, old.day) as day, coalesce(new.project, old.project) as project, case when new.day is not null then new.cents else old.cents end as cents from new full join old on new.day = old.day and new.project = old.project")
def set3(spark, d):
    old, new = _daily(spark, d)
    return M.upsert(new, old, ["day", "project"]).select("day", "project", "cents")


_TODAY = "2001-07-01"


@query("set4_merge_closed_days", f"""with {_DAILY}, held as (select distinct day from old),
j as (select coalesce(n.day, o.day) as day, coalesce(n.project, o.project) as project, o.cents as oc, n.cents as nc, o.day is not null as has_old, n.day is not null as has_new, coalesce(n.day, o.day) in (select day from held) as final from new n full join old o on n.day = o.day and n.project = o.project)
select day, project, case when day >= date '{_TODAY}' then coalesce(nc, oc) when has_old then oc when final then null else nc end as cents, day < date '{_TODAY}' and not has_old and final as conflict from j""")
def set4(spark, d):
    old, new = _daily(spark, d)
    rows, conflicts = M.merge_closed_days(old, new, ["day", "project"], _TODAY)
    return rows.select("day", "project", "cents", F.lit(False).alias("conflict")).unionByName(conflicts.select("day", "project", F.lit(None).cast("long").alias("cents"), F.lit(True).alias("conflict")))


@query("set5_coverage_corrections", f"with {_DAILY} select n.day, n.project, o.cents as stored, n.cents as recomputed from old o join new n on n.day = o.day and n.project = o.project where n.day < date '{_TODAY}' and n.cents is distinct from o.cents")
def set5(spark, d):
    old, new = _daily(spark, d)
    c = M.coverage_corrections(old, new, ["day", "project"], ["n"], _TODAY)
    return c.select("day", "project", F.col("stored.cents").alias("stored"), F.col("recomputed.cents").alias("recomputed"))


@query("set6_drop_repeated", "select doc_id from documents where text in (select text from documents group by 1 having count(*) = 1)")
def set6(spark, d):
    rows = V.read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("key"))
    return M.drop_repeated(rows, "key").select("doc_id")
