"""Queries for scalar functions and pricing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pricing as P
from ..functions import scalars as S
from . import standins as V
from .standins import OBS, PRICES_SQL, RND

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    """Register a query, and the SQL that gives its rows."""

    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


@query("fn01_safe_identifier", r"""select doc_id, case when length(trim(source)) <= 160 and regexp_matches(trim(source), '^[A-Za-z0-9][A-Za-z0-9._:/@+-]*$') then trim(source) else 'unknown' end as source_id,
  case when length(trim(text)) <= 160 and regexp_matches(trim(text), '^[A-Za-z0-9][A-Za-z0-9._:/@+-]*$') then trim(text) else 'unknown' end as text_id from documents""")
def fn01(spark, d):
    return V.read(spark, d, "documents").select("doc_id", S.safe_identifier("source").alias("source_id"), S.safe_identifier("text").alias("text_id"))


@query("fn02_safe_number", """select event_id, greatest(cast(props->>'k' as bigint), 0) as k, cast(trunc(value) as bigint) as whole, 7 as junk, 1 as flag, value as number from events""")
def fn02(spark, d):
    return V.read(spark, d, "events").select("event_id", S.safe_int(F.get_json_object("props", "$.k")).alias("k"), S.safe_int(F.col("value").cast("string")).alias("whole"), S.safe_int(F.concat(F.lit("x"), F.col("event_type")), 7).alias("junk"), S.safe_int(F.lit("true")).alias("flag"), S.safe_float(F.col("value").cast("string")).alias("number"))


@query("fn03_bounded_number", "select event_id, case when value between 10 and 400 then value end as bounded from events")
def fn03(spark, d):
    return V.read(spark, d, "events").select("event_id", S.bounded_number("value", 10, 400).alias("bounded"))


@query("fn04_rounded", "select event_id, floor(value * 10.0::double + 0.5) / 10.0::double as one_digit from events")
def fn04(spark, d):
    return V.read(spark, d, "events").select("event_id", S.rounded("value", 1).alias("one_digit"))


@query("fn05_rate", """select o_custkey, case when count(*) filter (o_orderstatus <> 'P') <> 0 then floor(count(*) filter (o_orderstatus = 'F')::double / count(*) filter (o_orderstatus <> 'P') * 10000 + 0.5) / 10000 end as accepted_rate from orders group by 1""")
def fn05(spark, d):
    g = V.read(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("n"), F.count_if(F.col("o_orderstatus") != "P").alias("all"))
    return g.select("o_custkey", S.rate("n", "all").alias("accepted_rate"))


@query("fn06_parse_timestamp", """select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as utc, strftime(ts - interval 2 hour, '%Y-%m-%dT%H:%M:%SZ') as from_offset, cast(null as varchar) as junk from events""")
def fn06(spark, d):
    e = V.read(spark, d, "events").withColumn("t", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return e.select("event_id", S.iso(S.parse_utc(F.concat("t", F.lit("Z")))).alias("utc"), S.iso(S.parse_utc(F.concat("t", F.lit("+02:00")))).alias("from_offset"), S.iso(S.parse_utc(F.concat(F.lit("junk"), "t"))).alias("junk"))


@query("fn07_day_and_week", """select o_orderkey, cast(o_orderdate as date) as day, printf('%d-W%02d', isoyear(o_orderdate), weekofyear(o_orderdate)) as week from orders""")
def fn07(spark, d):
    return V.read(spark, d, "orders").select("o_orderkey", S.event_day("o_orderdate").alias("day"), S.week_key("o_orderdate").alias("week"))


@query("fn08_weekday_hour", """select event_id, cast(isodow(ts) - 1 as integer) as monday_based, cast(dayofweek(ts) as integer) as sunday_based, cast(hour(ts) as integer) as hour_of_day from events""")
def fn08(spark, d):
    return V.read(spark, d, "events").select("event_id", S.weekday("ts").alias("monday_based"), S.weekday("ts", "sunday").alias("sunday_based"), F.hour("ts").alias("hour_of_day"))


@query("fn09_clamp_duration", """select l_orderkey, l_linenumber, cast(least(greatest(s, 0), 172800) as bigint) as seconds, s < 0 or s > 172800 as anomalous
from (select l_orderkey, l_linenumber, date_diff('day', cast(o_orderdate as date), cast(l_shipdate as date)) * 86400 as s from lineitem join orders on l_orderkey = o_orderkey)""")
def fn09(spark, d):
    j = V.read(spark, d, "lineitem").join(V.read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    c = S.clamp_duration(F.datediff("l_shipdate", "o_orderdate").cast("long") * 86400, 48 * 3600)
    return j.select("l_orderkey", "l_linenumber", c["seconds"].cast("long").alias("seconds"), c["anomalous"].alias("anomalous"))


@query("fn10_cache_split", f"with {OBS} select event_id, k * 10 - least(k * 10, cast(floor(input_tokens / 1000.0) as bigint)) as short, least(k * 10, cast(floor(input_tokens / 1000.0) as bigint)) as long from obs")
def fn10(spark, d):
    return V.obs(spark, d).select("event_id", S.cache_split(F.col("k") * 10, F.floor(F.col("input_tokens") / 1000)).alias("s")).select("event_id", "s.short", "s.long")


CLASSES_A = ["input_tokens", "output_tokens", "cache_read_tokens", "cache_write_5m_tokens", "cache_write_1h_tokens"]
CLASSES_B = ["input_tokens", "output_tokens"]


@query("fn11_token_total", f"with {OBS} select event_id, input_tokens + output_tokens + case vendor when 'vendor_a' then cache_read_tokens + cache_write_5m_tokens + cache_write_1h_tokens else 0 end as tokens from obs")
def fn11(spark, d):
    return V.obs(spark, d).select("event_id", S.token_total("vendor", CLASSES_A, CLASSES_B).alias("tokens"))


@query("fn12_normalize_vendor", """select c_custkey, case lower(trim(c_mktsegment)) when 'building' then 'vendor_a' when 'machinery' then 'vendor_b' else 'unknown' end as vendor from customer""")
def fn12(spark, d):
    return V.read(spark, d, "customer").select("c_custkey", S.normalize_vendor("c_mktsegment", {"building": "vendor_a", "machinery": "vendor_b"}).alias("vendor"))


_RAW_PATHS = "concat(case page_id % 4 when 0 then 'C:\\Work\\' when 1 then '/srv/./a/../' when 2 then '//wsl$/Ubuntu/home//u/' else 'rel/' end, regexp_extract(url, '^[a-z]+://[^/]+/?(.*)$', 1))"


@query("fn13_canonicalize_path", f"""with p as (select page_id, replace({_RAW_PATHS}, '\\', '/') as p from pages),
q as (select page_id, regexp_replace(regexp_replace(p, '^//wsl(\\.localhost|\\$)/[^/]+', ''), '/+', '/', 'g') as p from p),
r as (select page_id, case when regexp_matches(p, '^[A-Za-z]:(/|$)') then lower('/mnt/' || p[1] || p[3:]) else p end as p from q),
s as (select page_id, p, regexp_replace(regexp_replace(p, '/\\.(/|$)', '/', 'g'), '/[^/]+/\\.\\.(/|$)', '/', 'g') as f from r)
select page_id, case when p[1] = '/' then '/' || trim(f, '/') end as path from s""")
def fn13(spark, d):
    raw = F.expr(_RAW_PATHS.replace("\\", "\\\\"))
    return V.read(spark, d, "pages").select("page_id", S.canonicalize_path(raw).alias("path"))


@query("fn14_path_under", """select page_id, u = '/' || split_part(u, '/', 2) or starts_with(u, '/' || split_part(u, '/', 2) || '/') as below_first, u = '/a' or starts_with(u, '/a/') as below_a
from (select page_id, '/' || regexp_extract(url, '^[a-z]+://(.*)$', 1) as u from pages)""")
def fn14(spark, d):
    u = V.read(spark, d, "pages").select("page_id", F.concat(F.lit("/"), F.regexp_extract("url", "^[a-z]+://(.*)$", 1)).alias("u"))
    return u.select("page_id", S.path_under("u", F.concat(F.lit("/"), F.split_part("u", F.lit("/"), F.lit(2)))).alias("below_first"), S.path_under("u", F.lit("/a")).alias("below_a"))


@query("fn15_salted_digest", "select c_custkey, substr(sha256('pepper' || chr(0) || lower(c_name)), 1, 8) as project_code, substr(sha256('pepper' || chr(0) || c_name), 1, 16) as fingerprint from customer")
def fn15(spark, d):
    return V.read(spark, d, "customer").select("c_custkey", S.salted_digest("c_name", "pepper", 8, fold=True).alias("project_code"), S.salted_digest("c_name", "pepper", 16).alias("fingerprint"))


@query("fn16_natural_key", "select event_id, sha256(user_id || chr(0) || event_type || chr(0) || event_id) as event_key, sha256(cast(user_id as varchar) || chr(0) || event_type) as session_key from events")
def fn16(spark, d):
    return V.read(spark, d, "events").select("event_id", S.natural_key("user_id", "event_type", "event_id").alias("event_key"), S.natural_key("user_id", "event_type").alias("session_key"))


@query("fn17_category_and_round", """select p_partkey, case when p_type = 'ECONOMY' then 'exact' when starts_with(p_type, 'S') then 's' when starts_with(p_type, 'P') then 'p' else 'other' end as proof_group, p_size::bigint as round_a, p_size::bigint as round_b from part""")
def fn17(spark, d):
    return V.read(spark, d, "part").select("p_partkey", S.category("p_type", {"ECONOMY": "exact"}, {"P": "p", "S": "s"}).alias("proof_group"), S.round_number(F.concat(F.lit("spec/round"), F.col("p_size"))).alias("round_a"), S.round_number(F.col("p_size").cast("string")).alias("round_b"))


@query("fn18_blocking_findings", """select doc_id, case doc_id % 4 when 0 then 2 when 1 then 2 when 2 then n_chars else case doc_id % 3 when 2 then 0 else doc_id end end as findings from documents""")
def fn18(spark, d):
    made = F.expr("case doc_id % 4 when 0 then '[1, 2]' when 1 then '{\"a\": 1, \"b\": 2}' when 2 then cast(n_chars as string) else null end")
    return V.read(spark, d, "documents").select("doc_id", S.blocking_findings(made, F.expr("case doc_id % 3 when 0 then concat('found ', doc_id, ' NEW blocking issues') when 1 then concat('new blocking findings: ', doc_id) else concat(doc_id, ' blocking items') end")).alias("findings"))


@query("fn19_extract_model", """select event_id, case when event_id % 3 = 0 then 'model-' || event_type when event_id % 3 = 1 then 'model-' || (props->>'k') end as model from events""")
def fn19(spark, d):
    made = F.expr("case event_id % 3 when 0 then concat('{\"model\": \"model-', event_type, '\"}') when 1 then concat('{\"message\": {\"model\": \"model-', get_json_object(props, '$.k'), '\"}}') else '{\"model\": \"other\"}' end")
    return V.read(spark, d, "events").select("event_id", S.extract_model(made, "^model-").alias("model"))


@query("fn20_is_accepted", "select o_orderkey, o_totalprice > 400000 or o_orderstatus = 'F' as accepted from orders")
def fn20(spark, d):
    return V.read(spark, d, "orders").select("o_orderkey", S.is_accepted(F.col("o_totalprice") > 400000, "o_orderstatus", ["f"]).alias("accepted"))


@query("fn21_display_label", "select event_id, case event_type when 'click' then 'Pressed' else upper(event_type[1]) || event_type[2:] || ' Event' end as label from events")
def fn21(spark, d):
    return V.read(spark, d, "events").select("event_id", S.display_label(F.concat("event_type", F.lit("_event")), {"click_event": "Pressed"}).alias("label"))


#: The patterns of reasons in the other engine's syntax, which has no look-around.
_RE2 = {
    "absolute_path": r"/home/[A-Za-z0-9._-]+/|/mnt/[A-Za-z]/[^\s\x0b\"'']|(^|[^A-Za-z0-9])[A-Za-z]:[\\/][^\s\x0b\"'']",
    "credential_pattern": "|".join(S.CREDENTIALS),
    "email_pattern": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}([^A-Za-z0-9.-]|$)",
    "machine_metadata_key": r'(?i)"hostname"[\s\x0b]*:',
    "phone_pattern": r"(^|[^0-9])(?:\+?1[ .-])?(?:\([0-9]{3}\)|[0-9]{3})[ .-][0-9]{3}[ .-][0-9]{4}([^0-9]|$)",
    "username_path": S.SENSITIVE["username_path"].replace(r"\s", r"\s\x0b").replace("'", "''"),
}
_REASONS = "list_sort(list_filter([" + ", ".join(f"case when regexp_matches(text, '{p}') then '{c}' end" for c, p in sorted(_RE2.items())) + ", case when contains(text, 'the') then 'local_denylist' end], lambda x: x is not null))"


@query("fn22_sensitive_reasons", f"select doc_id, {_REASONS} as reasons from documents")
def fn22(spark, d):
    return V.read(spark, d, "documents").select("doc_id", S.sensitive_reasons("text", ["the"]).alias("reasons"))


@query("fn23_model_bucket", f"with {OBS} select session_id, day_utc, case count(distinct model) when 1 then max(model) else 'mixed' end as bucket from obs group by all")
def fn23(spark, d):
    return V.obs(spark, d).groupBy("session_id", "day_utc").agg(S.model_bucket(F.collect_set("model")).alias("bucket"))


@query("fn24_cost_status", f"with {OBS}, t as (select session_id, sum(case when k < 5 then 0 else k end)::bigint as tokens, count(*) filter (model = 'error') as lost from obs group by 1) select session_id, case when tokens = 0 then 'unavailable' when lost > 0 then 'partial' else 'complete' end as status from t")
def fn24(spark, d):
    t = V.obs(spark, d).groupBy("session_id").agg(F.sum(F.when(F.col("k") < 5, 0).otherwise(F.col("k"))).alias("tokens"), F.count_if(F.col("model") == "error").alias("lost"))
    return t.select("session_id", S.cost_status("tokens", "lost").alias("status"))


_ASSUME = [(1, 10.0, 50.0, 0.5, 2.0), (2, 4.0, 0.0, 0.5, 1.0), (3, 20.0, 80.0, 0.25, 4.0)]


@query("fn25_scenario_values", f"""with a(scenario, manual_hours, hourly, share, alternative) as (values {', '.join(str(tuple(map(float, r[1:]))).replace('(', f'({r[0]}, ') for r in _ASSUME)}),
c as (select c_custkey, c_nationkey::double as hours, floor(c_acctbal) as cash from customer)
select c_custkey, scenario, case when hourly > 0 then manual_hours::double - hours end as delta, case when hourly > 0 then hours + cash / hourly::double end as equivalent, case when hourly > 0 then hours * share::double * alternative::double end as opportunity from c, a""")
def fn25(spark, d):
    c = V.read(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("double").alias("hours"), F.floor("c_acctbal").cast("double").alias("cash"))
    a = spark.createDataFrame(_ASSUME, "scenario int, manual_hours double, hourly double, share double, alternative double")
    return P.scenario_values(c, a).select("c_custkey", "scenario", "delta", "equivalent", "opportunity")


_PRICED = f"""{PRICES_SQL}, {OBS}, joined as (
  select obs.*, p.* exclude (vendor, model), case obs.vendor when 'vendor_a' then input_tokens + cache_read_tokens + cache_write_5m_tokens + cache_write_1h_tokens else input_tokens end as whole_in,
    least(cached_input_tokens, input_tokens) as cc, least(cache_write_tokens, input_tokens - least(cached_input_tokens, input_tokens)) as ww
  from obs left join prices p on obs.vendor = p.vendor and obs.model = p.model),
halved as (select *, coalesce(whole_in > threshold, false) as long_context, case when whole_in > threshold then in_halves else 2 end as hi, case when whole_in > threshold then out_halves else 2 end as ho from joined),
priced as (select event_id, ts, day_utc, session_id, vendor, host_os, project_id, model, input_tokens, output_tokens, cache_read_tokens, cache_write_5m_tokens, cache_write_1h_tokens, cache_write_tokens, cached_input_tokens, k, long_context,
  cast(case when r_input is null then 0 when vendor = 'vendor_a' then (input_tokens * r_input + cache_read_tokens * r_cached + cache_write_5m_tokens * r_write + cache_write_1h_tokens * coalesce(r_write_long, r_write)) * hi + output_tokens * r_output * ho
    else ((input_tokens - cc - ww) * r_input + cc * r_cached + case when r_write is null then 0 else ww * r_write end) * hi + output_tokens * r_output * ho end as bigint) as units,
  cast(case when r_input is null then whole_in + output_tokens when vendor = 'vendor_b' and r_write is null then ww else 0 end as bigint) as unpriced_tokens from halved)"""
PRICED = _PRICED


def priced(spark, d):
    return P.price_usage(V.obs(spark, d), V.prices(spark))


@query("pr01_price_usage", f"with {PRICED} select event_id, units, unpriced_tokens, units::double / 2e10::double as usd from priced")
def pr01(spark, d):
    return priced(spark, d).select("event_id", "units", "unpriced_tokens", P.dollars("units").alias("usd"))


@query("pr02_long_context", f"with {PRICED} select model, long_context, count(*) as n, sum(units)::bigint as units from priced group by all")
def pr02(spark, d):
    return priced(spark, d).groupBy("model", "long_context").agg(F.count(F.lit(1)).alias("n"), F.sum("units").alias("units"))


@query("pr03_unpriced", f"with {PRICED} select vendor, model, sum(unpriced_tokens)::bigint as unpriced_tokens, count(*) filter (unpriced_tokens > 0) as n_rows from priced group by all")
def pr03(spark, d):
    return priced(spark, d).groupBy("vendor", "model").agg(F.sum("unpriced_tokens").alias("unpriced_tokens"), F.count_if(F.col("unpriced_tokens") > 0).alias("n_rows"))


_CLASSES = {"input_tokens": "r_input", "output_tokens": "r_output", "cache_read_tokens": "r_cached"}


def _estimates(spark, d):
    rows = V.obs(spark, d).select("event_id", "vendor", "model", "project_id", "day_utc", "cache_write_tokens", *_CLASSES)
    return P.estimate_unpriced(rows, V.prices(spark), _CLASSES)


_EST = f"""{PRICES_SQL}, {OBS}, est as (select o.event_id, o.vendor, o.project_id, o.day_utc, min(u)::bigint as low, max(u)::bigint as high, count(u) as cards, (min(u) + max(u))::double / 2 as mid from (
  select o.event_id, o.vendor, o.project_id, o.day_utc, (o.input_tokens * p.r_input + o.output_tokens * p.r_output + o.cache_read_tokens * p.r_cached) * 2 as u
  from obs o join prices p on o.vendor = p.vendor where o.model not in (select model from prices)
  union all select o.event_id, o.vendor, o.project_id, o.day_utc, o.cache_write_tokens * p.r_write * 2 from obs o join prices m on o.vendor = m.vendor and o.model = m.model join prices p on o.vendor = p.vendor
  where o.vendor = 'vendor_b' and m.r_write is null and p.r_write is not null and o.cache_write_tokens > 0) o group by all)"""


@query("pr04_estimate_unpriced", f"with {_EST} select event_id, low, high, mid, cards from est")
def pr04(spark, d):
    return _estimates(spark, d).select("event_id", "low", "high", "mid", "cards")


@query("pr05_combine_estimates", f"""with {_EST}, n as (select obs.session_id, obs.model = 'error' as needed, case when cards is not null and k >= 50 then low end as low, case when k >= 50 then high end as high from obs left join est using (event_id))
select session_id, case when count(*) filter (needed) = 0 then 'not_needed' when count(low) filter (needed) = 0 then 'unavailable' when count(low) filter (needed) < count(*) filter (needed) then 'partial' else 'available' end as status,
  coalesce(sum(low), 0)::bigint as low, coalesce(sum(high), 0)::bigint as high from n group by 1""")
def pr05(spark, d):
    e = _estimates(spark, d).select("event_id", "low", "high")
    keep = lambda c: F.when(F.col("k") >= 50, F.col(c)).alias(c)
    n = V.obs(spark, d).join(e, "event_id", "left").select("session_id", (F.col("model") == "error").alias("needed"), keep("low"), keep("high"))
    return P.combine_estimates(n, ["session_id"])


@query("pr06_price_by_model", f"with {PRICED} select project_id, sum(units)::bigint as units, sum(unpriced_tokens)::bigint as unpriced_tokens, count(distinct model) as models from priced group by 1")
def pr06(spark, d):
    return P.price_rollup(priced(spark, d), ["project_id"])


@query("pr07_enrich_history", f"with {_EST} select day_utc, vendor, count(*) as n_rows, sum(low)::bigint as low, sum(high)::bigint as high from est where day_utc < date '2024-01-15' group by all")
def pr07(spark, d):
    rows = V.obs(spark, d).select("event_id", "vendor", "model", "project_id", "day_utc", "cache_write_tokens", *_CLASSES).filter("day_utc < date '2024-01-15'")
    return P.enrich_history(rows, V.prices(spark), _CLASSES, ["day_utc", "vendor"])


@query("pr08_amortize", f"with {RND} select ended_on, count(*) filter (accepted) as accepted_units, 20000 * 12 / 365.2425::double as daily_cents, case when count(*) filter (accepted) > 0 then (20000 * 12 / 365.2425::double) / count(*) filter (accepted) end as cents_per_accepted from rnd group by 1")
def pr08(spark, d):
    days = V.rnd(spark, d).groupBy("ended_on").agg(F.count_if("accepted").alias("accepted_units"))
    return P.amortize(days, 20000, "accepted_units")
