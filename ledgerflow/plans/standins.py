"""Views of the given tables in the shapes that the operators take, for Spark and as SQL.

Each view has one SQL text for each engine with the same columns and rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.pricing import read_prices

EVENTS_NOW = "2024-01-31 00:00:00"
ORDERS_NOW = "2001-08-02"
#: (vendor, model, input, cached, write, long write, output, threshold, input halves, output halves)
RATES = [
    ("vendor_a", "click", 30000, 3000, 37500, 60000, 150000, 100000, 4, 3),
    ("vendor_a", "view", 150000, 15000, 187500, None, 750000, None, None, None),
    ("vendor_a", "purchase", 8000, 800, 10000, 16000, 40000, 200000, 4, 3),
    ("vendor_a", "signup", 10000, 1000, 12500, 20000, 50000, 100000, 4, 4),
    ("vendor_b", "click", 12500, 1250, None, None, 100000, 100000, 4, 3),
    ("vendor_b", "view", 25000, 2500, 25000, None, 150000, 272000, 4, 3),
    ("vendor_b", "purchase", 2500, 250, 3000, None, 20000, None, None, None),
    ("vendor_b", "signup", 50000, 5000, 50000, None, 400000, 100000, 3, 3),
]


def _null(v) -> str:
    return "null" if v is None else f"'{v}'" if isinstance(v, str) else str(v)


PRICES_SQL = "prices(vendor, model, r_input, r_cached, r_write, r_write_long, r_output, threshold, in_halves, out_halves) as (values " + ", ".join("(" + ", ".join(map(_null, r)) + ")" for r in RATES) + ")"

_OBS = """select event_id, {ts} as ts, cast({ts} as date) as day_utc, user_id as session_id,
  case user_id % 2 when 0 then 'vendor_a' else 'vendor_b' end as vendor,
  case user_id % 3 when 0 then 'windows' else 'wsl' end as host_os,
  user_id % 20 as project_id, event_type as model, k, i as input_tokens,
  case user_id % 2 when 0 then 0 else cast(floor(i * k / 100.0) as bigint) end as cached_input_tokens, o as output_tokens,
  case user_id % 2 when 0 then k * 10 else 0 end as cache_write_5m_tokens,
  case user_id % 2 when 0 then k * 5 else 0 end as cache_write_1h_tokens,
  case user_id % 2 when 0 then cast(floor(i / 2.0) as bigint) else 0 end as cache_read_tokens,
  case user_id % 2 when 0 then 0 else k end as cache_write_tokens,
  case user_id % 2 when 0 then 0 else cast(floor(o / 4.0) as bigint) end as reasoning_output_tokens
from (select *, {k} as k, cast(floor(round(value * 1000, 3)) as bigint) as i, cast(floor(round(value * 10, 3)) as bigint) as o from {events})"""

_LOG = """select event_id, {ts} as ts, cast({ts} as date) as day_utc,
  case event_type when 'view' then 'dispatch' when 'purchase' then 'verdict' when 'signup' then 'merged' when 'click' then 'step' else 'proof' end as kind,
  user_id as row_id, k % 3 as round, k % 2 as exit_code,
  case k % 4 when 0 then 'BUILD' when 1 then 'REPAIR' when 2 then 'DISPATCHED_ACCEPT' else 'DISPATCHED_REJECT' end as state
from (select *, {k} as k from {events})"""

_ATT = """select event_id, user_id % 20 as project_id, user_id % 5 as lane,
  case event_type when 'view' then 'plan' when 'purchase' then 'guide' when 'signup' then 'review' when 'click' then 'rework' else 'direct' end as mode,
  s as start_us, s + cast(round(value * 1000000) as bigint) as end_us
from (select *, {us} as s from {events})"""

_RND = """select o.o_orderkey as order_id, o.o_custkey as spec, row_number() over (partition by o.o_custkey order by o.o_orderdate, o.o_orderkey) as round,
  o.o_orderstatus = 'F' as accepted, o.o_orderstatus as verdict, o.o_orderpriority as builder, cast(round(o.o_totalprice * 100) as bigint) as cents,
  cast(o.o_orderdate as date) as ended_on, coalesce(l.findings, 0) as findings, l.days as raw_days, coalesce(l.surfaces, 0) as surfaces
from {orders} o left join (
  select l_orderkey, count(case when l_returnflag = 'R' then 1 end) as findings, max({days}) as days, count(distinct l_linestatus) as surfaces
  from (select l.*, oo.o_orderdate from {lineitem} l join {orders} oo on l.l_orderkey = oo.o_orderkey) group by l_orderkey) l on o.o_orderkey = l.l_orderkey"""

_SPARK = {"ts": "cast(ts as timestamp)", "k": "cast(get_json_object(props, '$.k') as bigint)", "us": "unix_micros(cast(ts as timestamp))", "days": "datediff(l_shipdate, o_orderdate)"}
_DUCK = {"ts": "ts", "k": "cast(props->>'k' as bigint)", "us": "epoch_us(ts)", "days": "date_diff('day', cast(o_orderdate as date), cast(l_shipdate as date))"}

OBS = "obs as (" + _OBS.format(events="events", **_DUCK) + ")"
LOG = "log as (" + _LOG.format(events="events", **_DUCK) + ")"
ATT = "att as (" + _ATT.format(events="events", **_DUCK) + ")"
RND = "rnd as (" + _RND.format(orders="orders", lineitem="lineitem", **_DUCK) + ")"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _view(spark: SparkSession, sf_dir: str, text: str, **tables: str) -> DataFrame:
    return spark.sql(text.format(**_SPARK, **{k: "{" + k + "}" for k in tables}), **{k: read(spark, sf_dir, v) for k, v in tables.items()})


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, _OBS, events="events")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, _LOG, events="events")


def att(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, _ATT, events="events")


def rnd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, _RND, orders="orders", lineitem="lineitem")


def prices(spark: SparkSession) -> DataFrame:
    return read_prices(spark, RATES)
