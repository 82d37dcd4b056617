"""Queries for streams: each runs over all files that are there and returns what it wrote."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import intervals as I
from ..operators import merge as M
from ..streaming import streams as S
from . import standins as V
from .q_quality import _folder
from .standins import ATT

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def _events(spark, d):
    """The events as a stream with a time in UTC."""
    schema = V.read(spark, d, "events").schema
    return S.stream_table(spark, f"{d}/events.parq*", schema).withColumn("ts", F.col("ts").cast("timestamp"))


def _drained(spark, df, name):
    return S.drain(df, _folder(spark, name), _folder(spark, f"{name}-checkpoint"))


@query("st1_incremental_ingest", "select user_id, count(*) as n, sum(event_id)::bigint as ids from events group by 1")
def st1(spark, d):
    """Two chunks land one after the other; the second run reads only the second."""
    e = V.read(spark, d, "events").select("event_id", "user_id")
    src, to, mark = (_folder(spark, f"ingest-{x}") for x in ("lines", "table", "checkpoint"))
    for part in (0, 1):
        e.filter(F.col("event_id") % 2 == part).select(F.to_json(F.struct("event_id", "user_id")).alias("value")).write.mode("append").text(src)
        rows = S.drain(S.stream_lines(spark, src, "event_id long, user_id long"), to, mark)
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("st2_replay_safe_dedup", "select event_id from events")
def st2(spark, d):
    once = _events(spark, d).select("event_id", "ts")
    return _drained(spark, S.stream_dedup(once.union(once), ["event_id"], "ts", "60 days"), "dedup").select("event_id")


@query("st3_deltas", "select user_id, event_id, value_k from (select user_id, event_id, cast(floor(round(value * 1000, 3)) as bigint) as value_k from events)")
def st3(spark, d):
    """Two chunks: the second holds late rows and repeats some of the first."""
    e = V.read(spark, d, "events").select("user_id", "event_id", F.floor(F.round(F.col("value") * 1000, 3)).alias("v"))
    run = F.sum("v").over(Window.partitionBy("user_id").orderBy("event_id"))
    totals = e.select("user_id", "event_id", run.alias("total"))
    src, to, mark = (_folder(spark, f"totals-{x}") for x in ("lines", "deltas", "checkpoint"))
    late = F.col("event_id") % 10 == 3
    for chunk in (totals.filter(~late), totals.filter(late | (F.col("event_id") % 10 == 4))):
        chunk.write.mode("append").parquet(src)
        rows = S.stream_table(spark, src, "user_id long, event_id long, total long")
        out = S.drain(S.stream_deltas(rows, "user_id", "event_id", "total"), to, mark, rocks=True)
    return S.latest_deltas(out, "user_id", "event_id", "total").select("user_id", "event_id", F.col("delta").alias("value_k"))


@query("st4_daily_close", "select cast(ts as date) as day, event_type, count(*) as n from events where cast(ts as date) < (select max(cast(ts as date)) from events) group by all")
def st4(spark, d):
    return _drained(spark, S.stream_daily(_events(spark, d), "ts", "0 seconds", ["event_type"], []), "daily")


@query("st5_withhold_open", f"with {ATT}, days as (select distinct cast(make_timestamp(start_us) as date) as day from att), o as (select min(start_us) as s from att where event_id % 1000 = 7 and start_us > 1705276800000000) select day from days where not exists (select 1 from o where day >= cast(make_timestamp(s) as date) and day <= date '2024-01-20')")
def st5(spark, d):
    a = V.att(spark, d)
    days = a.select(F.to_date(F.timestamp_micros("start_us")).alias("day")).distinct()
    opened = a.filter("event_id % 1000 = 7 and start_us > 1705276800000000").agg(F.min("start_us").alias("start_us")).filter("start_us is not null")
    return I.withhold_open(days, opened, "start_us", 1705708800000000)


@query("st6_late_corrections", "select cast(ts as date) as day, event_type, count(*) filter (event_id % 10 <> 0) as n, count(*) as recomputed from events where cast(ts as date) < date '2024-01-20' group by all having count(*) <> count(*) filter (event_id % 10 <> 0) and count(*) filter (event_id % 10 <> 0) > 0")
def st6(spark, d):
    """Late rows for closed days become corrections; the stored rows stay."""
    e = V.read(spark, d, "events").withColumn("day", F.to_date("ts"))
    count = lambda df: df.groupBy("day", "event_type").agg(F.count(F.lit(1)).alias("n"))
    stored, src, out = (_folder(spark, f"late-{x}") for x in ("stored", "source", "out"))
    count(e.filter("event_id % 10 <> 0")).write.parquet(stored)
    count(e).coalesce(1).write.parquet(src)

    def apply(batch, _):
        old = spark.read.schema("day date, event_type string, n long").parquet(stored)
        M.coverage_corrections(old, batch, ["day", "event_type"], [], "2024-01-20").write.mode("append").parquet(out)

    S.stream_corrections(S.stream_table(spark, src, "day date, event_type string, n long"), apply, _folder(spark, "late-checkpoint"))
    got = spark.read.schema("day date, event_type string, stored struct<n: bigint>, recomputed struct<n: bigint>").parquet(out)
    return got.select("day", "event_type", F.col("stored.n").alias("n"), F.col("recomputed.n").alias("recomputed"))


@query("st7_sessions", "with g as (select user_id, ts, case when lag(ts) over w is null or ts >= lag(ts) over w + interval 45 minute then 1 else 0 end as new from events window w as (partition by user_id order by ts)), s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows between unbounded preceding and current row) as k from g), t as (select user_id, cast(floor(epoch_us(min(ts)) / 1000000.0) as bigint) as started, cast(floor(epoch_us(max(ts) + interval 45 minute) / 1000000.0) as bigint) as ended, count(*) as n, max(ts) + interval 45 minute as e from s group by user_id, k) select user_id, started, ended, n from t where e <= (select max(ts) from events)")
def st7(spark, d):
    return _drained(spark, S.stream_sessions(_events(spark, d), "ts", "0 seconds", ["user_id"], "45 minutes"), "sessions")


@query("st8_rebuild_equals_stream", "select 0::bigint as only_batch, 0::bigint as only_stream, count(*) as n from (select distinct cast(ts as date), event_type from events where cast(ts as date) < (select max(cast(ts as date)) from events))")
def st8(spark, d):
    streamed = _drained(spark, S.stream_daily(_events(spark, d), "ts", "0 seconds", ["event_type"], []), "rebuild")
    e = V.read(spark, d, "events").withColumn("day", F.to_date("ts"))
    last = F.broadcast(e.agg(F.max("day").alias("_last")))
    batch = e.crossJoin(last).filter("day < _last").groupBy("day", "event_type").agg(F.count(F.lit(1)).alias("n"))
    count = lambda df, n: df.agg(F.count(F.lit(1)).alias(n))
    return count(batch.exceptAll(streamed), "only_batch").crossJoin(count(streamed.exceptAll(batch), "only_stream")).crossJoin(count(batch, "n"))


@query("st9_recent_days", "select cast(ts as date) as day, count(*) as n from events where cast(ts as date) > date '2024-01-30' - 4 group by 1")
def st9(spark, d):
    e = V.read(spark, d, "events").select("event_id", F.to_date("ts").alias("day"))
    to = _folder(spark, "by-day")
    e.repartition("day").write.partitionBy("day").parquet(to)
    rows = spark.read.schema("event_id long, day date").parquet(to)
    return S.recent_days(rows, "day", "2024-01-30").groupBy("day").agg(F.count(F.lit(1)).alias("n"))
