"""Structured Streaming forms of the operators: ingest, replay-safe dedup, deltas, daily totals, sessions, corrections.

A file source takes each file once and never reads a grown file again: growing
logs must be landed as chunks in a folder.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a folder of JSON-lines chunks; torn or malformed lines are left out."""
    rows = spark.readStream.text(path).withColumn("r", F.from_json("value", schema))
    return rows.filter(F.col("r").isNotNull() & F.trim("value").endswith("}")).select("r.*")


def stream_table(spark: SparkSession, path: str, schema, files_at_once: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_at_once) if files_at_once else reader).parquet(path)


def stream_dedup(df: DataFrame, key: list[str], ts: str, delay: str) -> DataFrame:
    """Each key once within the delay."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(key)


def stream_deltas(df: DataFrame, key: str, order: str, total: str, reach: int | None = None) -> DataFrame:
    """(key, order, total, delta, revision): growth of a running total by key since the row before it.

    A repeated row gives nothing.  A late row gives its own growth, and that of
    the row after it again, under the next revision: ``latest_deltas`` takes the
    last ones, which equal the batch form, cumulative_delta, over all rows once.
    Rows with a null order or total are left out.

    State is one list for each key.  With ``reach`` (in units of a whole-number
    order) only rows that near to the key's newest one are kept, and the one before
    them; a row before all of these gets a null delta under revision -1.  A key
    itself is never forgotten.  Needs the RocksDB store: ``drain(..., rocks=True)``.
    """
    kind = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    grown = Row(key, order, total, "delta", "revision")

    class Growth(StatefulProcessor):  # here, so that it travels to executors by value
        def init(self, handle):
            self.seen = handle.getListState("seen", f"at {kind[order]}, total {kind[total]}, revision int, cut boolean")

        def handleInputRows(self, k, rows, timers):
            known = [[*r, False] for r in self.seen.get()]
            for r in rows:
                new = [r[order], r[total], -1, False, True]
                at = bisect_left(known, new[:2])
                if at < len(known) and known[at][:2] == new[:2]:
                    continue
                if at == 0 and known and known[0][3]:
                    yield grown(k[0], r[order], r[total], None, -1)
                    continue
                known.insert(at, new)
                if at + 1 < len(known):
                    known[at + 1][4] = True
            before = 0
            for r in known:
                if r[4]:
                    r[2] += 1
                    yield grown(k[0], r[0], r[1], max(int(r[1] - before), 0), r[2])
                before = r[1]
            if reach is not None and known:
                old = bisect_left(known, [known[-1][0] - reach])
                known = known[max(old - 1, 0) :]
                known[0][3] = known[0][3] or old > 1
            self.seen.put([tuple(r[:4]) for r in known])

        def close(self):
            pass

    rows = df.filter(F.col(order).isNotNull() & F.col(total).isNotNull()).select(key, order, total)
    out = f"{key} {kind[key]}, {order} {kind[order]}, {total} {kind[total]}, delta long, revision int"
    return rows.groupBy(key).transformWithState(Growth(), out, "Append", "None")


def latest_deltas(df: DataFrame, key: str, order: str, total: str) -> DataFrame:
    """(key, order, total, delta): the last revision of each row that ``stream_deltas`` wrote."""
    return df.groupBy(key, order, total).agg(F.max_by("delta", "revision").alias("delta"))


def stream_daily(df: DataFrame, ts: str, delay: str, keys: list[str], sums: list[str]) -> DataFrame:
    """Totals by UTC day; a day's row appears only after the day has closed."""
    g = df.withWatermark(ts, delay).groupBy(F.window(ts, "1 day"), *keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in sums])
    return g.select(F.to_date("window.start").alias("day"), *keys, "n", *sums)


def stream_sessions(df: DataFrame, ts: str, delay: str, keys: list[str], gap: str) -> DataFrame:
    """Runs of rows without a gap."""
    g = df.withWatermark(ts, delay).groupBy(F.session_window(ts, gap), *keys).agg(F.count(F.lit(1)).alias("n"))
    return g.select(*keys, F.unix_seconds("session_window.start").alias("started"), F.unix_seconds("session_window.end").alias("ended"), "n")


def stream_corrections(df: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Give each micro-batch to ``apply``, which merges it into closed days; waits until all is read."""
    q = df.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def drain(df: DataFrame, path: str, checkpoint: str, rocks: bool = False) -> DataFrame:
    """Run a stream over all that is there now into a folder, and read that; ``rocks`` keeps its state in RocksDB."""
    spark = df.sparkSession
    before = spark.conf.get(STORE, None)
    if rocks:
        spark.conf.set(STORE, ROCKS)
    try:
        q = df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        if rocks and before is None:
            spark.conf.unset(STORE)
        elif rocks:
            spark.conf.set(STORE, before)
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def recent_days(df: DataFrame, day: str, today: str, days: int = 4) -> DataFrame:
    """Only the partitions of the last days."""
    return df.filter(F.col(day) > F.date_sub(F.lit(today).cast("date"), days))
