"""Rows around the borders of the stand-in data, against DuckDB."""

import datetime

import duckdb

from ledgerflow.plans import catalog


def test_interval_ledger_over_the_border_equals_sql(spark, tmp_path):
    at = datetime.datetime(2024, 1, 29, 23, 59, 0)
    starts = [at + datetime.timedelta(seconds=s, milliseconds=500) for s in (0, 30, 59, 60, 90)]
    rows = [(1 + 5 * k + n, t, 3, "view", v) for k, t in enumerate(starts) for n, v in enumerate((0.5, 1.0, 29.9, 30.0, 500.0))]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    name = "src16_interval_ledger"
    got = {(r.event_id, r.exclude_reason) for r in catalog.queries()[name](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    assert got == set(con.sql(catalog.oracle_sql()[name]).fetchall())
    assert {r for _, r in got} >= {None, "empty", "future"}
