"""Unions, upserts and merges that leave closed days as they are."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

__all__ = ["Window", "coverage_corrections", "drop_repeated", "merge_closed_days", "union_all", "upsert"]


def union_all(dfs: list[DataFrame]) -> DataFrame:
    """All rows; columns that a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def _paired(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with ``stored`` and ``recomputed`` structs, null where a side lacks the key."""
    o = old.select(*keys, F.struct(*[c for c in old.columns if c not in keys]).alias("stored"))
    n = new.select(*keys, F.struct(*[c for c in new.columns if c not in keys]).alias("recomputed"))
    return o.join(n, keys, "full_outer")


def upsert(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both; of equal keys the new one."""
    return _paired(old, new, keys).select(*keys, F.coalesce("recomputed", "stored").alias("_r")).select(*keys, "_r.*")


def merge_closed_days(old: DataFrame, new: DataFrame, keys: list[str], today: str) -> tuple[DataFrame, DataFrame]:
    """(merged rows, conflicts).  The first key is the day.

    Days before today are closed: stored rows stay, a day that is not stored at
    all may be added, a new key on a stored day is a conflict.  Today's rows are
    replaced by key.
    """
    day = keys[0]
    held = old.select(day).distinct().withColumn("_held", F.lit(True))
    rows = _paired(old, new, keys).join(held, day, "left")
    is_open = F.col(day) >= F.lit(today).cast("date")
    clash = ~is_open & F.col("stored").isNull() & F.coalesce("_held", F.lit(False))
    merged = rows.filter(~clash).select(*keys, F.when(is_open, F.coalesce("recomputed", "stored")).otherwise(F.coalesce("stored", "recomputed")).alias("_r")).select(*keys, "_r.*")
    return merged, rows.filter(clash).select(*keys, "recomputed")


def coverage_corrections(old: DataFrame, new: DataFrame, keys: list[str], ignore: list[str], today: str) -> DataFrame:
    """Closed rows whose recomputed values differ outside ``ignore``; the stored ones stay in force."""
    stable = [c for c in old.columns if c not in keys and c not in ignore]
    pick = lambda side: F.struct(*[F.col(f"{side}.{c}") for c in stable])
    both = _paired(old, new, keys).filter(F.col("stored").isNotNull() & F.col("recomputed").isNotNull() & (F.col(keys[0]) < F.lit(today).cast("date")))
    return both.filter(~pick("stored").eqNullSafe(pick("recomputed")))


def drop_repeated(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs once; all rows of a repeated key go."""
    once = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1").select(key)
    return df.join(once, key, "left_semi")
