"""Exact order statistics without a task that holds all values.

Equal values are counted first.  A monotone function of the value deals them to
BINS bins; running counts over the bins of a key, of which there are at most
BINS, tell the bins in which the wanted ranks lie.  Only the values of those
bins are ordered, each bin by itself, and only the two values around a rank are
picked and interpolated.  Nothing is sampled, so every run gives the same rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 65536


def _on(a: DataFrame, b: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join by keys that may be null; the columns of both, the keys once."""
    same = reduce(lambda x, y: x & y, [F.col(f"_a.{k}").eqNullSafe(F.col(f"_b.{k}")) for k in keys], F.lit(True))
    return a.alias("_a").join(b.alias("_b"), same, how).select("_a.*", *[F.col(f"_b.{c}") for c in b.columns if c not in keys])


def order_statistics(df: DataFrame, value: str | Column, fractions: dict[str, float], keys: list[str] = (), bins: int = BINS) -> DataFrame:
    """The keys and a column for each fraction: the value at rank (n - 1) * fraction, between two values in proportion.

    Nulls and values that are not finite don't count; keys without any value have
    no row.  Keys may be null.
    """
    keys = list(keys)
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    rows = df.select(*keys, v.alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v") & (F.abs("_v") < float("inf")))
    counts = rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    span = rows.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    if not keys:
        span = F.broadcast(span.filter("_n > 0"))
    share = F.log1p(F.col("_v") - F.col("_lo")) / F.log1p(F.col("_hi") - F.col("_lo"))
    binned = _on(counts, span, keys, "inner").withColumn("_bin", F.when(F.col("_hi") > F.col("_lo"), F.floor(share * bins)).otherwise(F.lit(0).cast("long"))).drop("_lo", "_hi")
    at = {c: F.lit(f) * (F.col("_n") - 1) for c, f in fractions.items()}
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(p), F.ceil(p)) for p in at.values()])))
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    filled = binned.groupBy(*keys, "_bin", "_n").agg(F.sum("_c").alias("_b")).withColumn("_start", F.coalesce(F.sum("_b").over(before), F.lit(0)))
    chosen = filled.filter(F.exists(ranks, lambda r: (r >= F.col("_start")) & (r < F.col("_start") + F.col("_b")))).select(*keys, "_bin", "_start")
    inside = Window.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    placed = _on(binned, chosen, [*keys, "_bin"], "inner").withColumn("_first", F.col("_start") + F.coalesce(F.sum("_c").over(inside), F.lit(0)))
    holds = lambda r: (r >= F.col("_first")) & (r < F.col("_first") + F.col("_c"))
    around = [F.max(F.when(holds(side(p)), F.col("_v"))).alias(f"_{name}_{c}") for c, p in at.items() for name, side in (("low", F.floor), ("high", F.ceil))]
    picked = placed.groupBy(*keys, "_n").agg(*around)
    out = {c: F.when(F.col(f"_low_{c}") == F.col(f"_high_{c}"), F.col(f"_low_{c}")).otherwise((F.ceil(p) - p) * F.col(f"_low_{c}") + (p - F.floor(p)) * F.col(f"_high_{c}")) for c, p in at.items()}
    return picked.select(*keys, *[x.alias(c) for c, x in out.items()])


def with_statistics(rows: DataFrame, statistics: DataFrame, keys: list[str] = ()) -> DataFrame:
    """The rows, one for each key, with the statistics of their keys; null where there are none."""
    return _on(rows, statistics if keys else F.broadcast(statistics), list(keys), "left")
