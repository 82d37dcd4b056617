"""Top rows with an exact remainder, recent rows, chosen windows and old items."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n_plus_other(df: DataFrame, keys: list[str], label: str, value: str, sums: list[str], n: int = 6, nulls: bool = False) -> DataFrame:
    """The n labels of greatest value by key and one row 'other' with the sums of the rest.

    ``df`` has one row for each key and label.  Ties go to the lesser label.  The
    rest is the key's totals less those of the top, so only n rows of a key are
    ever ordered together; sums should be whole numbers.  With ``nulls`` the sum
    of the rest is null where all its values are.
    """
    cols = list(dict.fromkeys([value, *sums]))
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(value).desc_nulls_last(), F.col(label)))
    top = df.withColumn("position", rn).filter(F.col("position") <= n)
    first = top.select(*keys, "position", F.col(label).cast("string").alias("label"), *cols, F.lit(0).cast("long").alias("other_count"))
    if not nulls:
        first = first.withColumns({c: F.coalesce(c, F.lit(0)) for c in cols})

    def totals(rows: DataFrame, mark: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"_rows{mark}"), *[F.coalesce(F.sum(c), F.lit(0)).alias(f"_sum_{c}{mark}") for c in cols], *[F.count(c).alias(f"_k_{c}{mark}") for c in cols])

    both = totals(df, "").join(totals(top, "_top"), keys).filter(F.col("_rows") > F.col("_rows_top"))
    rest = lambda c: F.col(f"_sum_{c}") - F.col(f"_sum_{c}_top")
    left = [(F.when(F.col(f"_k_{c}") > F.col(f"_k_{c}_top"), rest(c)) if nulls else rest(c)).alias(c) for c in cols]
    other = both.select(*keys, F.lit(n + 1).alias("position"), F.lit("other").alias("label"), *left, (F.col("_rows") - F.col("_rows_top")).alias("other_count"))
    return first.unionByName(other)


def recent_n(df: DataFrame, order: list[Column], n: int = 6) -> DataFrame:
    return df.orderBy(*order).limit(n)


def select_windows(df: DataFrame, keys: list[str], name: str, size: str, preferred: list[str], most: int = 2) -> DataFrame:
    """At most ``most`` rows by key: preferred names in their order, else the shortest, then the longest."""
    place = F.coalesce(*[F.when(F.col(name) == p, F.lit(i)) for i, p in enumerate(preferred)], F.lit(len(preferred)))
    w = Window.partitionBy(*keys)
    ranked = df.withColumn("_p", place).withColumn("_up", F.row_number().over(w.orderBy(size, name))).withColumn("_down", F.row_number().over(w.orderBy(F.col(size).desc(), F.col(name).desc())))
    other = F.when(F.col("_up") == 1, 0).when(F.col("_down") == 1, 1).otherwise(F.col("_up"))
    return ranked.withColumn("_n", F.row_number().over(w.orderBy("_p", other, name))).filter(F.col("_n") <= most).drop("_p", "_up", "_down", "_n")


def older_than(df: DataFrame, day: str, today: str, days: int, unit: str | None = None) -> DataFrame:
    """Rows more than ``days`` old; with ``unit`` only whole units whose newest row is."""
    limit = F.date_sub(F.lit(today).cast("date"), days)
    if unit is None:
        return df.filter(F.col(day) < limit)
    return df.join(df.groupBy(unit).agg(F.max(day).alias("_newest")).filter(F.col("_newest") < limit).select(unit), unit, "left_semi")


def place_in_order(df: DataFrame, lead: dict[str, bool], order: list[str]) -> DataFrame:
    """Adds ``place``, from 1, in the order of the lead columns (True: ascending) and then of ``order``.

    Rows are numbered inside each combination of the lead columns; the numbers of
    rows of those before it are added, so only one row for each combination is
    ever ordered in one partition.  Lead columns may be null.
    """
    ways = [F.col(c).asc() if up else F.col(c).desc() for c, up in lead.items()]
    before = Window.orderBy(*ways).rowsBetween(Window.unboundedPreceding, -1)
    groups = df.groupBy(*lead).agg(F.count(F.lit(1)).alias("_n")).select(*lead, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = [F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")) for c in lead]
    both = df.alias("_a").join(groups.alias("_b"), reduce(lambda x, y: x & y, same)).select("_a.*", "_b._before")
    return both.withColumn("place", F.col("_before") + F.row_number().over(Window.partitionBy(*lead).orderBy(*order))).drop("_before")
