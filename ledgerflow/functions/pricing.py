"""Pricing of token usage with a dated rate card.

Money is exact: rates are whole numbers of 1/10,000 dollar for a million tokens
and multipliers are whole halves, so a row's cost is a whole number of 5e-11
dollars; sums stay whole and one division at the end gives dollars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNITS = 2e10
PRICES = "vendor string, model string, r_input long, r_cached long, r_write long, r_write_long long, r_output long, threshold long, in_halves long, out_halves long"


def read_prices(spark, rows: list[tuple]) -> DataFrame:
    """A rate card as a small table; a missing rate is null."""
    return spark.createDataFrame(rows, PRICES)


def dollars(units: str | Column) -> Column:
    return (F.col(units) if isinstance(units, str) else units).cast("double") / UNITS


def price_usage(df: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds ``units`` (exact cost), ``unpriced_tokens`` and ``long_context`` to rows of usage.

    Model and vendor must both match; there is no fallback to a prefix.  Vendor A
    has five disjoint classes (the long cache write falls back to the short one's
    rate); for others the input contains the cached and the written part.  Input
    over the threshold multiplies this row's rates, before any sum.
    """
    p = df.join(F.broadcast(prices), ["vendor", "model"], "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    a = F.col("vendor") == "vendor_a"
    whole_in = F.when(a, z("input_tokens") + z("cache_read_tokens") + z("cache_write_5m_tokens") + z("cache_write_1h_tokens")).otherwise(z("input_tokens"))
    long_in = F.col("threshold").isNotNull() & (whole_in > F.col("threshold"))
    in_half, out_half = F.when(long_in, z("in_halves")).otherwise(F.lit(2)), F.when(long_in, z("out_halves")).otherwise(F.lit(2))
    cached = F.least(z("cached_input_tokens"), z("input_tokens"))
    written = F.least(z("cache_write_tokens"), z("input_tokens") - cached)
    plain = z("input_tokens") - cached - written
    a_in = z("input_tokens") * z("r_input") + z("cache_read_tokens") * z("r_cached") + z("cache_write_5m_tokens") * z("r_write") + z("cache_write_1h_tokens") * F.coalesce("r_write_long", "r_write", F.lit(0))
    b_in = plain * z("r_input") + cached * z("r_cached") + F.when(F.col("r_write").isNotNull(), written * F.col("r_write")).otherwise(F.lit(0))
    cost = F.when(a, a_in).otherwise(b_in) * in_half + z("output_tokens") * z("r_output") * out_half
    known = F.col("r_input").isNotNull()
    total = F.when(a, whole_in).otherwise(z("input_tokens")) + z("output_tokens")
    lost = F.when(~known, total).when(~a & F.col("r_write").isNull(), written).otherwise(F.lit(0))
    return (
        p.withColumn("units", F.when(known, cost).otherwise(F.lit(0)).cast("long"))
        .withColumn("unpriced_tokens", lost.cast("long"))
        .withColumn("long_context", F.coalesce(known & long_in, F.lit(False)))
        .drop("r_input", "r_cached", "r_write", "r_write_long", "r_output", "threshold", "in_halves", "out_halves")
    )


def price_rollup(priced: DataFrame, keys: list[str]) -> DataFrame:
    """Cost by model inside ``keys``, and the sum over models."""
    by_model = priced.groupBy(*keys, "model").agg(F.sum("units").alias("units"), F.sum("unpriced_tokens").alias("unpriced_tokens"))
    return by_model.groupBy(*keys).agg(F.sum("units").alias("units"), F.sum("unpriced_tokens").alias("unpriced_tokens"), F.count(F.lit(1)).alias("models"))


def estimate_unpriced(df: DataFrame, prices: DataFrame, classes: dict[str, str]) -> DataFrame:
    """Low, middle and high units for rows without a rate, over the vendor's rate cards; each row stays one row.

    ``classes`` maps token columns to rate columns.  A model that no card names
    is priced by all complete cards of its vendor, without long-context rates; of
    a model that only lacks a rate for cache writes just those tokens are, by all
    cards that have one.  Adds low, high, mid (their mean, halved once) and cards.
    The cards of a vendor come as one array, so rows are neither multiplied nor
    grouped; a rate card is small by nature.
    """
    rates = sorted({*classes.values(), "r_write"})
    cards = prices.groupBy("vendor").agg(F.collect_list(F.struct(*rates)).alias("_cards"))
    own = prices.select("vendor", "model", F.lit(True).alias("_known"), F.col("r_write").isNull().alias("_no_write"))
    lost = F.coalesce(F.col("cache_write_tokens"), F.lit(0)) if "cache_write_tokens" in df.columns else F.lit(0)
    partly = F.col("_known").isNotNull() & F.col("_no_write") & (F.col("vendor") != "vendor_a") & (lost > 0)
    rows = df.join(F.broadcast(own), ["vendor", "model"], "left").join(F.broadcast(cards), "vendor", "left").filter(F.col("_known").isNull() | partly)
    whole = lambda c: sum((F.coalesce(F.col(t), F.lit(0)) * c[r] for t, r in classes.items()), F.lit(0)) * 2
    unknown = F.transform(F.filter("_cards", lambda c: F.forall(F.array(*[c[r] for r in sorted(set(classes.values()))]), lambda x: x.isNotNull())), whole)
    written = F.transform(F.filter("_cards", lambda c: c["r_write"].isNotNull()), lambda c: lost * c["r_write"] * 2)
    offered = rows.withColumn("_u", F.coalesce(F.when(F.col("_known").isNull(), unknown).otherwise(written), F.array().cast("array<bigint>")))
    out = offered.withColumns({"low": F.array_min("_u"), "high": F.array_max("_u"), "cards": F.size("_u").cast("long")})
    return out.withColumn("mid", (F.col("low") + F.col("high")).cast("double") / 2).drop("_u", "_cards", "_known", "_no_write")


def combine_estimates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Status and sums of estimates: not_needed, available, partial or unavailable."""
    need, have = F.count_if(F.col("needed")), F.count_if(F.col("needed") & F.col("low").isNotNull())
    status = F.when(need == 0, "not_needed").when(have == 0, "unavailable").when(have < need, "partial").otherwise("available")
    return df.groupBy(*keys).agg(status.alias("status"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("low", "high")])


def amortize(days: DataFrame, monthly_cents: int, accepted: str) -> DataFrame:
    """A monthly price by day (a month is 365.2425 / 12 days) and by accepted unit; null if none was accepted."""
    daily = monthly_cents * 12 / 365.2425
    return days.withColumn("daily_cents", F.lit(daily)).withColumn("cents_per_accepted", F.when(F.col(accepted) > 0, F.lit(daily) / F.col(accepted)))


def scenario_values(df: DataFrame, assumptions: DataFrame) -> DataFrame:
    """Recorded hours against manual hours under each assumption; invalid input gives null values.

    ``df`` has hours and cash, ``assumptions`` manual_hours, hourly, share and alternative.
    """
    ok = (F.col("hours") >= 0) & (F.col("manual_hours") >= 0) & (F.col("hourly") > 0) & F.col("share").between(0, 1)
    value = lambda c: F.when(ok, c)
    return df.crossJoin(F.broadcast(assumptions)).select(
        "*",
        value(F.col("manual_hours") - F.col("hours")).alias("delta"),
        value(F.col("hours") + F.col("cash") / F.col("hourly")).alias("equivalent"),
        value(F.col("hours") * F.col("share") * F.col("alternative")).alias("opportunity"),
    )


def enrich_history(history: DataFrame, prices: DataFrame, classes: dict[str, str], keys: list[str]) -> DataFrame:
    """Estimates of stored unpriced rows at today's rates, summed by ``keys``; the stored rows are not touched."""
    g = estimate_unpriced(history, prices, classes).groupBy(*keys)
    return g.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("low").alias("low"), F.sum("high").alias("high"))
