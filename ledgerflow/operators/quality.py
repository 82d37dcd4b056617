"""Validation, reconciliation, manifests, privacy reports, freshness, completeness and day-partitioned sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import sensitive_reasons

_TYPES = {"integer": (T.LongType, T.IntegerType, T.ShortType), "number": (T.DoubleType, T.FloatType, T.LongType, T.IntegerType), "string": (T.StringType,), "boolean": (T.BooleanType,)}


def _checks(schema: dict, kind: T.StructType, at: str = "") -> list[Column]:
    """A code for each broken rule of a JSON Schema object, or null."""
    have = {f.name: f.dataType for f in kind.fields}
    out: list[Column] = []
    fail = lambda cond, code: out.append(F.when(cond, F.lit(code)))
    if schema.get("additionalProperties") is False:
        for name in sorted(set(have) - set(schema["properties"])):
            fail(F.lit(True), f"additional:{at}{name}")
    for name in schema.get("required", []):
        fail(F.lit(True) if name not in have else F.col(at + name).isNull(), f"required:{at}{name}")
    for name, rule in schema["properties"].items():
        if name not in have:
            continue
        c, path = F.col(at + name), at + name
        if rule.get("type") == "object":
            out += _checks(rule, have[name], f"{path}.")
            continue
        if "type" in rule and not isinstance(have[name], _TYPES[rule["type"]]):
            fail(c.isNotNull(), f"type:{path}")
            continue
        if "enum" in rule:
            fail(~c.isin(*rule["enum"]), f"enum:{path}")
        if "const" in rule:
            fail(c != F.lit(rule["const"]), f"const:{path}")
        if "minimum" in rule:
            fail(c < rule["minimum"], f"minimum:{path}")
        if "pattern" in rule:
            fail(~c.rlike(rule["pattern"]), f"pattern:{path}")
        if "minLength" in rule:
            fail(F.length(c) < rule["minLength"], f"minLength:{path}")
    return out


def validate(df: DataFrame, schema: dict, keys: list[str]) -> DataFrame:
    """(keys, violation) for every rule of a JSON Schema that a row breaks."""
    return df.select(*keys, F.explode(F.array_compact(F.array(*_checks(schema, df.schema)))).alias("violation"))


def check_invariants(df: DataFrame, rules: dict[str, Column], keys: list[str]) -> DataFrame:
    """(keys, rule) for every rule that doesn't hold."""
    return df.select(*keys, F.explode(F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))).alias("rule"))


def forbidden_columns(df: DataFrame, names: list[str]) -> list[str]:
    return sorted(set(df.columns) & set(names))


def reconcile(layers: dict[str, DataFrame], measures: dict[str, Column], tolerance: int = 0) -> DataFrame:
    """A row for each measure: its total in every layer and whether all are within the tolerance."""
    one = None
    for name, df in layers.items():
        g = df.agg(*[m.alias(f"{name}_{k}") for k, m in measures.items()])
        one = g if one is None else one.crossJoin(g)
    rows = [F.struct(F.lit(k).alias("measure"), *[F.col(f"{n}_{k}").cast("long").alias(n) for n in layers], (F.greatest(*[F.col(f"{n}_{k}").cast("long") for n in layers]) - F.least(*[F.col(f"{n}_{k}").cast("long") for n in layers]) <= tolerance).alias("agrees")) for k in measures]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def manifest(tables: dict[str, tuple[DataFrame, str | None]]) -> DataFrame:
    """By table: rows and the first and last day it covers."""
    out = None
    for name, (df, day) in tables.items():
        g = df.agg(F.count(F.lit(1)).alias("n"), *([F.min(F.to_date(day)).alias("covers_from"), F.max(F.to_date(day)).alias("covers_to")] if day else [F.lit(None).cast("date").alias("covers_from"), F.lit(None).cast("date").alias("covers_to")]))
        g = g.select(F.lit(name).alias("dataset"), "*")
        out = g if out is None else out.unionByName(g)
    return out


def digests(tables: dict[str, tuple[DataFrame, list[str], str | Column | None]]) -> DataFrame:
    """By table and partition: rows and a digest that doesn't depend on their order.

    A table comes with the columns that count and the column of its partitions
    (None: one, named all).  The digest is the sum of the rows' md5s' first 60
    bits, a row's text being its columns joined by NUL, nulls empty.
    """
    out = None
    for name, (df, cols, part) in tables.items():
        text = F.md5(F.concat_ws("\0", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]))
        of = F.lit("all") if part is None else F.coalesce((F.col(part) if isinstance(part, str) else part).cast("string"), F.lit(""))
        g = df.select(of.alias("part"), F.conv(F.substring(text, 1, 15), 16, 10).cast("decimal(38,0)").alias("d")).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("d").cast("string").alias("digest"))
        g = g.select(F.lit(name).alias("dataset"), "part", "n", "digest")
        out = g if out is None else out.unionByName(g)
    return out


def verify_manifest(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Each partition of either manifest with its state: same, changed, added or gone; of partitions stored twice the state is repeated."""
    n = stored.groupBy("dataset", "part").agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("stored_n"), F.max("digest").alias("stored_digest"))
    both = n.join(fresh, ["dataset", "part"], "full_outer")
    state = F.when(F.col("k").isNull(), "added").when(F.col("digest").isNull(), "gone").when(F.col("k") > 1, "repeated").when((F.col("n") == F.col("stored_n")) & (F.col("digest") == F.col("stored_digest")), "same").otherwise("changed")
    return both.select("dataset", "part", state.alias("state"), "stored_n", "n")


def project_public(df: DataFrame, allow: list[str]) -> DataFrame:
    """Only the allowed columns that there are."""
    return df.select(*[c for c in allow if c in df.columns])


def privacy_report(df: DataFrame, text: str, terms: list[str] = ()) -> DataFrame:
    """How many rows give each reason not to be published."""
    return df.select(F.explode(sensitive_reasons(text, terms)).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def freshness(df: DataFrame, keys: list[str], day: str, today: str, limit: int) -> DataFrame:
    g = df.groupBy(*keys).agg(F.max(day).alias("newest"))
    return g.withColumn("age_days", F.datediff(F.lit(today).cast("date"), F.col("newest"))).withColumn("stale", F.col("age_days") > limit)


def version_agreement(df: DataFrame, version: str) -> DataFrame:
    return df.agg((F.count_distinct(version) <= 1).alias("agrees"), F.count_distinct(version).alias("versions"))


def completeness(df: DataFrame, keys: list[str], enabled: Column, available: Column, errors: Column) -> DataFrame:
    """Enabled and available sources, and whether all enabled ones are there without errors."""
    e, a = F.count_if(enabled), F.count_if(enabled & available)
    return df.groupBy(*keys).agg(e.alias("enabled"), a.alias("available"), F.count_if(enabled & errors).alias("errors")).withColumn("complete", (F.col("enabled") == F.col("available")) & (F.col("errors") == 0))


def refuse_older(batch: DataFrame, at: str, stored: DataFrame) -> DataFrame:
    """The rows of a batch, if its newest time is not before the newest stored; else none."""
    high = stored.agg(F.max(at).alias("_stored"))
    newest = batch.agg(F.max(at).alias("_batch"))
    ok = high.crossJoin(newest).filter(F.col("_stored").isNull() | (F.col("_batch") >= F.col("_stored")))
    return batch.crossJoin(F.broadcast(ok.select(F.lit(1).alias("_ok")))).drop("_ok")


def write_days(df: DataFrame, path: str, day: str, order: list[str]) -> None:
    """Write a table by day; only the days that are there are replaced."""
    df.sortWithinPartitions(*order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def write_lines(df: DataFrame, path: str, order: list[str]) -> None:
    """Write JSON lines with keys in alphabetical order, rows ordered inside each file."""
    df.select(*sorted(df.columns)).sortWithinPartitions(*order).write.mode("overwrite").json(path)


def unpivot_windows(g: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """(keys, metric, value) as one long table of whole numbers."""
    return g.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("long").alias("value")) for m in measures])).alias("m")).select(*keys, "m.metric", "m.value")
