"""Connected components by joins and aggregations."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; on one machine, where it is unset, one of our own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="spark-shared-"))
    return sc.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """A checkpoint in that folder."""
    _folder(df.sparkSession)
    return df.checkpoint()


class Kept:
    """Written tables of one run in that folder; unlike checkpoints they can be deleted as the run goes on."""

    def __init__(self, spark: SparkSession):
        self.spark, self.at = spark, f"{_folder(spark)}/kept-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.at}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.at}/{name}")

    def drop(self, name: str) -> None:
        """Delete a table that no later step reads."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.at}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) of undirected edges (a, b): the least node of each component; nodes must be of one type.

    Each step hangs the greater neighbours of a node, then the lesser ones, on
    the least node that it sees, until nothing moves; the number of steps grows
    with the logarithm of the longest path.  Edges are written after each, and those
    of the step before are deleted.
    """
    kept = Kept(edges.sparkSession)
    low, high = F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")
    cur = kept.save(edges.filter("a is not null and b is not null").select(low, high).distinct(), "edges")
    nodes = cur.select(F.col("low").alias("node")).union(cur.select("high")).distinct()
    before, step = None, 0
    while True:
        mark = cur.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("low", "high").cast("decimal(38,0)")), F.lit(0))).first()
        if mark == before:
            break
        before = mark
        both = cur.select(F.col("low").alias("u"), F.col("high").alias("v")).union(cur.select("high", "low"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        up = both.join(least, "u").filter("v > u").select(F.col("m").alias("low"), F.col("v").alias("high")).filter("low < high").distinct()
        least = up.groupBy("high").agg(F.min("low").alias("m"))
        down = up.join(least, "high").select("m", F.explode(F.array("low", "high")).alias("high")).filter("m < high").select(F.col("m").alias("low"), "high").distinct()
        step += 1
        cur = kept.save(down, f"step{step}")
        kept.drop(f"step{step - 1}")
    roots = cur.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("component"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
