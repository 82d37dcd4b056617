"""Connected components of links between ids, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jobs import Scratch, growing


def components(links: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(node, component): the smallest id that a node of ``links`` (a, b) reaches.

    Every round links each node's larger neighbours to its smallest one, then its
    smaller ones; a round is two aggregations and two joins of the links, written
    to the shared folder.  It was the last if only stars are left: no node has two
    smaller ones or is both an end and a centre.  The number of rounds grows with
    the logarithm of the links.  Links of a node with itself and repeated links do
    no harm.
    """
    edges = scratch.save(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    k, stars = 0, False
    while not stars:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(growing(least), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        first = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(growing(first), "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        k += 1
        edges = scratch.save(small.distinct(), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        roles = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        stars = not roles.agg(F.bool_or(F.col("up") + F.col("down") > 1)).first()[0]
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
