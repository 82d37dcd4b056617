"""Sharding by a hierarchical weighted hash tree: descend region, rack and shard by weighted draws.

At every node each child draws -ln(u) / weight, u being a hash of the key and
the child's name; the least draw wins.  A child whose weight grows, or a new
child, only wins rows; a child whose weight shrinks only loses rows, so rows move
only into or out of subtrees whose weights change.  A new shard is added as a
region of its own: no other node's weight changes, so it takes rows only into
itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .jobs import Scratch, free_name, prepare

SLOT_BUCKETS = 1024


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def balanced_tree(shards: int, racks: int = 8, regions: int = 2) -> list[Leaf]:
    """Shards dealt evenly to racks, racks to regions."""
    return [Leaf(f"r{k % racks % regions}", f"k{k % racks}", k) for k in range(shards)]


def grow(tree: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard, in a region and rack of its own."""
    new = max((leaf.shard for leaf in tree), default=-1) + 1
    return [*tree, Leaf(f"g{new}", f"g{new}", new, weight)]


def _draw(key: Column, child: Column) -> Column:
    """-ln(u) / weight, u in (0, 1) from the first 13 hex digits of an md5."""
    digits = F.substring(F.md5(F.concat(key, F.lit("/"), child["name"])), 1, 13)
    return -F.ln((F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(2.0**52)) / child["weight"]


def place(key: Column, tree: list[Leaf]) -> Column:
    """The shard of a key (a string column, not null).  Shards of weight 0 take nothing."""
    below: dict[str, dict[str, float]] = {}
    for leaf in tree:
        if leaf.weight > 0:
            at = ""
            for name in (leaf.region, leaf.rack, str(leaf.shard)):
                kids = below.setdefault(at, {})
                at = f"{at}/{name}"
                kids[at] = kids.get(at, 0.0) + leaf.weight
    if not below:
        raise ValueError("no shard has a weight")
    children = F.create_map(*[x for at, kids in below.items() for x in (F.lit(at), F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight")) for n, w in kids.items()]))])
    at = F.lit("")
    for _ in range(3):
        at = F.array_min(F.transform(F.element_at(children, at), lambda c: F.struct(_draw(key, c).alias("draw"), c["name"].alias("name"))))["name"]
    return F.substring_index(at, "/", -1).cast("int")


def slots(df: DataFrame, shard: str, order: list[Column]) -> DataFrame:
    """Adds ``slot``: 0, 1, 2, ... in each shard, whatever its size.

    Rows are numbered inside (shard, one of SLOT_BUCKETS hash buckets of all of
    ``order``, so that rows which share only a key are spread); the counts of the
    buckets, at most shards x SLOT_BUCKETS rows, give each bucket its first
    number.  A slot column of the caller is replaced; its other columns stay.
    """
    bucket, n, at, first = (free_name(df, c) for c in ("_bucket", "_n", "_at", "_first"))
    df = df.withColumn(bucket, F.pmod(F.xxhash64(*order), F.lit(SLOT_BUCKETS)))
    inside = Window.partitionBy(shard, bucket).orderBy(*order)
    before = Window.partitionBy(shard).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy(shard, bucket).agg(F.count(F.lit(1)).alias(n)).withColumn(first, F.coalesce(F.sum(n).over(before), F.lit(0))).drop(n)
    rows = df.withColumn(at, F.row_number().over(inside) - 1)
    return rows.join(F.broadcast(starts), [shard, bucket]).withColumn("slot", (F.col(at) + F.col(first)).cast("long")).drop(at, first, bucket)


def shard_documents(docs: DataFrame, tree: list[Leaf]) -> DataFrame:
    """Per row of (doc_id, text): size, text_crc32, law, shard, slot and the shard after one more is added.

    A null text has no bytes; a null doc_id is keyed as the empty string.
    Repeated rows get the same shard and slots of their own; ties in a shard's
    order are broken by text_crc32 and size.  Other columns are ignored.  The
    texts are read once: the narrow rows are written, as both the counts and the
    numbering need them.
    """
    prepare(docs.sparkSession)
    bytes_of = F.coalesce(F.col("text"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(bytes_of) + 16).cast("long").alias("size"), F.crc32(bytes_of).alias("text_crc32"))
    rows = rows.withColumn("law", F.lit("key")).withColumn("shard", place(key, tree)).withColumn("grown_shard", place(key, grow(tree)))
    rows = Scratch(docs.sparkSession, "sharding").save(rows, "rows")
    return slots(rows, "shard", [F.col("doc_id"), F.col("text_crc32"), F.col("size")])
