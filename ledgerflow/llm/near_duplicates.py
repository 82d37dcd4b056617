"""Near-duplicate documents: bottom-k sketches, inverted lists, union-sketch estimates, exact verification.

A document is its set of distinct word shingles.  Equal sets are one node.  One
hash function orders all shingles; a sketch keeps the SKETCH smallest.  The
LISTED smallest are inverted: documents that share one of them are candidates.
The estimate from the smallest values of the union of two sketches drops pairs
far under the threshold, the full sets decide about the others, and components
of the links are found by alternating stars.

A list of at most SHORT documents gives all its pairs; a longer one only the
pairs with two of its members: the one of the smallest doc_id, and the one that
is in most of the long lists, as the origin of many variants is.  What that can miss lies between documents most
of whose listed values are in long lists.  Those few kinds of documents (large
groups of near copies, texts made of common passages) go through an exact prefix
join over their full sets: with shingles ordered by how many of these documents
have them, linked documents share one in their prefixes.  Only pairs across the
components known by then are tried, so a large group that already hangs together
costs no pairs.

A pair at the threshold t fails to share a listed value with probability
(1-t)**LISTED, 1e-19 at 0.85; one with two thirds of its listed values in short
lists shares one of those but for 3e-7 in the worst case.  All pairs, those of
the prefix join too, pass the estimate first; at its margin of over five standard
deviations it drops 6e-7 of pairs at 0.85 and 4e-6 at 0.80.

A vertex is a distinct set, with a number of its own, so rows that share a
doc_id keep the links of each of their texts.  Joins between tables that both
grow with the documents are sort-merge joins; none of them is broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .components import components
from .jobs import Scratch, free_name, growing, join_ids, prepare, tidy
from .shingles import mix, shingles

WIDTH = 5
SKETCH = 64
LISTED = 24
SHORT = 32
MARGIN = 0.25

_SIGN = np.uint64(1 << 63)


def _signed(s: np.ndarray) -> np.ndarray:
    """The same order as signed numbers, which Spark has."""
    return (s ^ _SIGN).view(np.int64)


def _key(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    return int(mix(s).sum(dtype=np.uint64).view(np.int64)), int(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).view(np.int64))


def _text_keys(text: str = "text") -> list:
    """Two hashes of a text, null as empty: with the doc_id they name a row."""
    t = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(t), F.hash(t)]


def sketches(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, t1 and t2 (hashes of the text), n (size of the set), k1 and k2 (its key, null if it is empty) and sketch (its smallest values, ascending)."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            n, k1, k2, low = [], [], [], []
            for s in shingles(b["text"], width):
                a, c = _key(s) if len(s) else (None, None)
                n.append(len(s))
                k1.append(a)
                k2.append(c)
                low.append(_signed(s[:SKETCH]))
            ends = np.cumsum([0, *map(len, low)])
            flat = np.concatenate(low) if low else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["t1"], b["t2"], pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["doc_id", "t1", "t2", "n", "k1", "k2", "sketch"])

    t1, t2 = _text_keys()
    return docs.select("doc_id", "text", t1.alias("t1"), t2.alias("t2")).mapInArrow(tidy(run), f"doc_id {key}, t1 long, t2 int, n long, k1 long, k2 long, sketch array<long>")


def set_nodes(made: DataFrame) -> DataFrame:
    """(node, n, sketch, doc_id, t1): each distinct set once, with the smallest doc_id that has it and that row's text.

    A node's number is k1; should two sets have one k1, the other gets a hash of both halves.
    """
    some = made.filter("k1 is not null and doc_id is not null")
    sets = some.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("doc_id"), F.min_by("t1", "doc_id").alias("t1"), F.any_value("sketch").alias("sketch"))
    clash = some.groupBy("k1").agg(F.min("k2").alias("lo"), F.max("k2").alias("hi")).filter("lo < hi")
    number = F.col("k1")
    if not clash.isEmpty():
        sets = sets.join(clash, "k1", "left")
        number = F.when(F.col("k2") > F.col("lo"), F.xxhash64("k1", "k2")).otherwise(F.col("k1"))
    return sets.select(number.alias("node"), "k1", "k2", "n", "sketch", "doc_id", "t1")


def full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, n, shingles) of ``wanted`` (node, doc_id, t1), from their whole texts; rows repeated in docs count once."""
    keyed = docs.select("doc_id", "text", _text_keys()[0].alias("t1"))
    rows = join_ids(keyed, wanted, ["doc_id", "t1"]).select("node", "text").dropDuplicates(["node"])

    def run(batches):
        for b in batches:
            kept = [_signed(s) for s in shingles(b["text"], width)]
            ends = np.cumsum([0, *map(len, kept)])
            flat = np.concatenate(kept) if kept else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b["node"], pa.array(np.diff(ends), pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["node", "n", "shingles"])

    return rows.mapInArrow(tidy(run), "node long, n long, shingles array<long>")


def _sides(nodes: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """Two copies of a table by node, for the two ends of a pair."""
    return tuple(nodes.select(F.col("node").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in names]) for end in ("a", "b"))


def estimated(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs whose resemblance, estimated from the smallest values of both sketches together, is at least ``least``."""
    left, right = _sides(nodes, ["sketch"])
    both = pairs.join(growing(left), "a").join(growing(right), "b")
    lowest = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, SKETCH)
    shared = F.size(F.array_intersect(lowest, F.array_intersect("sketch_a", "sketch_b")))
    return both.filter(shared >= F.lit(least) * F.size(lowest)).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (each given once) with den * |intersection| >= num * |union| over full sets."""
    left, right = _sides(sets, ["n", "shingles"])
    common = F.size(F.array_intersect("shingles_a", "shingles_b"))
    return pairs.join(growing(left), "a").join(growing(right), "b").filter(common * den >= (F.col("n_a") + F.col("n_b") - common) * num).select("a", "b")


def near_duplicates(docs: DataFrame, num: int = 80, den: int = 100, width: int = WIDTH) -> DataFrame:
    """Per row of (doc_id, text): doc_id, n_shingles, component_id and kept.

    Documents are linked if den * |intersection| >= num * |union| of their
    shingle sets; a component's id is its smallest doc_id, and that document is
    kept.  Texts that are null, empty or without words have no shingles and link
    with nothing.  Rows with a null doc_id link with nothing: their component is
    null and they are kept.  Rows that share a doc_id but not a set are
    documents of their own, each with the links of its text.
    """
    return judged(docs, num, den, width).select("doc_id", "n_shingles", "component_id", "kept")


def judged(docs: DataFrame, num: int, den: int, width: int) -> DataFrame:
    """``near_duplicates`` with the rows' text hashes t1 and t2, and the number c of each component (null without one)."""
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "near-duplicates")
    named = docs.select("doc_id", "text")
    made = scratch.save(sketches(named, width), "sketches")
    nodes = scratch.save(set_nodes(made), "nodes")

    near = lambda x, y: (x * den >= y * num) & (y * den >= x * num)
    entries = nodes.select("node", "n", "doc_id", F.explode(F.slice("sketch", 1, LISTED)).alias("v"))
    lists = entries.groupBy("v").agg(F.count(F.lit(1)).alias("c"), F.min_by(F.struct("node", "n"), F.struct("doc_id", "node")).alias("hub")).filter("c > 1")
    lists = scratch.save(lists, "lists")
    shared = scratch.save(entries.drop("doc_id").join(growing(lists), "v"), "shared")
    short, long = shared.filter(F.col("c") <= SHORT), shared.filter(F.col("c") > SHORT)
    left = short.select("v", F.col("node").alias("a"), F.col("n").alias("n_a"))
    right = short.select("v", F.col("node").alias("b"), F.col("n").alias("n_b"))
    overlaps = left.join(growing(right), "v").filter((F.col("a") < F.col("b")) & near(F.col("n_a"), F.col("n_b"))).groupBy("a", "b").agg(F.count(F.lit(1)).alias("overlap"))
    often_listed = scratch.save(long.groupBy("node").agg(F.count(F.lit(1)).alias("h"), F.first("n").alias("n")), "listed")
    pairs = overlaps.select("a", "b")
    if not often_listed.isEmpty():
        ranked = long.select("v", "node", "n").join(growing(often_listed.select("node", "h")), "node")
        central = scratch.save(ranked.groupBy("v").agg(F.max_by(F.struct("node", "n"), F.struct("h", "node")).alias("hub")), "central")
        stars = [x.filter((F.col("node") != F.col("hub.node")) & near(F.col("n"), F.col("hub.n"))).select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")) for x in (long, long.drop("hub").join(growing(central), "v"))]
        pairs = pairs.unionByName(stars[0]).unionByName(stars[1]).distinct()
    likely = scratch.save(estimated(pairs, nodes, num / den - MARGIN), "likely")

    crowded = scratch.save(often_listed.filter(F.col("h") * 3 > F.least("n", F.lit(LISTED))).select("node"), "crowded")
    ends = [likely.select(F.col(c).alias("node")) for c in ("a", "b")]
    wanted = nodes.select("node", "doc_id", "t1").join(growing(ends[0].unionByName(ends[1]).unionByName(crowded).distinct()), "node", "left_semi")
    sets = scratch.save(full_sets(named, scratch.save(wanted, "wanted"), width), "sets")
    links = scratch.save(verified(likely, sets, num, den), "links")
    found = scratch.save(components(links, scratch, "first"), "found")

    final = found
    if not crowded.isEmpty():
        more = scratch.save(crowded_pairs(sets.join(growing(crowded), "node", "left_semi"), found, num, den, scratch), "more")
        links2 = scratch.save(verified(estimated(more, nodes, num / den - MARGIN), sets, num, den), "links2")
        if not links2.isEmpty():
            final = scratch.save(components(links.unionByName(links2), scratch, "second"), "final")
    named_by = nodes.select("node", "k1", "k2", "doc_id").join(growing(final), "node", "left").select("k1", "k2", "doc_id", F.coalesce("component", "node").alias("c"))
    least = named_by.groupBy("c").agg(F.min("doc_id").alias("least"))
    ids = scratch.save(named_by.drop("doc_id").join(growing(least), "c"), "ids")
    rows = scratch.save(made.drop("sketch").join(growing(ids), ["k1", "k2"], "left"), "rows")
    scratch.drop("sketches", "nodes", "lists", "shared", "listed", "central", "likely", "crowded", "wanted", "sets", "links", "found", "often", "prefix", "largest", "mixed", "more", "links2", "final", "ids")
    known = F.col("doc_id").isNotNull()
    component = F.when(known, F.coalesce("least", "doc_id"))
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
    return rows.select("doc_id", "t1", "t2", F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"), F.when(known, F.col("c")).alias("c"))


def crowded_pairs(sets: DataFrame, found: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """Candidate pairs (a, b) across known components, by an exact prefix join of full sets.

    What is joined on shingles is written first: such a join reads two plain
    shuffles, and Spark can split a shingle that very many documents have.
    """
    rows = sets.join(growing(found), "node", "left").select("node", "n", F.coalesce("component", "node").alias("comp"), F.explode("shingles").alias("s"))
    often = scratch.save(rows.groupBy("s").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "often")
    known = rows.join(growing(often), "s")
    order = Window.partitionBy("node").orderBy("df", "s")
    size = Window.partitionBy("node")
    ranked = known.withColumn("r", F.row_number().over(order)).withColumn("m", F.count(F.lit(1)).over(size))
    place = F.col("r") + F.col("n") - F.col("m")
    prefix = ranked.withColumn("at", place).filter(F.col("at") <= F.col("n") - F.ceil(F.col("n") * num / den) + 1)
    prefix = scratch.save(prefix.select("s", "node", "n", "comp", "at"), "prefix")
    by_comp = prefix.groupBy("s", "comp").agg(F.count(F.lit(1)).alias("k"))
    largest = by_comp.groupBy("s").agg(F.count(F.lit(1)).alias("comps"), F.max(F.struct("k", "comp")).alias("top")).filter("comps > 1")
    largest = scratch.save(largest.select("s", F.col("top.comp").alias("top")), "largest")
    mixed = scratch.save(prefix.join(growing(largest), "s"), "mixed")
    a = mixed.filter("comp <> top").select("s", F.col("node").alias("x"), F.col("n").alias("nx"), F.col("comp").alias("cx"), F.col("at").alias("ax"))
    b = mixed.select("s", F.col("node").alias("y"), F.col("n").alias("ny"), F.col("comp").alias("cy"), F.col("at").alias("ay"), (F.col("comp") == F.col("top")).alias("main"))
    rest = F.least(F.col("nx") - F.col("ax"), F.col("ny") - F.col("ay")) + 1
    enough = rest * (den + num) >= (F.col("nx") + F.col("ny")) * num
    close = (F.col("nx") * den >= F.col("ny") * num) & (F.col("ny") * den >= F.col("nx") * num)
    pairs = a.join(growing(b), "s").filter((F.col("cx") != F.col("cy")) & (F.col("main") | (F.col("x") < F.col("y"))) & enough & close)
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def keep_one_of_each(docs: DataFrame, num: int = 80, den: int = 100, width: int = WIDTH) -> DataFrame:
    """The rows, with all their columns, of one document of each component.

    Of rows with the same doc_id and equal texts one stays; of different texts of
    one component that share the doc_id which is kept, the one of the lowest
    hash.  Rows with a null doc_id all stay.
    """
    scratch = Scratch(docs.sparkSession, "kept")
    rows = judged(docs, num, den, width).filter("doc_id is not null")
    stay = rows.filter("kept")
    several = scratch.save(stay.filter("c is not null").groupBy("c").agg(F.min("t1").alias("lo"), F.max("t1").alias("hi")).filter("lo < hi").select("c", "lo"), "several")
    k1, k2 = free_name(docs, "t1"), free_name(docs, "t2")
    key = ["doc_id", k1, k2]
    lost = rows.filter("not kept").select("doc_id", "t1", "t2").unionByName(stay.join(several, "c").filter("t1 > lo").select("doc_id", "t1", "t2")).distinct().toDF(*key)
    keyed = docs.withColumns(dict(zip((k1, k2), _text_keys())))
    left = join_ids(keyed, scratch.save(lost, "lost"), key, "left_anti")
    twice = scratch.save(stay.groupBy("doc_id", "t1", "t2").count().filter("count > 1").select("doc_id", "t1", "t2").toDF(*key), "twice")
    if not twice.isEmpty():
        left = join_ids(left, twice, key, "left_anti").unionByName(join_ids(left, twice, key, "left_semi").dropDuplicates(key))
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])
