"""Toxicity: class-conditional Kneser-Ney models of words, compared by length-normalised log-likelihood.

Each class has a model that spells a word: its first character, its first two,
and so on up to DEPTH, then the whole word.  Every such node has the number of
texts of the class and words in them that reach it; a discount is taken from
each count (from the numbers of ones and twos, as Kneser and Ney have it) and
handed, with STRENGTH counts more, to a backoff that both classes share: of the
distinct words behind the parent, the share that goes on through the node, in
either class, however often (Kneser and Ney's numbers of continuations).  So a rare expression is
judged alike by both, and only one with evidence apart; a word that was never
seen is judged by the longest beginning that was.  Nodes whose two
log-probabilities differ by less than FLOOR count as alike and aren't kept.

A toxic text consists mostly of ordinary words, a share MIXED of its words being
drawn from the toxic model.  The log-likelihood ratio of a text is the sum over
its distinct words of log(1 - MIXED + MIXED * P(word | toxic) / P(word | ordinary));
divided by their number it is the text's contrast.  A logistic curve over the
arsinh of the contrast, in units of the spread of ordinary texts, fitted on rows
kept from the counts, makes it a probability.

All counts are tables made by Spark from all labelled rows, and grow with them:
one row for each word, one for each node.  The kept nodes are broadcast if they
are at most MOST_NODES; beyond that they stay a table, which the distinct words
of the texts are joined with.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jobs import Scratch, free_name, join_ids, prepare, tidy
from .units import DEPTH, END, node_hashes, words

#: Chosen on the rows that set the curve (crc32 mod 5 is 1), from STRENGTH 1, 5, 20, 80 and FLOOR 0, 0.2: the fewest errors, then the fewest nodes.
STRENGTH = 20.0
FLOOR = 0.2
MIXED = 0.02
MOST_NODES = 4_000_000
BINS = 4096
#: Contrasts are binned by their arsinh in units of UNIT, over +-REACH.
UNIT = 1e-3
REACH = 12.0


def _texts(b: np.ndarray, s: np.ndarray, e: np.ndarray) -> pa.Array:
    """The strings between start and end."""
    sizes = e - s
    ends = np.cumsum(sizes)
    flat = b[np.arange(ends[-1] if len(ends) else 0) + np.repeat(s - ends + sizes, sizes)]
    return pa.StringArray.from_buffers(len(s), pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat)))


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, plain, toxic): in how many rows of (text, label) of each class a word is."""

    def run(batches):
        for batch in batches:
            label = batch["label"].to_numpy(zero_copy_only=False)
            for row, number, b, s, e, _ in words(batch["text"]):
                n = [np.bincount(number[label[row] == c], minlength=len(s)) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([_texts(b, s, e), pa.array(n[0]), pa.array(n[1])], ["word", "plain", "toxic"])

    each = rows.select("text", F.col("label").cast("int").alias("label")).mapInArrow(tidy(run), "word string, plain long, toxic long")
    return each.groupBy("word").agg(F.sum("plain").alias("plain"), F.sum("toxic").alias("toxic"))


def _nodes_of(word: str):
    """The nodes of a word with their parents, in order."""
    return F.transform(
        F.sequence(F.lit(1), F.least(F.length(word), F.lit(DEPTH)) + 1),
        lambda k: F.when(k <= F.least(F.length(word), F.lit(DEPTH)), F.struct(F.substring(word, F.lit(1), k).alias("node"), F.substring(word, F.lit(1), k - 1).alias("parent")))
        .otherwise(F.struct(F.concat(F.col(word), F.lit(END)).alias("node"), F.substring(word, 1, DEPTH).alias("parent"))),
    )


def node_counts(counted: DataFrame) -> DataFrame:
    """(node, parent, plain, toxic, kinds) of all beginnings of the counted words; kinds is the number of distinct words behind a node."""
    each = counted.select(F.explode(_nodes_of("word")).alias("n"), "plain", "toxic")
    return each.groupBy("n.node", "n.parent").agg(F.sum("plain").alias("plain"), F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("kinds"))


def node_values(nodes: DataFrame, discounts: tuple[float, float]) -> DataFrame:
    """(node, value): log P(node | parent, toxic) - log P(node | parent, ordinary) of the nodes that tell the classes apart."""
    taken = {c: F.least(F.col(c).cast("double"), F.lit(d)) for c, d in zip(("plain", "toxic"), discounts)}
    of = nodes.groupBy("parent").agg(F.sum("kinds").alias("all_kinds"), *[F.sum(c).alias(f"all_{c}") for c in taken], *[F.sum(t).alias(f"left_{c}") for c, t in taken.items()])
    shared = F.col("kinds") / F.col("all_kinds")
    p = {c: (F.col(c) - t + (F.col(f"left_{c}") + STRENGTH) * shared) / (F.col(f"all_{c}") + STRENGTH) for c, t in taken.items()}
    value = F.log(p["toxic"] / p["plain"])
    return nodes.join(of, "parent").select("node", value.cast("float").alias("value")).filter(F.abs("value") >= FLOOR)


@dataclass
class ToxicityModel:
    """Node values (sorted hashes and floats, or a table if they are many) and the curve."""

    keys: np.ndarray
    values: np.ndarray
    center: float = 0.0
    scale: float = 1.0
    slope: float = 1.0
    shift: float = 0.0
    table: DataFrame | None = None

    def contrast(self, column: pa.Array) -> np.ndarray:
        """The mean over a text's distinct words of their log-likelihood ratios; the centre for texts without words."""
        total, n = np.zeros(len(column)), np.zeros(len(column), np.int64)
        for row, number, _, s, _, paths in words(column):
            r = np.zeros(len(s))
            for p in paths() if len(self.keys) else ():
                at = np.minimum(np.searchsorted(self.keys, p), len(self.keys) - 1)
                r += np.where((self.keys[at] == p) & (p != 0), self.values[at], 0.0)
            total += np.bincount(row, mixed(r)[number], len(column))
            n += np.bincount(row, minlength=len(column))
        return np.where(n > 0, total / np.maximum(n, 1), self.center)

    def score(self, contrast: np.ndarray) -> np.ndarray:
        z = self.slope * np.arcsinh((contrast - self.center) / self.scale) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def mixed(ratio: np.ndarray) -> np.ndarray:
    return np.log1p(MIXED * np.expm1(np.minimum(ratio, 60.0)))


def _logistic(x: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the likeliest logistic curve for binned counts, by damped Newton steps."""
    used = pos + neg > 0
    x, pos, neg = x[used], pos[used], neg[used]
    mean = (x * neg).sum() / max(neg.sum(), 1)
    scale = max(float(np.sqrt((neg * (x - mean) ** 2).sum() / max(neg.sum(), 1))), 1e-3)
    z, w = (x - mean) / scale, np.array([1.0, 0.0])

    def loss(w):
        t = w[0] * z + w[1]
        return (pos * np.logaddexp(0, -t) + neg * np.logaddexp(0, t)).sum() + 5e-3 * (w**2).sum()

    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(w[0] * z + w[1], -500, 500)))
        r, v = pos - (pos + neg) * p, (pos + neg) * p * (1 - p)
        g = np.array([(r * z).sum(), r.sum()]) - 1e-2 * w
        step = np.linalg.solve(np.array([[(v * z * z).sum(), (v * z).sum()], [(v * z).sum(), v.sum()]]) + 1e-2 * np.eye(2), g)
        size = 1.0
        while loss(w + size * step) > loss(w) and size > 1e-9:
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-9:
            break
    if w[0] <= 0:  # too few rows to tell; more evidence never lowers a score
        w = np.array([1.0, np.log((pos.sum() + 1) / (neg.sum() + 1)) - 1])
    return float(w[0] / scale), float(w[1] - w[0] * mean / scale)


def _curve(neg: np.ndarray, pos: np.ndarray) -> tuple[float, float, float, float]:
    """Centre, scale, slope and shift from the binned contrasts of both classes."""
    m = np.sinh((np.arange(BINS + 1) / BINS - 0.5) * 2 * REACH) * UNIT
    below = np.cumsum(neg) / neg.sum()
    low, center, high = (float(m[np.searchsorted(below, q)]) for q in (0.25, 0.5, 0.75))
    scale = max((high - low) / 1.35, UNIT)
    return center, scale, *_logistic(np.arcsinh((m - center) / scale), pos, neg)


def fit(labelled: DataFrame, most: int = MOST_NODES) -> ToxicityModel | None:
    """Train on all rows of (doc_id, text, label 0/1); ``most`` bounds the nodes that are broadcast.

    Rows whose crc32(doc_id as text) mod 5 is 1 set the curve, the others give
    the counts, equal texts with equal labels once; with no such rows all do
    both.  None if a class is absent: there is nothing to compare.
    """
    spark = labelled.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "toxicity")
    rows = labelled.filter("label in (0, 1) and text is not null")
    aside = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    learn = rows.filter(F.coalesce(~aside, F.lit(True))).select("text", F.col("label").cast("int").alias("label")).distinct()
    nodes = scratch.save(node_counts(scratch.save(word_counts(learn), "words")), "nodes")
    seen = nodes.agg(*[f for c in ("plain", "toxic") for f in (F.coalesce(F.sum(c), F.lit(0)), F.count_if(F.col(c) == 1), F.count_if(F.col(c) == 2))]).first()
    if not (seen[0] and seen[3]):
        return None
    table = scratch.save(node_values(nodes, tuple(ones / (ones + 2 * twos) if ones and twos else 0.75 for ones, twos in (seen[1:3], seen[4:6]))), "values")
    scratch.drop("words", "nodes")
    model = ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), table=table)
    if table.count() <= most:
        got = table.toArrow()
        keys, values = np.concatenate([node_hashes(c) for c in got["node"].chunks] or [model.keys]), got["value"].to_numpy().astype(np.float64)
        order = np.argsort(keys)
        model = ToxicityModel(keys[order], values[order])
        scratch.drop("values")

    def bins(part):
        n = np.zeros((2, BINS + 1))
        for c, k, m in _bins(part, model).collect():
            n[c, k] = m
        return n

    n = bins(rows.filter(aside))
    if not n.sum(1).all():
        n = bins(rows)
    if not n.sum(1).all():
        return None
    center, scale, slope, shift = _curve(*n)
    return replace(model, center=center, scale=scale, slope=slope, shift=shift)


def _contrasts(rows: DataFrame, model: ToxicityModel, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of the rows, a hash of their texts and ``contrast``.

    With a table of nodes, the distinct words of all texts are joined with it,
    then each text's words with theirs; equal texts have one key, and as a
    contrast is a mean, copies don't change it.
    """
    key = [F.xxhash64("text").alias("k1"), F.hash("text").alias("k2")]
    rows = rows.select(*keep, F.coalesce("text", F.lit("")).alias("text")).select(*keep, "text", *key)
    if model.table is None:
        shared = rows.sparkSession.sparkContext.broadcast(model)

        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([*[b[c] for c in (*keep, "k1", "k2")], pa.array(shared.value.contrast(b["text"]))], [*keep, "k1", "k2", "contrast"])

        return rows.mapInArrow(tidy(run), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text") + ", contrast double")

    def spread(batches):
        for batch in batches:
            for row, number, b, s, e, _ in words(batch["text"]):
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch["k1"].take(at), batch["k2"].take(at), _texts(b, s, e).take(pa.array(number))], ["k1", "k2", "word"])

    each = rows.select("text", "k1", "k2").mapInArrow(tidy(spread), "k1 long, k2 int, word string")
    spelled = each.select("word").distinct().select("word", F.explode(_nodes_of("word")).alias("n")).select("word", "n.node")
    ratio = spelled.join(model.table, "node").groupBy("word").agg(F.sum("value").alias("r"))
    known = ratio.select("word", F.log1p(MIXED * F.expm1(F.least("r", F.lit(60.0)))).alias("value"))
    per = each.join(known, "word", "left").groupBy("k1", "k2").agg((F.coalesce(F.sum("value"), F.lit(0.0)) / F.count(F.lit(1))).alias("contrast"))
    return rows.drop("text").join(per, ["k1", "k2"], "left").withColumn("contrast", F.coalesce("contrast", F.lit(model.center)))


def _bins(rows: DataFrame, model: ToxicityModel) -> DataFrame:
    """(label, bin, count) of the contrasts."""
    found = _contrasts(rows.select("text", F.col("label").cast("int").alias("label")), model, ["label"])
    bin = F.least(F.greatest(F.round((F.asinh(F.col("contrast") / UNIT) / (2 * REACH) + 0.5) * BINS), F.lit(0)), F.lit(BINS)).cast("int")
    return found.groupBy("label", bin.alias("bin")).count().select("label", "bin", "count")


def _scored(rows: DataFrame, model: ToxicityModel, keep: list[str]) -> DataFrame:
    z = F.lit(model.slope) * F.asinh((F.col("contrast") - F.lit(model.center)) / F.lit(model.scale)) + F.lit(model.shift)
    return _contrasts(rows, model, keep).withColumn("score", 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-60.0)), F.lit(60.0)))))


def score(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """Per row: doc_id, score (probability of label 1) and predicted (1 if score >= 0.5).

    Null and empty texts, and texts without words, get the score of the middle
    of ordinary texts; without a model every score is 0.  Repeated rows give
    repeated results.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select("doc_id", "text")
    if model is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    if model.table is not None:
        return _scored(rows, model, ["doc_id"]).select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            s = shared.value.score(shared.value.contrast(b["text"]))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return rows.mapInArrow(tidy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def keep_ordinary(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """The rows, with all their columns, that ``score`` doesn't predict toxic."""
    prepare(docs.sparkSession)
    if model is None:
        return docs
    if model.table is not None:
        k1, k2 = free_name(docs, "k1_"), free_name(docs, "k2_")
        bad = _scored(docs.select("text"), model, []).filter("score >= 0.5").select(F.col("k1").alias(k1), F.col("k2").alias(k2)).distinct()
        bad = Scratch(docs.sparkSession, "toxic").save(bad, "texts")
        text = F.coalesce("text", F.lit(""))
        keyed = docs.withColumns({k1: F.xxhash64(text), k2: F.hash(text)})
        return join_ids(keyed, bad, [k1, k2], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(shared.value.score(shared.value.contrast(b["text"])) < 0.5))

    return docs.mapInArrow(tidy(run), docs.schema)
