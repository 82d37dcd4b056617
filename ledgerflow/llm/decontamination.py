"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Short items are searched inside long documents.  Items are partitioned by the
number of their shingles.  In a partition whose sets have at most u shingles the
containment threshold t asks for a MinHash sketch of u - ceil(t*u) + 1 smallest
hash values: a document that contains a share t of an item lacks at most
u - ceil(t*u) of its shingles, so it must contain one of those values.  Long
documents are not sketched, since a sketch of fixed size would lose a short
item; each document's shingles are looked up among the items' sketches, so the
search loses nothing.  Candidates are verified by the exact share of the item's
shingles that the document has.

Items go to the executors in one table if they are few enough, else the search
is two joins on shingles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jobs import Scratch, free_name, join_ids, prepare, tidy
from .near_duplicates import _signed
from .shingles import shingles

WIDTH = 5
BROADCAST_SHINGLES = 4_000_000


def sketch_size(n: int, num: int, den: int) -> int:
    """Of the size partition of a set of n shingles; partitions end at powers of two."""
    upper = 1 << max(0, int(n - 1).bit_length())
    return upper - -(-upper * num // den) + 1


def shingle_sets(rows: DataFrame, key: str, width: int) -> DataFrame:
    """(key, shingles) with the distinct shingles of each text, ascending."""

    def run(batches):
        for b in batches:
            s = [_signed(x) for x in shingles(b["text"], width)]
            ends = np.cumsum([0, *map(len, s)])
            yield pa.RecordBatch.from_arrays([b[key], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(s) if s else np.zeros(0, np.int64)))], [key, "shingles"])

    return rows.select(key, "text").mapInArrow(tidy(run), f"{key} {rows.schema[key].dataType.simpleString()}, shingles array<long>")


def contaminated(docs: DataFrame, items: DataFrame, num: int = 80, den: int = 100, width: int = WIDTH, most: int = BROADCAST_SHINGLES) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item) where den * n_shared >= num * n_item.

    ``docs`` has doc_id and text, ``items`` item_id and text.  n_item is the number
    of the item's distinct shingles, n_shared of those in the document.  Texts that
    are null or without words match nothing.  Items with equal texts each match;
    repeated rows of documents give repeated rows.  Other columns are ignored.
    """
    wanted, few, scratch = _items(docs, items, width, most)
    if not few:
        return _joined(docs, wanted, num, den, width, scratch)
    of_items, names = _lookup(wanted, num, den)
    shared = docs.sparkSession.sparkContext.broadcast((of_items, names))
    key, item = docs.schema["doc_id"].dataType.simpleString(), wanted.schema["item_id"].dataType.simpleString()

    def run(batches):
        of_items, names = shared.value
        for b in batches:
            doc, of, n = [], [], []
            for i, s in enumerate(shingles(b["text"], width)):
                for j, k in of_items.held(s, num, den):
                    doc.append(i)
                    of.append(j)
                    n.append(k)
            at = np.array(of, np.int64)
            yield pa.RecordBatch.from_arrays([b["doc_id"].take(pa.array(doc, pa.int64())), names.take(pa.array(at)), pa.array(n, pa.int64()), pa.array(of_items.sizes[at])], ["doc_id", "item_id", "n_shared", "n_item"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {key}, item_id {item}, n_shared long, n_item long")


def keep_clean(docs: DataFrame, items: DataFrame, num: int = 80, den: int = 100, width: int = WIDTH, most: int = BROADCAST_SHINGLES) -> DataFrame:
    """The rows, with all their columns, whose text holds no item as ``contaminated`` has it; whatever their doc_id."""
    wanted, few, scratch = _items(docs, items, width, most)
    if not few:
        key = free_name(docs, "text_key")
        of_text = F.concat_ws("-", F.xxhash64(F.coalesce("text", F.lit(""))), F.hash(F.coalesce("text", F.lit(""))))
        texts = docs.select(of_text.alias("doc_id"), "text").dropDuplicates(["doc_id"])
        found = scratch.save(_joined(texts, wanted, num, den, width, scratch).select(F.col("doc_id").alias(key)).distinct(), "found")
        return join_ids(docs.withColumn(key, of_text), found, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    shared = docs.sparkSession.sparkContext.broadcast(_lookup(wanted, num, den)[0])

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([next(shared.value.held(s, num, den), None) is None for s in shingles(b["text"], width)], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)


def _items(docs: DataFrame, items: DataFrame, width: int, most: int) -> tuple[DataFrame, bool, Scratch]:
    """The items' sets as a written table, and whether they are few enough to be broadcast."""
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "decontamination")
    wanted = scratch.save(shingle_sets(items, "item_id", width).filter(F.size("shingles") > 0), "items")
    return wanted, wanted.agg(F.coalesce(F.sum(F.size("shingles")), F.lit(0))).first()[0] <= most, scratch


class Lookup:
    """Items' sets in one array, and their sketches inverted."""

    def __init__(self, values: np.ndarray, ends: np.ndarray, num: int, den: int):
        self.values, self.ends, self.sizes = values, ends, np.diff(ends)
        parts = [values[a : a + sketch_size(b - a, num, den)] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.heads, at = np.unique(flat[order], return_index=True)
        self.starts = np.append(at, len(flat))
        self.owners = np.repeat(np.arange(len(parts)), [len(p) for p in parts])[order]

    def held(self, s: np.ndarray, num: int, den: int):
        """Yield (item, shared shingles) of the items that the set s, as unsigned values, holds; only sets of candidates are looked at."""
        if not len(s) or not len(self.heads):
            return
        s = _signed(s)
        few, many = (self.heads, s) if len(self.heads) < len(s) else (s, self.heads)
        at = np.minimum(np.searchsorted(many, few), len(many) - 1)
        hit = few[many[at] == few]
        if not len(hit):
            return
        places = np.searchsorted(self.heads, hit)
        near = np.unique(np.concatenate([self.owners[self.starts[p] : self.starts[p + 1]] for p in places.tolist()]))
        for j in near.tolist():
            own = self.values[self.ends[j] : self.ends[j + 1]]
            k = int((s[np.minimum(np.searchsorted(s, own), len(s) - 1)] == own).sum())
            if k * den >= len(own) * num:
                yield j, k


def _lookup(wanted: DataFrame, num: int, den: int) -> tuple[Lookup, pa.Array]:
    """All items' shingles, of which there are at most so many, as Arrow arrays; and their ids in whatever type."""
    got = wanted.select("item_id", "shingles").toArrow().combine_chunks()
    if not got.num_rows:
        return Lookup(np.zeros(0, np.int64), np.zeros(1, np.int64), num, den), got["item_id"].combine_chunks()
    names, sets = got["item_id"].combine_chunks(), got["shingles"].combine_chunks()
    if isinstance(sets, pa.ChunkedArray):
        names, sets = names.chunk(0), sets.chunk(0)
    ends = sets.offsets.to_numpy().astype(np.int64)
    return Lookup(sets.values.to_numpy(zero_copy_only=False)[: ends[-1]], ends, num, den), names


def _joined(docs: DataFrame, wanted: DataFrame, num: int, den: int, width: int, scratch: Scratch) -> DataFrame:
    """For very many items: shuffle joins on shingles, sketches first, all shingles for the candidates only.

    Rows of documents are told apart by a number of their own, so repeated rows stay.
    """
    numbered = scratch.save(shingle_sets(docs.select("doc_id", "text"), "doc_id", width).filter(F.size("shingles") > 0).withColumn("row", F.monotonically_increasing_id()), "documents")
    n = F.size("shingles").cast("long")
    upper = F.expr("cast(shiftleft(1L, if(size(shingles) <= 1, 0, length(bin(size(shingles) - 1)))) as long)")
    k = (upper - F.ceil(upper * num / den) + 1).cast("int")
    sketch = wanted.select("item_id", F.explode(F.slice("shingles", F.lit(1), k)).alias("s"))
    spread = numbered.select("row", F.explode("shingles").alias("s"))
    candidates = scratch.save(spread.join(sketch, "s").select("row", "item_id").distinct(), "candidates")
    whole = candidates.join(wanted.select("item_id", n.alias("n_item"), "shingles"), "item_id").withColumnRenamed("shingles", "of_item")
    both = whole.join(numbered, "row").withColumn("n_shared", F.size(F.array_intersect("of_item", "shingles")).cast("long"))
    return both.filter(F.col("n_shared") * den >= F.col("n_item") * num).select("doc_id", "item_id", "n_shared", "n_item")
