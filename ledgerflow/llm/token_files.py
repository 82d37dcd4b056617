"""Token-id files: documents in ascending order of doc_id, encoded by a range asymmetric numeral system.

A table of files has a row for each segment: a run of documents with one shared
frequency table and independent blocks.  ``part`` and ``segment`` give the order;
segments are encoded and decoded by as many tasks as there are.
"""

from __future__ import annotations

import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rans
from .jobs import Scratch, prepare
from .tokens import encoder

TOKENIZER = "byte_bpe_50k.json"
END = 0
SEGMENT_TOKENS = 1 << 21

COLUMNS = "part int, segment int, first long, doc_ids array<{key}>, sizes array<long>, n long, symbols binary, freqs binary, blocks int, rows int, states binary, places binary, words binary, crcs array<long>"


def _row(part: int, segment: int, first: int, ids: list, sizes: list[int], held: list[np.ndarray], key: pa.DataType, names: list[str]) -> pa.RecordBatch:
    s = rans.encode(np.concatenate(held))
    one = lambda v, t: pa.array([v], t)
    return pa.RecordBatch.from_arrays(
        [
            one(part, pa.int32()), one(segment, pa.int32()), one(first, pa.int64()), one(ids, pa.list_(key)), one(sizes, pa.list_(pa.int64())), one(s.n, pa.int64()),
            one(s.symbols, pa.binary()), one(s.freqs, pa.binary()), one(s.blocks, pa.int32()), one(s.rows, pa.int32()), one(s.states, pa.binary()), one(s.places, pa.binary()), one(s.words, pa.binary()),
            one(s.crcs, pa.list_(pa.int64())),
        ],
        names=names,
    )


def encode_documents(docs: DataFrame, name: str = TOKENIZER) -> DataFrame:
    """The segments of (doc_id, text): each text's ids and an end id.

    A null text has the end id alone.  Null doc_ids come first; rows with the
    same doc_id stand in the order of their texts.  Other columns are ignored.
    The range partitions are cut at doc_ids, so a doc_id that many rows share
    makes one long partition, but never more than a segment is held at once.
    """
    spark = docs.sparkSession
    prepare(spark)
    key = docs.schema["doc_id"].dataType.simpleString()
    schema = COLUMNS.format(key=key)
    names = [c.split(" ")[0] for c in schema.split(", ")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        e, part = encoder(name), TaskContext.get().partitionId()
        ids, sizes, held, total, first, segment = [], [], [], 0, 0, 0
        for b in batches:
            kind, keys = b.schema.field("doc_id").type, iter(b["doc_id"].to_pylist())
            for tokens, lengths in e.encode_column(b["text"]):
                ids.extend(islice(keys, len(lengths)))
                sizes.extend((lengths + 1).tolist())
                held.append(np.insert(tokens, np.cumsum(lengths), END))
                total += len(held[-1])
                if total >= SEGMENT_TOKENS:
                    yield _row(part, segment, first, ids, sizes, held, kind, names)
                    first, segment, ids, sizes, held, total = first + total, segment + 1, [], [], [], 0
        if held:
            yield _row(part, segment, first, ids, sizes, held, kind, names)

    return rows.mapInArrow(run, schema)


def decode_documents(files: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 and ids are read back and checked.

    ``start`` counts the ids of all documents before it; it needs one number for
    each part, which the driver adds up.
    """
    spark = files.sparkSession
    prepare(spark)
    sizes = sorted((r["part"], r["n"]) for r in files.groupBy("part").agg(F.sum("n").alias("n")).collect())
    before, at = [], 0
    for part, n in sizes:
        before.append((part, at))
        at += n
    firsts = F.broadcast(spark.createDataFrame(before, "part int, before long"))
    key = files.schema["doc_ids"].dataType.elementType.simpleString()
    names = files.columns

    def run(batches):
        for b in batches:
            for i in range(len(b)):
                r = {c: b[c][i] for c in names}
                s = rans.Segment(*(r[c].as_py() for c in ("n", "symbols", "freqs", "blocks", "rows", "states", "places", "words", "crcs")))
                tokens = rans.decode(s)
                sizes = np.array(r["sizes"].as_py(), np.int64)
                ends = np.cumsum(sizes)
                wide = tokens.astype("<u4")
                crc = [zlib.crc32(wide[e - n : e].tobytes()) for e, n in zip(ends.tolist(), sizes.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sizes), r["part"].as_py(), np.int32)), r["doc_ids"].values, pa.array(ends - sizes + r["first"].as_py()), pa.array(sizes), pa.array(crc, pa.int64())], ["part", "doc_id", "start", "n_tokens", "ids_crc32"])

    rows = files.mapInArrow(run, f"part int, doc_id {key}, start long, n_tokens long, ids_crc32 long")
    return rows.join(firsts, "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def write_and_read(docs: DataFrame, name: str = TOKENIZER) -> DataFrame:
    """Write the files in the shared folder and read every document back from them."""
    files = Scratch(docs.sparkSession, "token-files").save(encode_documents(docs, name), "files")
    return decode_documents(files)
