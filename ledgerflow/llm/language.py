"""Language identification: averaged hashed subword embeddings and a linear softmax, with calibrated rejection.

The byte n-grams of a text of the lengths GRAMS, spaces standing for the edges of
words, are hashed to buckets, looked up in an embedding table and averaged; a
linear softmax over the average gives a probability for each language and one
for none of them.  Texts of no language are made for training: every MADE-th row
once more with its letters exchanged for others.  Embeddings and softmax are trained
by stochastic gradient descent in numpy.

A part of the training rows is kept aside.  It sets a temperature, so that the
probability of the best language can be read as the confidence that it is right,
and the confidence under which a prediction is rejected (``threshold``).
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .grams import histories, sums
from .jobs import prepare, tidy, trim

BITS = 14
BUCKETS = 1 << BITS
GRAMS = (2, 3, 4)
TRAIN_ROWS = 2048
PRECISION = 0.99
LOST = 0.005
MADE = 3
UNKNOWN = "und"

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32


def buckets_of(parts: list[np.ndarray]) -> np.ndarray:
    """The buckets of the n-grams of all GRAMS that end at each byte, one row for each length."""
    out, code = [], np.zeros(len(parts[0]), np.uint32)
    for n, p in enumerate(parts, 1):
        code = (code ^ p) * np.uint32(16777619) + np.uint32(n)
        if n in GRAMS:
            out.append((code * np.uint32(2654435761)) >> np.uint32(32 - BITS))
    return np.stack(out)


@dataclass
class LanguageModel:
    """The product of embeddings and softmax weights by bucket, the bias, and the calibration; the last column is none of the names."""

    names: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, column: pa.Array) -> np.ndarray:
        out, n = np.zeros((len(column), len(self.names) + 1)), np.zeros(len(column))
        for first, last, lengths, parts in histories(column, _FOLD, max(GRAMS)):
            for codes in buckets_of(parts):
                out[first:last] += sums(self.weights[codes], lengths)
            n[first:last] += len(GRAMS) * lengths
        return out / np.maximum(n, 1)[:, None] + self.bias

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The best language of each text and the confidence that it is right."""
        p = softmax(self.logits(column) / self.temperature)[:, : len(self.names)]
        return p.argmax(1), p.max(1)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _limited(step: np.ndarray, most: float) -> np.ndarray:
    """The step, shortened to a norm of at most ``most``, so that training can't run away."""
    size = float(np.sqrt((step.astype(np.float64) ** 2).sum()))
    return step * np.float32(most / size) if size > most else step


def exchanged(text: str) -> str:
    """The text with its letters exchanged for others, by an order that the text decides; words keep their lengths."""
    rng = np.random.default_rng(zlib.crc32(text.encode()))
    low, high = rng.permutation(26), rng.permutation(31)
    table = {97 + i: 97 + int(k) for i, k in enumerate(low)} | {224 + i: 224 + int(k) for i, k in enumerate(high)}
    table |= {k - 32: v - 32 for k, v in table.items() if k != 247 and v != 247}
    turn = int(rng.integers(1, 128))
    table |= {c: chr(ord(c) ^ turn) for c in set(text) if "\u0100" <= c < "\ud780" or c >= "\U00010000"}
    return text.translate({ord(k) if isinstance(k, str) else k: v for k, v in table.items()})


def _counts(batches):
    """Rows of (lang, made, at, n): the buckets of a text and its counts there, packed; every MADE-th text once more with its letters exchanged."""
    for b in batches:
        texts, names = b["text"].to_pylist(), b["lang"].to_pylist()
        other = [i for i, t in enumerate(texts) if zlib.crc32(t.encode()) % MADE == 0]
        for made, some in ((False, list(range(len(texts)))), (True, other)):
            column = pa.array([exchanged(texts[i]) if made else texts[i] for i in some], pa.string())
            at, n = [b""] * len(some), [b""] * len(some)
            count, of = np.zeros(BUCKETS, np.int64), -1
            for first, last, lengths, parts in histories(column, _FOLD, max(GRAMS)):
                ends, codes = np.cumsum(lengths), buckets_of(parts).astype(np.int64)
                for r in range(last - first):
                    if first + r != of:
                        count, of = np.zeros(BUCKETS, np.int64), first + r
                    for c in codes:
                        count += np.bincount(c[ends[r] - lengths[r] : ends[r]], minlength=BUCKETS)
                    x = np.flatnonzero(count)
                    at[of], n[of] = x.astype("<u2").tobytes(), count[x].astype("<f4").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in some], pa.string()), pa.array([made] * len(some), pa.bool_()), *[pa.array(p, pa.binary()) for p in (at, n)]], ["lang", "made", "at", "n"])


def quotas(sizes: dict[str, int], train_rows: int) -> dict[str, int]:
    """Rows to take of each language, at most ``train_rows`` together: a small floor for each, the rest in proportion."""
    if sum(sizes.values()) <= train_rows:
        return dict(sizes)
    floor = max(1, train_rows // (4 * len(sizes)))
    least = {k: min(n, floor) for k, n in sizes.items()}
    more, left = train_rows - sum(least.values()), sum(sizes.values()) - sum(least.values())
    return {k: least[k] + more * (n - least[k]) // left for k, n in sizes.items()}


def training_rows(docs: DataFrame, train_rows: int) -> DataFrame:
    """At most ``train_rows`` distinct rows (lang, text) of (doc_id, text, lang), whatever the ids.

    Of each language those with the lowest hashes of doc_id and text are taken,
    exact repeats counting once.  Only hashes are compared and shuffled; a bound
    on the hash, which nearly always leaves enough, keeps the ordered rows few.
    Beyond ``train_rows`` languages the most frequent are trained.
    """
    spark = docs.sparkSession
    h = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text")
    known = docs.filter("lang is not null and text is not null and text <> ''").select("lang", "text", h.alias("h"))
    hashes = known.select("lang", "h").distinct()
    sizes = {r["lang"]: r["n"] for r in hashes.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(train_rows).collect()}
    takes = quotas(sizes, train_rows)
    limits = []
    for k, n in sizes.items():
        share = min(1.0, (takes[k] + 8 * takes[k] ** 0.5 + 16) / n)
        limits.append((k, takes[k], 2**63 - 1 if share == 1 else int(share * 2.0**64) - 2**63))
    few = hashes.join(F.broadcast(spark.createDataFrame(limits, "lang string, take int, upto long")), "lang").filter("h <= upto")
    order = Window.partitionBy("lang").orderBy("h")
    keys = few.withColumn("rank", F.row_number().over(order)).filter("rank <= take").select("lang", "h").collect()
    chosen = F.broadcast(spark.createDataFrame([tuple(k) for k in keys], "lang string, h long"))
    return known.join(chosen, ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "text")


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS, dim: int = 16, steps: int = 900, seed: int = 7) -> LanguageModel | None:
    """Train on at most ``train_rows`` rows of (doc_id, text, lang), as ``training_rows`` chooses them.

    The sample is the documented bound of what reaches the driver: a sparse row
    of at most BUCKETS counts, six bytes each, for each chosen document, and one
    more with letters exchanged for every MADE-th.  None if no row has a language
    and a text.
    """
    prepare(docs.sparkSession)
    got = training_rows(docs, train_rows).mapInArrow(tidy(_counts), "lang string, made boolean, at binary, n binary").toArrow()
    rows = sorted(zip(*[got[c].to_pylist() for c in ("made", "lang", "at", "n")]))
    del got
    if not rows:
        return None
    real = sum(not r[0] for r in rows)
    names = sorted({r[1] for r in rows})
    rng = np.random.default_rng(seed)
    y = np.array([len(names) if r[0] else names.index(r[1]) for r in rows])
    at = [np.frombuffer(r[2], "<u2") for r in rows]
    x = [(v := np.frombuffer(r[3], "<f4")) / max(v.sum(), 1) for r in rows]
    orders = [rng.permutation(real), real + rng.permutation(len(rows) - real)]
    kept_out = [max(1, len(o) // 5) if real >= 20 else 0 for o in orders]
    train = np.concatenate([o[k:] for o, k in zip(orders, kept_out)])
    aside = np.concatenate([o[:k] if real >= 20 else o for o, k in zip(orders, kept_out)])

    def dense(some):
        m = np.zeros((len(some), BUCKETS), np.float32)
        for i, k in enumerate(some):
            m[i, at[k]] = x[k]
        return m

    e = rng.normal(0, 0.1, (BUCKETS, dim)).astype(np.float32)
    w = np.zeros((dim, len(names) + 1), np.float32)
    b = np.zeros(len(names) + 1, np.float32)
    share = np.bincount(y[train], minlength=len(names) + 1)
    weight = (len(train) / ((len(names) + 1) * np.maximum(share, 1)))[y]
    batch = min(64, len(train))
    for step in range(steps):
        some = rng.choice(train, batch, replace=False)
        d, rate = dense(some), 1.0 - step / steps
        hidden = d @ e
        g = softmax(hidden @ w + b)
        g[np.arange(batch), y[some]] -= 1
        g *= weight[some, None] / batch
        e_grad = d.T @ (g @ w.T)
        w -= _limited(40 * rate * (hidden.T @ g), 1.0)
        b -= 0.2 * rate * g.sum(0)
        e -= _limited(400 * rate * e_grad, 4.0)
    weights, bias = (e @ w).astype(np.float32), b.astype(np.float64)
    del e, d, e_grad
    z = np.vstack([dense(aside[i : i + 256]) @ weights for i in range(0, len(aside), 256)]) + bias
    grid = [2.0**k for k in np.arange(-4, 4.01, 0.25)]
    loss = [-np.log(np.maximum(softmax(z / t)[np.arange(len(aside)), y[aside]], 1e-12)).mean() for t in grid]
    temperature = grid[int(np.argmin(loss))]
    p = softmax(z / temperature)[:, : len(names)]
    del rows, at, x
    trim()
    return LanguageModel(names, weights, bias, temperature, threshold(p.max(1), p.argmax(1) == y[aside], aside < real))


def threshold(confidence: np.ndarray, right: np.ndarray, real: np.ndarray) -> float:
    """The confidence under which a prediction is rejected, from rows kept aside.

    One half, as a calibrated prediction below it is likelier wrong than right;
    less if more than a share LOST of the real rows guessed right lie below it,
    but then not less than is needed for a share PRECISION of the kept rows,
    real and made, to be right.
    """
    if not (real & right).any():
        return 0.5
    most = float(np.quantile(confidence[real & right], LOST, method="lower"))
    order = np.argsort(-confidence, kind="stable")
    precise = np.cumsum(right[order]) >= PRECISION * np.arange(1, len(order) + 1)
    last = np.append(confidence[order][:-1] != confidence[order][1:], True)
    fine = np.flatnonzero(precise & last)
    return min(0.5, max(most, float(confidence[order][fine[-1]]) if len(fine) else 0.0))


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """Per row: doc_id, lang_pred, score (calibrated probability) and rejected.

    A null text, or one without a letter, is ``und`` with score 0 and rejected;
    so is every text if the model is None.  A prediction whose calibrated
    probability is under the model's threshold keeps its language and is marked
    rejected.  Repeated rows give repeated results; other columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select("doc_id", F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        names = np.array(m.names, dtype=object)
        for b in batches:
            best, score = m.predict(b["text"])
            none = b["text"].is_null().to_numpy(zero_copy_only=False)
            lang, score = np.where(none, UNKNOWN, names[best]), np.where(none, 0.0, score)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(lang, pa.string()), pa.array(score), pa.array(none | (score < m.threshold))], ["doc_id", "lang_pred", "score", "rejected"])

    return rows.mapInArrow(tidy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """The rows, with all their columns, that ``identify`` doesn't reject."""
    prepare(docs.sparkSession)
    if model is None:
        return docs.limit(0)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            _, score = shared.value.predict(b["text"])
            letters = pc.fill_null(pc.match_substring_regex(b["text"], r"\p{L}"), False)
            yield b.filter(pc.and_(letters, pa.array(score >= shared.value.threshold)))

    return docs.mapInArrow(tidy(run), docs.schema)
