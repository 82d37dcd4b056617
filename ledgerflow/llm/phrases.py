"""Phrase collocation mining: tries of Apriori-safe candidates, walked from all text positions at once.

Texts are folded (A-Z), cut into pieces at marks and line ends, and pieces into
words; everything is counted by language.  The steps:

1. Words are counted exactly.  Words of at least ``least`` occurrences are the
   frequent ones.
2. Texts are written once more as 64-bit values of (language, word), 0 standing
   for an infrequent word and for the end of a piece.
3. For lengths 2 to ``longest`` - 1, phrases whose two parts without the last
   and without the first word may be frequent are counted in 2**BITS buckets.
   A bucket's sum bounds the count of each phrase in it, so a phrase in a bucket
   below ``least`` is out; what is left is a bitmap of fixed size.
4. Phrases that pass the bitmaps are the candidates: none that is frequent is lost.
5. Candidates are dealt by their first word to tries of at most MOST phrases.
   Each trie is a double array over halves of word codes, built with numpy in time
   about linear in its phrases, and broadcast; in each task the states of all
   positions advance together, one word at a time, and what they reach is counted.
   Spark sums the counts of all tasks.  These counts are exact.
6. Scores are whole numbers, computed in 38-digit decimals.

Nothing grows in memory but by the batch: bitmaps have a fixed size, tries a
greatest one.  Words are compared as 64-bit values of language and word.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .jobs import Scratch, prepare, tidy
from .shingles import _BYTE, _cuts, mix, powers, utf8
from .toxicity import _texts

LEAST = 100
LONGEST = 5
TOP = 2000
#: Buckets of a filter, as a power of two; a bitmap takes 8 MB.
BITS = 26
#: Phrases of one trie.
MOST = 1_000_000
#: Words that a counting task reads for each phrase of its trie, if there are enough: so the counts of all tasks are few beside the texts.
WORDS_A_PHRASE = 256

_U = np.uint64
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_STEP = _U(0x9E3779B97F4A7C15)


def words(column: pa.Array):
    """Yield (bytes, starts, ends, values, rows, pieces) of the words of each block; words of one piece share row and piece."""
    data, offsets = utf8(column)
    before = 0
    for first, last, start, end in _cuts(data, offsets):
        b = _FOLD[data[start:end]]
        if not len(b):
            continue
        kind = _KIND[b]
        inside = np.zeros(len(b) + 2, bool)
        inside[1:-1] = kind == 0
        edges = offsets[first + 1 : last] - start
        rows = edges[(edges > 0) & (edges < len(b))]
        begins = inside[1:-1] & ~inside[:-2]
        begins[rows] = inside[1 + rows]
        ends = inside[1:-1] & ~inside[2:]
        ends[rows - 1] = inside[rows]
        s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        up, down = powers(len(b))
        total = np.zeros(len(b) + 1, _U)
        np.cumsum(_BYTE[b] * up[: len(b)], out=total[1:])
        marks = np.cumsum(kind == 2)
        yield b, s, e, mix((total[e] - total[s]) * down[s] + (e - s).astype(_U)), first + np.searchsorted(edges, s, "right"), before + marks[s]
        before += int(marks[-1])


def _salts(lang: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes of the languages of rows, their names and a 64-bit value of each; null is ``und``."""
    d = lang.cast(pa.string()).fill_null("und").dictionary_encode()
    salt = [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in d.dictionary.to_pylist()]
    return d.indices.to_numpy(), d.dictionary, np.array(salt, _U)


def _keys(values: np.ndarray, salt: np.ndarray) -> np.ndarray:
    return np.maximum(mix(values ^ salt), _U(1))


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, key, a) of all words of (lang, text)."""

    def run(batches):
        for batch in batches:
            code, names, salt = _salts(batch["lang"])
            for b, s, e, v, row, _ in words(batch["text"]):
                key, at, n = np.unique(_keys(v, salt[code[row]]), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(code[row[at]])), _texts(b, s[at], e[at]), pa.array(key.view(np.int64)), pa.array(n)], ["lang", "word", "key", "a"])

    each = docs.mapInArrow(tidy(run), "lang string, word string, key long, a long")
    return each.groupBy("lang", "word", "key").agg(F.sum("a").alias("a"))


def bitmap(keys: DataFrame) -> np.ndarray:
    """The bitmap of the lowest BITS bits of the one column, a 64-bit key; 2**BITS bits whatever their number."""
    at = F.col(keys.columns[0]).bitwiseAND(F.lit((1 << BITS) - 1))
    parts = keys.select(F.shiftright(at, 15).alias("part"), at.bitwiseAND(F.lit(32767)).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    out = np.zeros(1 << (BITS - 3), np.uint8)
    for r in parts:
        out[r.part * 4096 : (r.part + 1) * 4096] = np.frombuffer(bytes(r.bits), np.uint8)[: max(0, len(out) - r.part * 4096)]
    return out


def has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & _U((1 << BITS) - 1)
    return (bits[(at >> _U(3)).astype(np.int64)] >> (at & _U(7)).astype(np.uint8)) & 1 == 1


def encoded(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(words): each text as keys of its words, one 0 for infrequent words and ends of pieces."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        bits = shared.value
        for batch in batches:
            code, _, salt = _salts(batch["lang"])
            parts = [(_keys(v, salt[code[row]]), row, piece) for _, _, _, v, row, piece in words(batch["text"])]
            key, row, piece = (np.concatenate(x) for x in zip(*parts)) if parts else ([], [], [])
            if not len(key):
                continue
            key = np.where(has(bits, key), key, _U(0))
            new = np.zeros(len(key), bool)
            new[1:] = (row[1:] != row[:-1]) | (piece[1:] != piece[:-1])
            at = np.arange(len(key)) + np.cumsum(new)
            out, of = np.zeros(len(key) + int(new.sum()), _U), np.zeros(len(key) + int(new.sum()), np.int64)
            out[at], of[at] = key, row
            of[at[new] - 1] = row[new]
            some = np.concatenate([[True], (out[1:] != 0) | (out[:-1] != 0)])
            out, of = out[some], of[some]
            ends = np.append(np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])), len(out))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out.view(np.int64)))], ["words"])

    return docs.mapInArrow(tidy(run), "words array<long>")


def positions(v: np.ndarray, filters: list[np.ndarray], longest: int):
    """Yield (k, starts, hashes) of the phrases of k words, 2 to ``longest``, whose parts of k - 1 words passed their filters, and that pass their own."""
    at = np.flatnonzero(v)
    h = v[at]
    for k in range(2, longest + 1):
        both = np.flatnonzero(at[1:] == at[:-1] + 1)
        at = at[both]
        h = mix(h[both] * _STEP + v[at + k - 1])
        if k - 2 < len(filters):
            some = has(filters[k - 2], h)
            at, h = at[some], h[some]
        yield k, at, h


def _flat(batch: pa.RecordBatch) -> np.ndarray:
    """All words of a batch, with a 0 between rows."""
    got = batch["words"]
    flat, sizes = got.flatten().to_numpy(zero_copy_only=False).view(_U), np.diff(got.offsets.to_numpy())
    out = np.zeros(len(flat) + len(sizes), _U)
    out[np.arange(len(flat)) + np.repeat(np.arange(len(sizes)), sizes)] = flat
    return out


def next_filter(texts: DataFrame, filters: list[np.ndarray], least: int) -> np.ndarray:
    """The bitmap of buckets of phrases one word longer than the last filter's that hold at least ``least`` of them."""
    shared, k = texts.sparkSession.sparkContext.broadcast(filters), len(filters) + 2

    def run(batches):
        for batch in batches:
            for n, _, h in positions(_flat(batch), shared.value, k):
                if n == k and len(h):
                    bucket, c = np.unique(h & _U((1 << BITS) - 1), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(c.astype(np.int32))], ["bucket", "n"])

    counts = texts.mapInArrow(tidy(run), "bucket int, n int").groupBy("bucket").agg(F.sum("n").alias("n"))
    return bitmap(counts.filter(F.col("n") >= least).select(F.col("bucket").cast("long")))


def candidates(texts: DataFrame, filters: list[np.ndarray], longest: int) -> DataFrame:
    """(words) of all phrases that pass the filters, each once."""
    shared = texts.sparkSession.sparkContext.broadcast(filters)

    def run(batches):
        for batch in batches:
            v = _flat(batch)
            for k, at, h in positions(v, shared.value, longest):
                first = at[np.unique(h, return_index=True)[1]]
                if len(first):
                    flat = v[first[:, None] + np.arange(k)].view(np.int64).ravel()
                    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, k), pa.int32()), pa.array(flat))], ["words"])

    return texts.mapInArrow(tidy(run), "words array<long>").distinct()


@dataclass
class DoubleArray:
    """A trie: from state s, symbol c leads to t = base[s] + c if check[t] is s.  ``row`` is the phrase of a state, -1 without.

    A word is two symbols, the halves of its code; so a state has at most as many
    children as half a code can tell, close together, and the arrays stay about as
    long as there are states.  Common words have the low codes.
    """

    alphabet: np.ndarray
    code: np.ndarray
    base: np.ndarray
    check: np.ndarray
    row: np.ndarray
    start: np.ndarray
    depth: int
    bits: int

    def codes(self, v: np.ndarray) -> np.ndarray:
        """From 1; 0 for a word in no phrase."""
        at = np.minimum(np.searchsorted(self.alphabet, v), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == v, self.code[at], np.int32(0))

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The next states; -1 where there is none."""
        t = self.base[state] + symbol
        return np.where(self.check[t] == state, t, np.int32(-1))

    def reached(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states of two words and more that are reached and how often, from all positions at once, level by level."""
        code = self.codes(v)
        high, low = _symbols(code, self.bits)
        state = self.start[code]
        at = np.flatnonzero(state >= 0)
        state, seen = state[at], []
        for k in range(1, self.depth):
            inside = at + k < len(v)
            at, state = at[inside], state[inside]
            for half in (high, low):
                state = self.step(state, half[at + k])
                live = state >= 0
                at, state = at[live], state[live]
            if not len(at):
                break
            seen.append(state)
        return np.unique(np.concatenate(seen), return_counts=True) if seen else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def counts(self, v: np.ndarray) -> np.ndarray:
        """How often each state is reached."""
        total = np.zeros(len(self.check), np.int64)
        state, n = self.reached(v)
        total[state] = n
        return total


def _symbols(code: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of word codes, from 1; the second half of code 0, which no phrase has, leads nowhere."""
    return (code >> bits) + 1, (code & ((1 << bits) - 1)) + 1


def double_array(phrases: list[np.ndarray]) -> DoubleArray:
    """The trie of phrases (arrays of words by length 2, 3, ...); beginnings of phrases need not be phrases.

    States get their places level by level.  Of a level's sets of children the
    large ones come first; each is laid where its first child takes a free place
    and all others find one, the search going on where the last set of about that
    size was laid.  Only children fill the gaps.
    """
    whole = [p for p in phrases if len(p)]
    alphabet = np.unique(np.concatenate([p.ravel() for p in whole]))
    at = [np.searchsorted(alphabet, p) for p in whole]
    often = np.bincount(np.concatenate([p[:, 1:].ravel() for p in at]), minlength=len(alphabet))
    code = np.empty(len(alphabet), np.int64)
    code[np.argsort(-often, kind="stable")] = np.arange(1, len(alphabet) + 1)
    bits = -(-len(alphabet).bit_length() // 2)
    width = 1 << bits
    halves = [_symbols(code[p], bits) for p in at]
    depth = max(p.shape[1] for p in at)
    base, check = np.zeros(4 * width, np.int64), np.full(4 * width, -1, np.int64)
    check[0] = -2

    def room(more: int) -> None:
        nonlocal base, check
        base, check = np.concatenate([base, np.zeros(more, np.int64)]), np.concatenate([check, np.full(more, -1, np.int64)])

    def lay(parent: np.ndarray, child: np.ndarray) -> None:
        starts = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
        sizes = np.diff(np.append(starts, len(parent)))
        spots, at, large = np.zeros(0, np.int64), 0, None
        for g in np.argsort(-sizes, kind="stable")[: int((sizes > 1).sum())].tolist():
            s, c = parent[starts[g]], child[starts[g] : starts[g] + sizes[g]]
            if large is None or 4 * sizes[g] <= 3 * large:
                spots, at, large = np.flatnonzero(check[: len(check) - width] == -1), 0, sizes[g]
            more = c - c[0]
            tried = 16
            while True:
                some = spots[at : at + tried]
                fits = (check[some[:, None] + more] == -1).all(1) & (some >= c[0])
                if fits.any():
                    n = int(np.argmax(fits))
                    base[s] = some[n] - c[0]
                    check[some[n] + more] = s
                    at += n
                    break
                at += len(some)
                tried = min(2 * tried, 1024)
                if at >= len(spots):
                    end = len(check) - width
                    room(len(check) // 4)
                    spots, at = np.flatnonzero(check[end : len(check) - width] == -1) + end, 0
        one = np.flatnonzero(sizes == 1)
        if len(one):
            s, c = parent[starts[one]], child[starts[one]]
            spots = np.flatnonzero(check[width + 1 :] == -1) + width + 1
            if len(spots) < len(one):
                end = len(check)
                room(len(one) - len(spots))
                spots = np.concatenate([spots, np.arange(end, len(check))])
            spots = spots[: len(one)]
            base[s], check[spots] = spots - c, s

    def reached(states: list[np.ndarray], symbols: list[np.ndarray]) -> list[np.ndarray]:
        key = np.unique(np.concatenate([s * (width + 1) + c for s, c in zip(states, symbols)]))
        lay(key // (width + 1), key % (width + 1))
        return [base[s] + c for s, c in zip(states, symbols)]

    states: list[np.ndarray] = [np.zeros(len(p), np.int64) for p in at]
    for k in range(depth):
        longer = [n for n, p in enumerate(at) if p.shape[1] > k]
        for half in (0, 1):
            for n, s in zip(longer, reached([states[n] for n in longer], [halves[n][half][:, k] for n in longer])):
                states[n] = s
    room(width + 1)
    row = np.full(len(check), -1, np.int32)
    ends = np.concatenate(states)
    row[ends] = np.arange(len(ends))
    trie = DoubleArray(alphabet, code.astype(np.int32), base.astype(np.int32), check.astype(np.int32), row, np.zeros(0), depth, bits)
    high, low = _symbols(np.arange(len(alphabet) + 1, dtype=np.int32), bits)
    start = trie.step(np.zeros(len(high), np.int32), high)
    trie.start = np.where(start >= 0, trie.step(np.maximum(start, 0), low), np.int32(-1))
    trie.start[0] = -1
    return trie


def _trie(rows: DataFrame) -> tuple[DoubleArray, pa.Array] | None:
    """The trie of (words) and the phrases in the order of its rows."""
    got = rows.toArrow()["words"].combine_chunks()
    if not len(got):
        return None
    sizes = np.diff(got.offsets.to_numpy())
    order = np.argsort(sizes, kind="stable")
    got = got.take(pa.array(order))
    flat, sizes = got.flatten().to_numpy().view(_U), sizes[order]
    ends = np.cumsum(sizes)
    parts = [flat[ends[sizes == k][0] - k : ends[sizes == k][-1]].reshape(-1, k) for k in np.unique(sizes)]
    return double_array(parts), got


def phrase_counts(texts: DataFrame, chosen: DataFrame, n_words: int, scratch: Scratch, most: int) -> DataFrame:
    """(words, a): the exact number of each candidate's occurrences, by one pass over the texts for each trie."""
    n = chosen.count()
    shards = max(1, -(-n // most))
    texts = texts.coalesce(max(texts.sparkSession.sparkContext.defaultParallelism, n_words * shards // (WORDS_A_PHRASE * max(n, 1))))
    out = None
    for shard in range(shards):
        made = _trie(chosen.filter(F.pmod(F.xxhash64(F.get("words", F.lit(0))), F.lit(shards)) == shard))
        if made is None:
            continue
        shared = texts.sparkSession.sparkContext.broadcast(made)

        def run(batches, shared=shared):
            trie, names = shared.value
            total = np.zeros(len(trie.check), np.int64)
            for batch in batches:
                state, n = trie.reached(_flat(batch))
                total[state] += n
            state = np.flatnonzero((total > 0) & (trie.row >= 0))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(trie.row[state])), pa.array(total[state])], ["words", "a"])

        sums = texts.mapInArrow(tidy(run), "words array<long>, a long").groupBy("words").agg(F.sum("a").alias("a"))
        part = scratch.save(sums, f"counts{shard}")
        out = part if out is None else out.unionByName(part)
    return texts.sparkSession.createDataFrame([], "words array<long>, a long") if out is None else out


def _spelled(counted: DataFrame, known: DataFrame) -> DataFrame:
    """(lang, words, a) with the words as strings."""
    each = counted.select("a", F.col("words").alias("keys"), F.posexplode("words").alias("at", "key")).join(known.select("lang", "word", "key"), "key")
    spelled = each.groupBy("keys", "a").agg(F.min("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))
    return spelled.select("lang", F.transform("w", lambda x: x["word"]).alias("words"), "a")


def _joined(words: str | Column) -> Column:
    return F.array_join(words, " ")


def scored(phrases: DataFrame, known: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of (lang, words, a): the cut of lowest score, of equal ones the first."""
    counts = phrases.select("lang", _joined("words").alias("phrase"), "a").unionByName(known.select("lang", F.col("word").alias("phrase"), "a"))
    size = F.size("words")
    cuts = phrases.select("lang", "words", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("lang", _joined("words").alias("phrase"), "a", "k", _joined(F.slice("words", F.lit(1), F.col("k"))).alias("head"), _joined(F.slice("words", F.col("k") + 1, size - F.col("k"))).alias("rest"))
    both = cuts.join(counts.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l")), ["lang", "head"]).join(counts.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r")), ["lang", "rest"])
    both = both.join(totals, "lang").withColumn("score", F.expr("(cast(1000 * a as decimal(19,0)) * cast(n as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"))
    least = F.min(F.struct("score", "k", "l", "r")).alias("c")
    return both.groupBy("lang", "phrase", "a", "n").agg(least).select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score")


def not_inside(phrases: DataFrame, percent: int) -> DataFrame:
    """The phrases that lie in no longer one with 100 * a(longer) >= percent * a."""
    size = F.size("words")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda k: F.transform(F.sequence(F.lit(1), size - k + 1), lambda i: F.slice("words", i, k))))
    longer = phrases.filter(size > 2).select("lang", "a", F.explode(inner).alias("words")).groupBy("lang", "words").agg(F.max("a").alias("outer"))
    return phrases.join(longer, ["lang", "words"], "left").filter(F.coalesce(100 * F.col("outer") < percent * F.col("a"), F.lit(True))).drop("outer")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, percent: int = 100, top: int = TOP, most: int = MOST) -> DataFrame:
    """The first ``top`` phrases of each language by score: lang, rank, phrase, a, l, r, n, score.

    ``docs`` has text and lang.  Null texts are empty, a null lang is ``und``.
    Every row counts, repeated ones too; ties of score go to more occurrences,
    then to the lesser phrase by its bytes.  Without a frequent phrase there are
    no rows.  Other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "phrases")
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"))
    counted = scratch.save(word_counts(rows), "words")
    totals = scratch.save(counted.groupBy("lang").agg(F.sum("a").alias("n")), "totals")
    known = scratch.save(counted.filter(F.col("a") >= least), "known")
    texts = scratch.save(encoded(rows, bitmap(known.select("key"))), "texts")
    scratch.drop("words")
    filters: list[np.ndarray] = []
    for _ in range(2, longest):
        filters.append(next_filter(texts, filters, least))
    chosen = scratch.save(candidates(texts, filters, longest), "candidates")
    n_words = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    counts = phrase_counts(texts, chosen, n_words, scratch, most).filter(F.col("a") >= least)
    phrases = scratch.save(_spelled(counts, known), "phrases")
    scratch.drop("texts", "candidates")
    kept = scratch.save(not_inside(phrases, percent).select("lang", _joined("words").alias("phrase")), "kept")
    ranked = scored(phrases, known, totals).join(kept, ["lang", "phrase"], "left_semi")
    w = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    return ranked.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
