"""Quality rules on lines: cross-document line frequency by host, after simple rules on words; built-in functions only.

A line is normalised (lower case, one sign for each run of digits, no white space
around) and hashed.  For each host the number of distinct texts that hold a line
is counted: copies of one text count once, so that a document that was crawled
many times doesn't make its own lines look like boilerplate.  Lines in more
texts of the host than its limit are taken out, wherever they stand; a document
that is depleted, with too little of it left, is rejected.

The limit of a host is MOST_TEXTS, or a share of its distinct texts if that is more.

Each text is read once; what later steps need is written as numbers: a key of
the text, and the hash and length of each line.  Counting goes through partial
sums, frequent lines are broadcast only below a checked size, and else meet
their rows in salted parts, so a line that is in a third of all texts is spread.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .jobs import BROADCAST_BYTES, Scratch

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
REPEATED_PERCENT = 50
MOST_TEXTS = 20
SHARE_PERMILLE = 10
LEFT_PERCENT = 30
#: Repeated windows that are looked up one by one.
FEW = 32
SALTS = 32


def windows(words: str) -> Column:
    """A 64-bit value of each three words of the array column ``words`` that follow each other."""
    heads = F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)))
    return F.transform(heads, lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)))


def covered(values: str) -> Column:
    """How many words lie in windows that have an equal one.

    Texts without such windows cost a set of numbers.  If up to FEW values repeat,
    each window is looked up among them; else values are sorted with their places.
    """
    repeated = _let(F.sort_array(values), lambda s: F.array_distinct(F.filter(s, lambda x, k: F.get(s, k - 1) == x)))

    def among(few: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(values) - 1), lambda i: F.array_contains(few, F.get(values, i)))

    def adjacent(s: Column) -> Column:
        return F.sort_array(F.transform(F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])), lambda x: x["i"]))

    def reach(places: Column) -> Column:
        return F.aggregate(F.transform(places, lambda x, k: F.coalesce(F.least(F.get(places, k + 1) - x, F.lit(3)), F.lit(3))), F.lit(0), lambda a, x: a + x)

    placed = F.sort_array(F.transform(values, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    some = _let(repeated, lambda r: _let(F.when(F.size(r) <= FEW, among(r)).otherwise(_let(placed, adjacent)), reach))
    return F.when(F.size(F.array_distinct(values)) == F.size(values), F.lit(0)).otherwise(some)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def normal_lines(text: Column) -> Column:
    """The lines of a text that have a word, in lower case, each run of digits a 0, without white space around."""
    lines = F.split(F.regexp_replace(F.lower(text), "[0-9]+", "0"), "\n")
    return F.filter(F.transform(lines, lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r"))), lambda x: x != "")


def measured(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, a key of host and text (host, k1, k2), the hashes of lines with their lengths, and the base figures of each row."""
    rows = docs.select("doc_id", F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select(
        "doc_id", "host", "text", normal_lines(F.col("text")).alias("lines"), F.filter(F.split("text", SPACE), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("exact"),
    ).withColumn("windows", windows("words"))
    return rows.select(
        "doc_id", "host", F.xxhash64("text").alias("k1"), F.hash("text").alias("k2"),
        F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("h"), F.length(x).alias("n"))).alias("lines"),
        F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("exact") - F.size(F.array_distinct("exact"))).cast("long").alias("n_dup_lines"), covered("windows").cast("long").alias("n_repeat_words"),
    )


def frequent_lines(texts: DataFrame, most: int, permille: int) -> DataFrame:
    """(host, line) of lines in more distinct texts of the host than its limit; ``texts`` has each text of a host once."""
    limits = texts.groupBy("host").agg(F.greatest(F.lit(most), F.floor(F.count(F.lit(1)) * permille / 1000)).alias("limit"))
    counts = texts.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)
    return counts.join(limits, "host").filter(F.col("n") > F.col("limit")).select("host", "line")


def _meet(lines: DataFrame, frequent: DataFrame, most: int) -> DataFrame:
    """Rows of lines that are frequent: by a broadcast if that is small, else joined in parts salted by text."""
    bytes_of = frequent.agg(F.coalesce(F.sum(F.octet_length("host") + 72), F.lit(0))).first()[0]
    if bytes_of <= most:
        return lines.join(F.broadcast(frequent), ["host", "line"])
    salted = frequent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return lines.withColumn("salt", F.pmod("k1", F.lit(SALTS)).cast("int")).join(salted.hint("merge"), ["host", "line", "salt"])


def judge(docs: DataFrame, host: str = "source", most: int = MOST_TEXTS, permille: int = SHARE_PERMILLE, left_percent: int = LEFT_PERCENT, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per row: doc_id, the base figures, base_failed, line_chars, gone_chars and kept.

    A document fails the base rules with under 50 words, or with over half of its
    words in 3-word windows that it repeats.  It is depleted if under
    ``left_percent`` per cent of the characters of its lines (line_chars) are in
    lines that stay (the others make gone_chars).  ``kept`` is
    neither.  A null text is empty and fails; a null host is a host of its own
    (the empty name); repeated rows give repeated rows and count as one text, as
    do rows of one host with equal texts and any doc_id.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    rows = scratch.save(measured(docs, host), "rows")
    key = ["host", "k1", "k2"]
    texts = rows.filter(F.size("lines") > 0).select(*key, "lines").dropDuplicates(key)
    texts = scratch.save(texts, "texts")
    frequent = scratch.save(frequent_lines(texts, most, permille), "frequent")
    lines = texts.select(*key, F.explode("lines").alias("x")).select(*key, F.col("x.h").alias("line"), F.col("x.n").alias("chars"))
    gone = _meet(lines, frequent, broadcast_bytes).groupBy(*key).agg(F.sum("chars").cast("long").alias("gone"))
    out = rows.withColumn("chars", F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["n"])).drop("lines").join(gone.hint("merge"), key, "left")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    gone = F.coalesce("gone", F.lit(0).cast("long"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), F.col("chars").alias("line_chars"), gone.alias("gone_chars"),
        (~failed & (100 * (F.col("chars") - gone) >= left_percent * F.col("chars"))).alias("kept"),
    )
