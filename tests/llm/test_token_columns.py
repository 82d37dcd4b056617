"""Ids of whole columns of texts, cut at pre-tokens, against the tokenizers library."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from ledgerflow.llm import token_files, tokens

from .test_llm import ODD

PARTS = ["a", "Bc", "s", "t", "re", " ", " ", "\n", "\n", "\t", "\r", "'", "'", "1", "23", ".", ",", "<", "|", "<|endoftext|>", "|>", "é", "×", "÷", "ÿ", "ɏ", "ɐ", "Ж", "你"]
PARTS += [chr(c) for c in (0, 11, 12, 28, 31, 127, 0x85, 0xA0, 0xAA, 0xB2, 0xBD, 0x301, 0x663, 0x1100, 0x1680, 0x180E, 0x2003, 0x200B, 0x2014, 0x2028, 0x3000, 0xFEFF, 0x1F600)]


@pytest.fixture()
def fresh():
    return tokens.PieceEncoder("byte_bpe_50k.json")


def by_text(e, texts, kind=pa.string()):
    out = []
    for ids, sizes in e.encode_column(pa.array(["skipped", *texts], kind).slice(1)):
        out += [part.tolist() for part in np.split(ids, np.cumsum(sizes)[:-1])]
    return out


def library(e, texts):
    return [e.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_columns_have_the_librarys_ids(fresh, kind):
    rng = random.Random(3)
    texts = [*ODD, None, "", *("".join(rng.choices(PARTS, k=rng.randint(1, 14))) for _ in range(20000))]
    assert by_text(fresh, texts, kind) == library(fresh, texts)
    assert by_text(fresh, [None, "", None]) == [[], [], []] and by_text(fresh, []) == []


def test_words_are_remembered_without_their_stops_and_lines(fresh):
    text = "one two one, two.\none. two\none two,\ntwo. one***"
    assert by_text(fresh, [text]) == library(fresh, [text])
    assert set(fresh.index) == {b"one", b"two", b" one", b" two", b",", b".", b"\n", b"***"}


def test_blocks_and_a_full_memo_change_nothing(fresh, monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK", 64)
    monkeypatch.setattr(tokens, "PIECES", 20)
    monkeypatch.setattr(tokens, "LONG", 5)
    rng = random.Random(4)
    texts = [None, "x" * 500, *("".join(rng.choices(PARTS, k=rng.randint(0, 60))) for _ in range(300)), "", None]
    assert by_text(fresh, texts) == library(fresh, texts)
    assert len(fresh.start) < 300 and max(map(len, fresh.index)) <= 5


def test_long_runs_take_linear_time(fresh):
    texts = ["ab" * 3000 + "\x00", "é" * 3000 + "你", "-" * 3000 + "\x0b", "1" * 3000 + "ª", " " * 3000 + "x", "\n" * 3000, "'" * 3000 + "s", "<|" * 3000]
    assert by_text(fresh, texts) == library(fresh, texts) and not any(len(p) > tokens.LONG for p in fresh.index)


def test_files_of_many_segments(spark, monkeypatch, fresh):
    """Starts and ids go on over the segments of a part."""
    rng = random.Random(5)
    rows = [(i, None if i % 7 == 0 else "".join(rng.choices(PARTS, k=rng.randint(0, 40)))) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(token_files, "SEGMENT_TOKENS", 100)
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert token_files.encode_documents(docs).count() == 5  # one for each batch of texts
        got = sorted(map(tuple, token_files.write_and_read(docs).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    at, want = 0, []
    for (i, _), ids in zip(rows, library(fresh, [text for _, text in rows])):
        want.append((i, at, len(ids) + 1, zlib.crc32(np.array(ids + [0], "<u4").tobytes())))
        at += len(ids) + 1
    assert got == want
