"""State maps of chunks cut anywhere: they compose to what one machine counts over the whole text."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerflow.llm import counting

PARTS = ["the", "don't", "we'll", "x", "'s", "'r", "'re", "1234", "\n", "\t", " ", "  ", "é", "日本語", "--", "\xa0", "'v", "🙂", "aaaa", "<|endoftext|>"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path(counting.TOKENIZER))
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def machine():
    return counting.CountingTransducer()


def texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("long, looks", [(2048, (16, 32, 64)), (7, (1, 3, 5)), (13, (2,)), (1, (1,))])
def test_counts_do_not_depend_on_where_chunks_are_cut(monkeypatch, library, machine, long, looks):
    monkeypatch.setattr(counting, "LONG", long)
    monkeypatch.setattr(counting, "LOOKS", looks)
    machine.clear()
    some = texts(long, 400)
    assert machine.counts(some).tolist() == [library(t) for t in some]


@pytest.mark.parametrize("text", ["-" * 9000, " " * 9000, "\n" * 9000 + " a", "".join(random.Random(3).choice("etaoinshrdlu") for _ in range(9000)), "".join(chr(random.Random(4).randint(0x4E00, 0x4EFF) + i % 5000) for i in range(9000)), "a\n b" * 3000])
def test_long_texts_without_spaces_are_counted_by_composition(library, machine, text):
    machine.clear()
    assert machine.composed(text) == library(text)
    assert machine.counts([text, None, "", text + " <|endoftext|>"]).tolist() == [library(text), 0, 0, library(text + " <|endoftext|>")]


def test_an_entry_state_that_no_guess_has_is_added(monkeypatch, machine):
    monkeypatch.setattr(counting, "LONG", 8)
    monkeypatch.setattr(counting, "LOOKS", (1,))
    text = "".join(random.Random(5).choice("etaoinshrdlu") for _ in range(500))
    assert machine.composed(text) == machine.text(text)


def test_long_chunks_are_not_kept(machine):
    machine.clear()
    machine.counts(["a " + "b" * 5000 + " c"])
    assert max(map(len, machine.chunks)) <= counting.LONG
