"""Token counts by a compiled finite-state transducer.

Two deterministic machines read a text.  The border machine follows character
classes and says where a pre-token ends; its table is compiled once from the
tokenizer's rule.  The merge machine reads the bytes of a pre-token; every
transition carries the number of tokens that it adds to the count (it may be
negative, when a byte makes earlier tokens merge).

The merge machine rests on a property of byte-pair encoding: a sequence of
tokens is the encoding of its text exactly if every two neighbours are the
encoding of theirs.  Hence the last token of each prefix follows from the last
tokens of shorter prefixes, and what can still matter is finite: the suffixes
that begin some token, each with the token before it and its count.  States and
transitions are compiled when first reached and kept.

A text is cut into chunks before spaces that follow a character other than
white space.  There both machines are in their first state whatever came before,
so a chunk's state map is constant, a count; the maps of a batch's chunks compose
by a prefix sum, from which each text takes its part.

A chunk of over LONG characters, as in texts without spaces, is cut again every
LONG characters, wherever that is.  Maps of such chunks depend on the entry state
(border state, merge state, and the last character, which a border can still
precede).  A map is made for the entry states in which the machines end that
start shortly before the cut; nearly always the true one is among them.  Maps
compose in pairs, pairs of pairs and so on; should the true entry state be
missing in a map, it is added there when the composition asks for it.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jobs import prepare
from .tokens import _byte_letters

TOKENIZER = "byte_bpe_50k.json"
STATES = 250_000
CHUNKS = 800_000
LONG = 2048
#: How many characters before a cut the machines start that guess the entry states.
LOOKS = (16, 32, 64)
#: Border state, merge state, and the character that neither machine has left behind.
START = ("begin", 0, "")
_SINGLE = re.compile(r"(?<=\S)(?= )")


def _compile_borders() -> dict[tuple[str, str], tuple[str, bool, bool]]:
    """(state, class) -> (next state, cut before the previous character, cut before this one).

    States: begin; space (one space, or the last of several); white (a run whose
    last character is not a space); L, N, O (runs); quote, quote+r/v/l, done
    (a contraction).  Classes: the six, and for letters of contractions the letter.
    """
    run = {"L": "L", "N": "N", "O": "O", "'": "O"} | {c: "L" for c in "stmdrvel"}
    table = {}
    for c in [*run, " ", "w"]:
        fresh = "space" if c == " " else "white" if c == "w" else "quote" if c == "'" else run[c]
        table["begin", c] = (fresh, False, False)
        for s in ("L", "N", "O", "done"):
            table[s, c] = (s, False, False) if run.get(c) == s else (fresh, False, True)
        if c in run:
            table["space", c] = (run[c], False, False)
            table["white", c] = (fresh, False, True)
            table["spaces", c] = (run[c], True, False)
            table["whites", c] = (fresh, True, True)
        else:
            for s in ("space", "white", "spaces", "whites"):
                table[s, c] = ("spaces" if c == " " else "whites", False, False)
        table["quote", c] = ("O", False, False) if run.get(c) == "O" else ("done", False, False) if c in "stmd" else (f"quote{c}", False, False) if c in "rvl" else (fresh, False, True)
        for first, second in (("r", "e"), ("v", "e"), ("l", "l")):
            table[f"quote{first}", c] = ("done", False, False) if c == second else ("L", True, False) if run.get(c) == "L" else (fresh, True, True)
    return table


BORDERS = _compile_borders()


def _kind(c: str) -> str:
    if c in " 'stmdrvel":
        return c
    if c in "\t\n\x0b\x0c\r\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" or "\u2000" <= c <= "\u200a":
        return "w"
    return {"L": "L", "N": "N"}.get(unicodedata.category(c)[0], "O")


class CountingTransducer:
    def __init__(self, name: str = TOKENIZER):
        with open(public_tokenizers.path(name), encoding="utf-8") as f:
            spec = json.load(f)
        plain = {v: k for k, v in _byte_letters().items()}
        raw = lambda t: bytes(plain[c] for c in t)
        self.special = sorted((t["content"] for t in spec["added_tokens"] if t["special"]), key=len, reverse=True)
        self.rank = {}
        for i, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank.setdefault((raw(a), raw(b)), i)
        tokens = {raw(t) for t in spec["model"]["vocab"] if all(c in plain for c in t)}
        self.tokens = tokens
        self.heads = {t[:n] for t in tokens for n in range(1, len(t))} | {b""}
        self.kinds: dict[str, str] = {}
        self.clear()

    def clear(self) -> None:
        self.pairs: dict[tuple, bool] = {}
        #: A state: the suffixes that begin a token, as (suffix, token before it or None, its count less this state's).
        self.states: list[tuple] = []
        self.names: dict[tuple, int] = {}
        self.moves: dict[int, tuple[int, int]] = {}
        self.chunks: dict[str, int] = {}
        self._state(((b"", None, 0),))

    def _state(self, key: tuple) -> int:
        if key not in self.names:
            self.names[key] = len(self.states)
            self.states.append(key)
        return self.names[key]

    def _encode(self, b: bytes) -> list[bytes]:
        """Byte-pair encoding by its definition; used to compile transitions only."""
        parts = [b[i : i + 1] for i in range(len(b))]
        while len(parts) > 1:
            best = min(((self.rank.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:]))))
            if best[0] == 1 << 60:
                break
            pair = (parts[best[1]], parts[best[1] + 1])
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(pair[0] + pair[1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def _fits(self, before: bytes | None, token: bytes) -> bool:
        key = (before, token)
        if key not in self.pairs:
            self.pairs[key] = self._encode((before or b"") + token) == ([token] if before is None else [before, token])
        return self.pairs[key]

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        b = bytes((byte,))
        chain = self.states[state]
        last, count = next((s + b, c + 1) for s, before, c in chain if s + b in self.tokens and self._fits(before, s + b))
        after = tuple((s + b, before, c - count) for s, before, c in chain if s + b in self.heads)
        move = (self._state((*after, (b"", last, 0))), count)
        self.moves[state << 8 | byte] = move
        return move

    def word(self, b: bytes) -> int:
        """The number of tokens of one pre-token."""
        moves, state, n = self.moves.get, 0, 0
        for byte in b:
            state, d = moves(state << 8 | byte) or self._compile(state, byte)
            n += d
        return n

    def text(self, text: str) -> int:
        """The number of tokens of a text without special tokens: both machines over every character."""
        total, start, state, kinds = 0, 0, "begin", self.kinds
        for i, c in enumerate(text):
            kind = kinds.get(c) or kinds.setdefault(c, _kind(c))
            state, early, here = BORDERS[state, kind]
            if early:
                total += self.word(text[start : i - 1].encode())
                start = i - 1
            if here:
                total += self.word(text[start:i].encode())
                start = i
        if state in ("quoter", "quotev", "quotel"):
            total += self.word(text[start:-1].encode())
            start = len(text) - 1
        return total + self.word(text[start:].encode())

    def _feed(self, merge: int, c: str) -> tuple[int, int]:
        """The merge state after a character, and the tokens that it adds."""
        n = 0
        for byte in c.encode():
            merge, d = self.moves.get(merge << 8 | byte) or self._compile(merge, byte)
            n += d
        return merge, n

    def over(self, state: tuple[str, int, str], chunk: str) -> tuple[tuple[str, int, str], int]:
        """A chunk's state map at one entry state: the exit state and the tokens added; the last character is counted by what follows."""
        (border, merge, held), total, kinds = state, 0, self.kinds
        for c in chunk:
            kind = kinds.get(c) or kinds.setdefault(c, _kind(c))
            border, early, here = BORDERS[border, kind]
            merge, n = self._feed(0 if early else merge, held)
            total += n
            if here:
                merge = 0
            held = c
        return (border, merge, held), total

    def composed(self, text: str) -> int:
        """The number of tokens of a long text: maps of chunks cut anywhere, composed as a tree."""
        level = []
        for i in range(0, len(text), LONG):
            chunk = text[i : i + LONG]
            entries = {self.over(START, text[max(0, i - k) : i])[0] for k in LOOKS}
            level.append(({e: self.over(e, chunk) for e in entries}, chunk))
        while len(level) > 1:
            pairs = [({}, a, b) for a, b in zip(level[::2], level[1::2])]
            for table, a, b in pairs:
                for entry in a[0]:
                    middle, n = a[0][entry]
                    last, more = self._at(b, middle)
                    table[entry] = last, n + more
            level = pairs + level[len(pairs) * 2 :]
        (border, merge, held), total = self._at(level[0], START)
        return total + self._feed(0 if border in ("quoter", "quotev", "quotel") else merge, held)[1]

    def _at(self, node: tuple, entry: tuple[str, int, str]) -> tuple[tuple[str, int, str], int]:
        """The map of a node of the tree at an entry state, added where it is missing."""
        table = node[0]
        if entry not in table:
            if len(node) == 2:
                table[entry] = self.over(entry, node[1])
            else:
                middle, n = self._at(node[1], entry)
                last, more = self._at(node[2], middle)
                table[entry] = last, n + more
        return table[entry]

    def whole(self, text: str) -> int:
        return self.text(text) if len(text) <= LONG else self.composed(text)

    def chunk(self, chunk: str) -> int:
        """The constant state map of a chunk that follows a space; -1 (with no memory) if it can't stand alone."""
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            return -1
        n = self.whole(" " + chunk)
        if len(chunk) <= LONG:
            self.chunks[chunk] = n
        return n

    def uneven(self, part: str) -> int:
        """The number of tokens of a part in which white space touches the spaces at some cuts; chunks there reach on to the next cut that holds."""
        total = 0
        for piece in _SINGLE.split(part):
            n = (self.chunks.get(piece[1:]) or self.chunk(piece[1:])) if piece[:1] == " " else -1
            total += n if n >= 0 else self.whole(piece)
        return total

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """Token counts of many texts: chunk maps, one prefix sum, differences at the texts' ends."""
        maps, ends, extra = [], np.zeros(len(texts) + 1, np.int64), np.zeros(len(texts), np.int64)
        make = self.chunk
        for i, text in enumerate(texts):
            if len(self.states) > STATES or len(self.pairs) > 4 * STATES or len(self.chunks) > CHUNKS:
                self.clear()
            find = self.chunks.get
            parts = [text or ""]
            for s in self.special:
                if s in parts[0] or len(parts) > 1:
                    split = [p.split(s) for p in parts]
                    extra[i] += sum(len(p) - 1 for p in split)
                    parts = [x for p in split for x in p]
            for part in parts:
                first, *rest = part.split(" ")
                got = [find(p) or make(p) for p in rest]
                if first and first[-1].isspace() or not first and rest or got and min(got) < 0:
                    extra[i] += self.uneven(part)
                else:
                    maps += got
                    extra[i] += self.whole(first)
            ends[i + 1] = len(maps)
        composed = np.concatenate([[0], np.cumsum(np.array(maps, np.int64))])
        return composed[ends[1:]] - composed[ends[:-1]] + extra


_machines: dict[str, CountingTransducer] = {}


def machine(name: str = TOKENIZER) -> CountingTransducer:
    """The transducer of this worker; it lives as long as the worker."""
    if name not in _machines:
        _machines[name] = CountingTransducer(name)
    return _machines[name]


def count_tokens(docs: DataFrame, limit: int = 1024, name: str = TOKENIZER) -> DataFrame:
    """Per row of (doc_id, text): n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    A null text is empty and has no tokens.  Special tokens' own strings inside
    a text count as one token, as the tokenizer has it.  Repeated rows give
    repeated results; other columns are ignored.
    """
    prepare(docs.sparkSession)

    def run(batches):
        m = machine(name)
        for b in batches:
            n = m.counts(b["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["n_bytes"], pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
