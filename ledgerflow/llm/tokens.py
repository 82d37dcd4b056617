"""Token ids of whole texts by a public tokenizer, with a memo of the pieces between spaces.

``tokenizers`` does all the encoding.  A single space with no white space on
either side always begins a new pre-token of the byte-level tokenizer, and every
space is dropped by the word tokenizer, so a text's ids are those of its pieces
one after another.  Pieces repeat a lot; each is encoded once and remembered, in
a memo of bounded size.  A text with other spacing is encoded whole.  For the
byte-level tokenizer ``encode_column`` does so for many texts at once: they are
cut wherever a pre-token surely ends, and Arrow finds the distinct pieces.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import cached_property
from itertools import repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex

from .jobs import trim
from .shingles import utf8

MEMO = 600_000
#: As many pieces of ``encode_column`` are remembered, none longer than LONG bytes; it works on about BLOCK bytes at once.
PIECES, LONG, BLOCK = 1_200_000, 64, 1 << 20
SPACED = {"byte_bpe_50k.json": True, "word_bpe_49k.json": False}
#: The tokenizers' own rules for pre-tokens (fixed values).
RULES = {
    "byte_bpe_50k.json": r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
    "word_bpe_49k.json": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
}
#: Pieces that go to the tokenizer as they are: unusual characters, and what may hold a special token.
ODD = regex.compile(r"[\x1c-\x1f\x85\u0130\u0250-\U0010ffff]|<\|").search
_loaded: dict[str, "PieceEncoder"] = {}

#: Kinds of characters by their first byte: letters, digits, signs, apostrophes, others that are no white space, spaces, other white space.
_LETTER, _DIGIT, _SIGN, _QUOTE, _OTHER, _SPACE, _LINE = range(1, 8)
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = _SIGN
_KIND[48:58], _KIND[65:91], _KIND[97:123], _KIND[39] = _DIGIT, _LETTER, _LETTER, _QUOTE
_KIND[0xC3:0xCA] = _LETTER
_KIND[0xCA:0xE1] = _KIND[0xE4:0xF8] = _OTHER
_KIND[32], _KIND[[9, 10, 13]] = _SPACE, _LINE
#: Pairs of kinds (8 times the first, and the second) between which a pre-token of the byte-level tokenizer ends, whatever stands around them.
_ENDS = np.zeros(64, bool)
_ENDS[[8 * k + w for k in range(_LETTER, _SPACE) for w in (_SPACE, _LINE)]] = True
_ENDS[[8 * k + w for k, to in ((_LETTER, (_DIGIT, _SIGN, _QUOTE)), (_DIGIT, (_LETTER, _SIGN, _QUOTE)), (_SIGN, (_LETTER, _DIGIT))) for w in to]] = True
#: UTF-8 that is one pre-token for sure; nothing is tried twice, so long pieces take linear time.
ONE = re.compile(rb" ?(?:[A-Za-z]++|[0-9]++|[!-/:-@\[-`{-~]++|(?:[A-Za-z]++|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc9][\x80-\xbf])++)").fullmatch


def _pieces(b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places where the bytes of texts can be cut, each piece having the ids that it has in its text; ``at`` are the edges of the texts.

    Cuts are where a pre-token ends whatever stands around, and no piece ends in
    white space but a lone tab or end of line.  Characters of unknown kind are
    not cut off, nor is a text cut that may hold a special token.
    """
    n = len(b)
    kind = _KIND[b]
    tail = np.flatnonzero((b & 0xC0) == 0x80)
    if len(tail):
        signs = tail[(b[tail - 1] == 0xC3) & ((b[tail] == 0x97) | (b[tail] == 0xB7))]
        kind[signs - 1] = _OTHER
        for _ in range(3 if (b >= 0xE0).any() else 1):
            kind[tail] = kind[tail - 1]
    cut = np.ones(n + 1, bool)
    cut[1:n] = _ENDS[(kind[:-1] << 3) | kind[1:]]
    solid = (kind >= _LETTER) & (kind <= _OTHER)
    first = np.zeros(n + 1, bool)
    first[at] = True
    line = np.flatnonzero(kind == _LINE)
    line = line[(line > 0) & (line < n - 1)]
    line = line[solid[line - 1] & solid[line + 1] & ~first[line]]
    cut[line + 1] = True
    special = np.flatnonzero((b[:-1] == 60) & (b[1:] == 124))
    for row in np.unique(np.searchsorted(at, special, "right") - 1).tolist():
        cut[at[row] : at[row + 1]] = False
    cut[at] = True
    return np.flatnonzero(cut)


def encoder(name: str) -> "PieceEncoder":
    """The encoder of this worker; it lives as long as the worker."""
    if name not in _loaded:
        _loaded[name] = PieceEncoder(name)
        trim()
    return _loaded[name]


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary: printable Latin-1 stands for itself, others follow from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PieceEncoder:
    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers.models import BPE

        self.name = name
        with open(public_tokenizers.path(name), encoding="utf-8") as f:
            spec = json.load(f)["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["merges"]]
        #: The same model without its own cache: the memo stands before it.
        self.model = BPE(vocab=spec["vocab"], merges=merges, cache_capacity=0, **{k: spec[k] for k in ("end_of_word_suffix",) if spec[k]})
        self.spaced = SPACED[name]
        self.pre = regex.compile(RULES[name]).findall
        self.letters = _byte_letters()
        self.ends = {c: [t.id for t in self.model.tokenize(c)] for c in ".,"}
        self.clear()

    @cached_property
    def tokenizer(self):
        """The whole tokenizer, for texts that the pieces' rules don't cover; most batches never need it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(public_tokenizers.path(self.name))

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        #: Ids of all remembered pieces, one after another; entry 0 is unused.
        self.flat, self.start, self.size = array("H"), array("q", [0]), array("q", [0])

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint16)

    def _ids(self, piece: str) -> list[int]:
        """The ids of a text; if all its characters are old Latin ones its pre-tokens go straight to the model."""
        if ODD(piece):
            return self.tokenizer.encode(piece, add_special_tokens=False).ids
        tokenize, letters = self.model.tokenize, self.letters
        found = self.pre(piece if self.spaced else piece.lower())
        return [t.id for p in found for t in tokenize((p if p.isascii() else p.encode().decode("latin-1")).translate(letters))]

    def _word(self, piece: str) -> list[int]:
        """The ids of a piece after a space; a Latin word, or one with a final stop or comma, needs no splitting."""
        end = piece[-1]
        word = piece[:-1] if end in ".," else piece
        if word.isalpha():
            if word.isascii():
                mapped = word if self.spaced else word.lower()
            else:
                try:
                    word.encode("latin-1")
                except UnicodeEncodeError:
                    return self._ids(" " + piece if self.spaced else piece)
                mapped = (word if self.spaced else word.lower()).encode().decode("latin-1").translate(self.letters)
            ids = [t.id for t in self.model.tokenize("Ġ" + mapped if self.spaced else mapped)]
            return ids if word is piece else ids + self.ends[end]
        return self._ids(" " + piece if self.spaced else piece)

    def _add(self, piece: str) -> int:
        """The memo's entry for a piece after a space; -1 for one that can't stand alone."""
        if not piece or piece[0].isspace() or piece[-1].isspace():
            at = -1
        else:
            ids, at = self._word(piece), len(self.start)
            self.start.append(len(self.flat))
            self.size.append(len(ids))
            self.flat.extend(ids)
        self.index[piece] = at
        return at

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a text; null is empty."""
        if not text:
            return np.zeros(0, np.uint16)
        if len(self.index) > MEMO:
            self.clear()
        pieces = text.split(" ")
        first = pieces[0]
        if len(pieces) == 1:
            return np.array(self._ids(text), np.uint16)
        if self.spaced and (not first or first[-1].isspace()):
            return self.whole(text)
        if self.spaced:
            del pieces[0]
        elif "" in pieces:
            pieces = [p for p in pieces if p]
            if not pieces:
                return np.zeros(0, np.uint16)
        found = list(map(self.index.get, pieces))
        if None in found:
            find, add = self.index.get, self._add
            found = [k or find(p) or add(p) for k, p in zip(found, pieces)]
        at = np.array(found, np.int64)
        if at.min() < 0:
            return self.whole(text)
        sizes = np.frombuffer(self.size, np.int64)[at]
        ends = np.cumsum(sizes)
        out = np.frombuffer(self.flat, np.uint16)[np.arange(ends[-1]) + np.repeat(np.frombuffer(self.start, np.int64)[at] - ends + sizes, sizes)]
        return np.concatenate([np.array(self._ids(first), np.uint16), out]) if self.spaced else out

    def _new(self, piece: bytes) -> int:
        """An entry for a piece of ``_pieces``, remembered unless it is long."""
        if ONE(piece):
            word = piece.decode("latin-1")
            ids = [t.id for t in self.model.tokenize(word.replace(" ", "Ġ") if piece.isascii() else word.translate(self.letters))]
        else:
            ids = self._ids(piece.decode())
        at = len(self.start)
        self.start.append(len(self.flat))
        self.size.append(len(ids))
        self.flat.extend(ids)
        if len(piece) <= LONG:
            self.index[piece] = at
        return at

    def encode_column(self, column: pa.Array):
        """Yield, for the next few texts of a column at a time, all their ids one after another and how many each has."""
        if not self.spaced:
            for text in column.to_pylist():
                ids = self.encode(text)
                yield ids, np.array([len(ids)])
            return
        data, offsets = utf8(column)
        row, n = 0, len(offsets) - 1
        while row < n:
            end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK, "right")) - 1)
            yield self._block(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row])
            row = end

    def _block(self, b: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(b):
            return np.zeros(0, np.uint16), np.zeros(len(at) - 1, np.int64)
        if len(self.start) > PIECES or len(self.flat) > 16 * PIECES:
            self.clear()
        edges = _pieces(b, at)
        coded = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(b)]).dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.index.get, pieces, repeat(0)))
        if 0 in found:
            new = self._new
            found = [k or new(p) for k, p in zip(found, pieces)]
        entry = np.array(found, np.int64)[coded.indices.to_numpy()]
        sizes = np.frombuffer(self.size, np.int64)[entry]
        ends = np.append(0, np.cumsum(sizes))
        ids = np.frombuffer(self.flat, np.uint16)[np.arange(ends[-1]) + np.repeat(np.frombuffer(self.start, np.int64)[entry] - ends[:-1], sizes)]
        return ids, np.diff(ends[np.searchsorted(edges, at)])
