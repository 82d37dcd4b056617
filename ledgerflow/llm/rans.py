"""Static range asymmetric numeral system over token ids, with interleaved lanes, checkpoints and checksums.

One frequency table, scaled to 2**20, is shared by all blocks of a segment.  A
block interleaves LANES states of 64 bits that give out words of 32 bits.  Every
ROWS rows of a block a checkpoint keeps the states and the place in the words,
so decoding can begin at any of them; all checkpoints of a segment are decoded
side by side.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

LANES = 128
ROWS = 256
BLOCK_TOKENS = 1 << 16
SCALE = 20
LOW = np.uint64(1 << 31)
_U = np.uint64


class ChecksumError(ValueError):
    """Stored bytes differ from those that were written."""


@dataclass
class Segment:
    """What is stored for a run of tokens."""

    n: int
    symbols: bytes
    freqs: bytes
    blocks: int
    rows: int
    states: bytes
    places: bytes
    words: bytes
    crcs: list[int]


def shared_table(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols that occur, and their frequencies, at least 1, summing to 2**SCALE."""
    counts = np.bincount(tokens)
    symbols = np.flatnonzero(counts)
    f = np.maximum(1, counts[symbols].astype(np.int64) * (1 << SCALE) // len(tokens))
    left = (1 << SCALE) - int(f.sum())
    while left:
        top = int(f.argmax())
        step = left if left > 0 else -min(-left, int(f[top]) // 2)
        f[top] += step
        left -= step
    return symbols.astype(np.uint16), f.astype(np.uint32)


def encode(tokens: np.ndarray) -> Segment:
    """Encode a non-empty array of ids under 65536."""
    n = len(tokens)
    symbols, f = shared_table(tokens)
    blocks = -(-n // BLOCK_TOKENS)
    rows = -(-n // (blocks * LANES))
    place = np.zeros(65536, np.int64)
    place[symbols] = np.arange(len(symbols))
    padded = np.full(blocks * rows * LANES, int(f.argmax()), np.int64)
    padded[:n] = place[tokens]
    grid = padded.reshape(blocks, rows, LANES)
    freq = f.astype(_U)
    start = (np.cumsum(freq) - freq).astype(_U)
    x = np.full((blocks, LANES), LOW, _U)
    given = np.zeros((rows, blocks, LANES), np.uint32)
    gives = np.zeros((rows, blocks, LANES), bool)
    units = -(-rows // ROWS)
    states = np.zeros((blocks, units, LANES), _U)
    most = freq << _U(31 - SCALE + 32)
    for r in range(rows - 1, -1, -1):
        s = grid[:, r]
        fr = freq[s]
        over = x >= most[s]
        given[r], gives[r] = x, over
        x >>= over.astype(_U) << _U(5)
        q = x // fr
        x -= q * fr
        x += start[s]
        x += q << _U(SCALE)
        if r % ROWS == 0:
            states[:, r // ROWS] = x
    by_block, mask = given.transpose(1, 0, 2).reshape(blocks, -1), gives.transpose(1, 0, 2).reshape(blocks, -1)
    words = by_block[mask]
    sizes = mask.sum(1)
    before = np.cumsum(mask.reshape(-1)) - mask.reshape(-1)
    places = before.reshape(blocks, rows * LANES)[:, :: ROWS * LANES].astype(np.uint32)
    ends = np.cumsum(sizes)
    crcs = [zlib.crc32(words[e - k : e].astype("<u4").tobytes(), zlib.crc32(states[b].astype("<u8").tobytes())) for b, (e, k) in enumerate(zip(ends.tolist(), sizes.tolist()))]
    return Segment(n, symbols.astype("<u2").tobytes(), f.astype("<u4").tobytes(), blocks, rows, states.astype("<u8").tobytes(), places.astype("<u4").tobytes(), words.astype("<u4").tobytes(), crcs)


def decode(s: Segment) -> np.ndarray:
    """The ids of a segment; ChecksumError if a block is damaged."""
    symbols = np.frombuffer(s.symbols, "<u2")
    freq = np.frombuffer(s.freqs, "<u4").astype(_U)
    start = (np.cumsum(freq) - freq).astype(_U)
    units = -(-s.rows // ROWS)
    states = np.frombuffer(s.states, "<u8").reshape(s.blocks, units, LANES)
    places = np.frombuffer(s.places, "<u4").reshape(s.blocks, units).astype(np.int64)
    words = np.frombuffer(s.words, "<u4")
    for b in range(s.blocks):
        end = places[b + 1, 0] if b + 1 < s.blocks else len(words)
        if zlib.crc32(words[places[b, 0] : end].tobytes(), zlib.crc32(states[b].tobytes())) != s.crcs[b]:
            raise ChecksumError(f"block {b} of a segment of {s.n} tokens")
    find = np.repeat(np.arange(len(symbols), dtype=np.uint16), freq.astype(np.int64))
    words = np.append(words, np.zeros(LANES + 1, np.uint32)).astype(_U)
    x, at = states.reshape(-1, LANES).copy(), places.reshape(-1)
    rows = min(ROWS, s.rows)
    out = np.zeros((s.blocks * units, rows, LANES), np.uint16)
    last = len(words) - 1
    for r in range(rows):
        slot = x & _U((1 << SCALE) - 1)
        k = find[slot.astype(np.int64)]
        out[:, r] = k
        x = freq[k] * (x >> _U(SCALE)) + slot - start[k]
        low = x < LOW
        got = np.cumsum(low, axis=1)
        w = words[np.minimum(at[:, None] + got - 1, last)]
        x = np.where(low, (x << _U(32)) | w, x)
        at = at + got[:, -1]
    flat = out.reshape(s.blocks, units * rows, LANES)[:, : s.rows].reshape(-1)[: s.n]
    return symbols[flat]
