"""Static range asymmetric numeral system for token ids, interleaved over lanes.

One frequency table, scaled to 2**BITS, serves all blocks. A block holds the ids of whole
documents. Its ids are dealt over LANES states in turn: step t codes ids t*LANES to
t*LANES+LANES-1, one in each lane. All lanes share one stream of 32-bit words, in the order
the decoder takes them. Every SEGMENT steps a checkpoint keeps the lanes' states and the
place in the stream, so that each segment can be decoded without the ones before it; a
segment has a crc32 of its ids, the block one of its words.

Blocks of a batch run in lockstep, as do all their segments when decoding: numpy works on
(blocks or segments) x LANES states at once.

Block layout, little-endian:
  magic 'RNB1' | table crc32 u32 | n_ids u64 | lanes u32 | segment steps u32 | n_segments u32 |
  n_words u32 | words crc32 u32 | segment crc32 u32[n_segments] | segment start u32[n_segments] |
  states u64[n_segments * lanes] | words u32[n_words]
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BITS = 20
LOW = np.uint64(1 << 31)
LANES = 64
SEGMENT = 256
MAGIC = b"RNB1"
HEAD = struct.Struct("<4sIQIIIII")


class Table:
    """Scaled frequencies of ids 0 to V-1; each id that occurs gets at least one slot."""

    def __init__(self, freq: np.ndarray) -> None:
        self.freq = freq.astype(np.uint64)
        if int(self.freq.sum()) != 1 << BITS:
            raise ValueError("scaled frequencies must sum to 2**BITS")
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.id_of = np.repeat(np.arange(len(freq), dtype=np.uint32), self.freq.astype(np.int64))
        self.filler = int(self.freq.argmax())
        self.crc = zlib.crc32(freq.astype("<u4").tobytes())

    @classmethod
    def scaled(cls, counts: np.ndarray) -> Table:
        """Counts scaled so that the sum is 2**BITS; what rounding leaves over falls on the most frequent ids."""
        counts = np.asarray(counts, np.float64)
        seen = counts > 0
        if seen.sum() > 1 << BITS:
            raise ValueError(f"more than 2**{BITS} distinct ids")
        if not seen.any():
            return cls(np.asarray([1 << BITS], np.uint32))
        freq = np.where(seen, np.maximum(1, np.floor(counts * ((1 << BITS) / counts.sum()))), 0).astype(np.int64)
        off = (1 << BITS) - int(freq.sum())
        order = np.argsort(-freq, kind="stable")
        if off > 0:
            freq[order[0]] += off
        for k in order:
            if off >= 0:
                break
            give = min(int(freq[k]) - 1, -off)
            freq[k] -= give
            off += give
        return cls(freq.astype(np.uint32))

    def dump(self) -> bytes:
        return self.freq.astype("<u4").tobytes()

    @classmethod
    def load(cls, data: bytes) -> Table:
        return cls(np.frombuffer(data, "<u4"))


def encode_blocks(blocks: list[np.ndarray], table: Table, lanes: int = LANES, segment: int = SEGMENT) -> list[bytes]:
    """One coded block for each array of ids; blocks of like length go through together."""
    out: list[bytes] = [b""] * len(blocks)
    order = sorted(range(len(blocks)), key=lambda k: len(blocks[k]))
    for k in range(0, len(order), 16):
        group = order[k : k + 16]
        for i, coded in zip(group, _encode([blocks[i] for i in group], table, lanes, segment), strict=True):
            out[i] = coded
    return out


def _encode(blocks: list[np.ndarray], table: Table, lanes: int, segment: int) -> list[bytes]:
    steps = [-(-len(b) // lanes) for b in blocks]
    top, n = max(steps, default=0), len(blocks)
    grid = np.full((n, top * lanes), table.filler, np.int64)
    for row, b in zip(grid, blocks, strict=True):
        row[: len(b)] = b
    grid = grid.reshape(n, top, lanes)
    grid = np.ascontiguousarray(grid.swapaxes(0, 1))
    x = np.full((n, lanes), LOW, np.uint64)
    words, emit = np.zeros((n, top, lanes), np.uint32), np.zeros((n, top, lanes), bool)
    states: list[dict[int, np.ndarray]] = [{} for _ in blocks]
    live, shortest = np.asarray(steps)[:, None], min(steps, default=0)
    # q * 2**BITS + (x - q * f) + s is x + q * (2**BITS - f) + s.
    freq = np.maximum(table.freq, np.uint64(1))
    limits, rest = freq * np.uint64((1 << 63) >> BITS), np.uint64(1 << BITS) - freq
    word = np.uint64(32)
    for first in range((top - 1) // segment * segment, -1, -segment):
        ids = grid[first : first + segment]
        f, s, limit, more = (x_of.take(ids) for x_of in (freq, table.start, limits, rest))
        for t in range(min(first + segment, top) - 1, first - 1, -1):
            k = t - first
            full = x >= limit[k]
            if t >= shortest:
                full &= live > t
            words[:, t], emit[:, t] = x, full
            y = np.where(full, x >> word, x)
            y += y // f[k] * more[k] + s[k]
            x = y if t < shortest else np.where(live > t, y, x)
        for k in range(n):
            if steps[k] > first:
                states[k][first] = x[k].copy()
    out = []
    for k, b in enumerate(blocks):
        own, at = emit[k, : steps[k]], np.arange(0, steps[k], segment)
        stream = words[k, : steps[k]][own]
        before = np.concatenate([[0], np.cumsum(own.sum(1))])[at] if len(at) else np.zeros(0)
        ids = np.asarray(b).astype("<u4")
        crcs = [zlib.crc32(ids[t * lanes : (t + segment) * lanes].tobytes()) for t in at]
        data = stream.astype("<u4").tobytes()
        head = HEAD.pack(MAGIC, table.crc, len(b), lanes, segment, len(at), len(stream), zlib.crc32(data))
        out.append(head + np.asarray(crcs, "<u4").tobytes() + before.astype("<u4").tobytes() + b"".join(states[k][t].astype("<u8").tobytes() for t in at) + data)
    return out


class Block:
    """A coded block, opened and checked but not decoded."""

    def __init__(self, data: bytes, table: Table) -> None:
        magic, crc, self.n, self.lanes, self.segment, k, n_words, words_crc = HEAD.unpack_from(data)
        if magic != MAGIC or crc != table.crc:
            raise ValueError("not a block of this frequency table")
        at = HEAD.size
        self.crcs = np.frombuffer(data, "<u4", k, at)
        self.starts = np.frombuffer(data, "<u4", k, at + 4 * k)
        self.states = np.frombuffer(data, "<u8", k * self.lanes, at + 8 * k).reshape(k, self.lanes)
        self.words = np.frombuffer(data, "<u4", n_words, at + 8 * k + 8 * k * self.lanes)
        if zlib.crc32(self.words.tobytes()) != words_crc:
            raise ValueError("the block's words are damaged")


def decode_segments(parts: list[tuple[Block, int]], table: Table) -> list[np.ndarray]:
    """The ids of (block, segment number) pairs, each from its checkpoint, all in lockstep."""
    if not parts:
        return []
    lanes, segment = parts[0][0].lanes, parts[0][0].segment
    if any((b.lanes, b.segment) != (lanes, segment) for b, _ in parts):
        raise ValueError("blocks of one call must share lanes and segment length")
    blocks = list({id(b): b for b, _ in parts}.values())
    base, at = {}, 0
    for b in blocks:
        base[id(b)] = at
        at += len(b.words)
    stream = np.concatenate([b.words for b in blocks] + [np.zeros(1, "<u4")]).astype(np.uint64)
    left = np.asarray([min(segment * lanes, b.n - k * segment * lanes) for b, k in parts])
    steps = -(-left // lanes)
    place = np.asarray([base[id(b)] + int(b.starts[k]) for b, k in parts], np.int64)
    x = np.stack([b.states[k] for b, k in parts]).astype(np.uint64)
    ids = np.zeros((len(parts), int(steps.max()), lanes), np.uint32)
    mask, shift, word = np.uint64((1 << BITS) - 1), np.uint64(BITS), np.uint64(32)
    for t in range(int(steps.max())):
        slot = x & mask
        i = table.id_of[slot]
        ids[:, t] = i
        on = (steps > t)[:, None]
        x = np.where(on, table.freq[i] * (x >> shift) + slot - table.start[i], x)
        need = on & (x < LOW)
        rank = np.cumsum(need, axis=1)
        got = stream[np.where(need, place[:, None] + rank - 1, len(stream) - 1)]
        x = np.where(need, (x << word) | got, x)
        place += rank[:, -1]
    out = [row.reshape(-1)[:n] for row, n in zip(ids, left, strict=True)]
    for (b, k), own in zip(parts, out, strict=True):
        if zlib.crc32(own.astype("<u4").tobytes()) != int(b.crcs[k]):
            raise ValueError(f"segment {k} is damaged")
    return out


def decode_blocks(data: list[bytes], table: Table) -> list[np.ndarray]:
    blocks = [Block(d, table) for d in data]
    parts = [(b, k) for b in blocks for k in range(len(b.crcs))]
    got = iter([x for k in range(0, len(parts), 32) for x in decode_segments(parts[k : k + 32], table)])
    return [np.concatenate([next(got) for _ in b.crcs]) if len(b.crcs) else np.zeros(0, np.uint32) for b in blocks]
