"""Byte-level BPE by backtracking over longest matches.

Token bytes are mapped to Latin-1 characters and put into an Aho-Corasick automaton. A piece
is encoded from left to right with the longest token at each place; a token is accepted
only if it and its left neighbour would also come out next to each other from the merges
(`Ranks.fits`, remembered for each pair), otherwise the next shorter token is tried and,
failing that, the walk steps back. The one sequence whose neighbours all fit is what the
merges give, and each place is settled once, so time is linear in the piece.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import doc_text, documents, memory
from .tokenizer_files import default_path

SCHEMA = "doc_id long, ids array<int>, decoded binary"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Pieces and pairs remembered by one worker at most; beyond that it starts anew.
CACHE_PIECES = 450_000
CACHE_PAIRS = 300_000
LONG_TEXT, LONG_PIECE = 10_000, 1_000


class Ranks:
    """A rank file's vocabulary with its encoder and decoder."""

    def __init__(self, path: str, pattern: str) -> None:
        import ahocorasick
        import regex

        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.rank = {base64.b64decode(a): int(b) for a, b in pairs}
        self.token = {i: t for t, i in self.rank.items()}
        self.size = [len(self.token.get(i, b"")) for i in range(max(self.token) + 1)]
        self.find = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for t, i in self.rank.items():
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.shorter = [-2] * len(self.size)
        self.pieces: dict[str, bytes] = {}

    def halves_of(self, i: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes token i, by playing the merges inside it; None for one byte."""
        if i in self.halves:
            return self.halves[i]
        t = self.token[i]
        parts, found = [t[k : k + 1] for k in range(len(t))], None
        while len(parts) > 1:
            if len(parts) == 2:
                found = (self.rank[parts[0]], self.rank[parts[1]])
                break
            best, at = min(((self.rank.get(parts[k] + parts[k + 1], 1 << 60), k) for k in range(len(parts) - 1)))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        self.halves[i] = found
        return found

    def fits(self, a: int, b: int) -> bool:
        """Whether the merges leave tokens a and b side by side for the bytes of both.

        Undo merges from the youngest on, at both sides of the border, and look whether a merge
        across the border would have come earlier than the one being undone.
        """
        left, right, limit, ok = a, b, 1 << 60, True
        while True:
            across = self.rank.get(self.token[left] + self.token[right])
            if across is not None and across < limit:
                ok = False
                break
            two_l, two_r = self.halves_of(left), self.halves_of(right)
            if two_l is None and two_r is None:
                break
            # The later merge is undone first; of equal ones the right one, as merges go from left to right.
            if two_r is None or (two_l is not None and left > right):
                limit, left = left, two_l[1]
                # A merge across with the same rank would stand to the right of the undone one: too late.
            else:
                # A merge across with the same rank would stand to the left of the undone one: first.
                limit, right = right + 1, two_r[0]
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        self.pairs[a, b] = ok
        return ok

    def next_shorter(self, i: int) -> int:
        """The longest token that is a proper prefix of token i; -1 if there is none."""
        t = self.token[i]
        self.shorter[i] = next((self.rank[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.rank), -1)
        return self.shorter[i]

    def longest(self, piece: bytes) -> list[int]:
        """For each place the longest token that begins there; the last match from a place is the longest."""
        out, size = [-1] * len(piece), self.size
        for end, i in self.automaton.iter(piece.decode("latin-1")):
            out[end + 1 - size[i]] = i
        return out

    def encode_bytes(self, piece: bytes) -> list[int]:
        if piece in self.rank:
            return [self.rank[piece]]
        n, first, size, known, shorter = len(piece), self.longest(piece), self.size, self.pairs.get, self.shorter
        dead = bytearray(n + 1)  # places from which no fitting sequence was found
        ids: list[int] = []
        at, i, last = 0, first[0], -1
        while True:
            if i >= 0:
                end = at + size[i]
                if not dead[end]:
                    ok = last < 0 or known((last, i))
                    if ok is None:
                        ok = self.fits(last, i)
                    if ok:
                        ids.append(i)
                        at, last = end, i
                        if at == n:
                            return ids
                        i = first[at]
                        continue
                i = shorter[i] if shorter[i] > -2 else self.next_shorter(i)
                if i >= 0:
                    continue
            if not ids:
                raise ValueError("the rank file lacks single bytes of this text")
            dead[at] = 1
            i = ids.pop()  # is tried again: its end is dead now, so a shorter one follows
            at -= size[i]
            last = ids[-1] if ids else -1

    def encode(self, text: str) -> list[int]:
        found, pieces = self.find(text), self.pieces
        if len(pieces) >= CACHE_PIECES:
            pieces.clear()
        for p in set(found).difference(pieces):
            pieces[p] = array("i", self.encode_bytes(p.encode("utf-8"))).tobytes()
        ids = array("i", b"".join(map(pieces.__getitem__, found))).tolist()
        for p in found if len(text) > LONG_TEXT else ():
            if len(p) > LONG_PIECE:
                pieces.pop(p, None)  # a huge piece hardly comes again
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def ranks(path: str, pattern: str) -> Ranks:
    """One vocabulary per worker process and file."""
    loaded = memory("ranks")
    if (path, pattern) not in loaded:
        loaded[path, pattern] = Ranks(path, pattern)
    return loaded[path, pattern]


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def encode_decode(docs: DataFrame, path: str, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded), one row per input row; decoded comes from the ids alone.

    A null or empty text gives no ids and no bytes. Null and repeated ids each give their row, an
    empty table gives none, and texts of any length are encoded whole. Other columns are not read.
    """
    pattern = pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ranks(path, pattern)
        for b in batches:
            for part in slices(b):
                ids = [bpe.encode(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(x) for x in ids], pa.binary())], ["doc_id", "ids", "decoded"])

    return doc_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def encode_digests(docs: DataFrame, path: str, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode_decode() with ids and decoded bytes digested where they are made: (doc_id, n_tokens,
    ids_sha256, decoded_sha256). The same rules for nulls, empty and long texts and repeated rows."""
    pattern = pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ranks(path, pattern)
        for b in batches:
            n, one, two = [], [], []
            for t in b.column("text"):
                ids = bpe.encode(t.as_py())
                n.append(len(ids))
                one.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                two.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return doc_text(docs, id_col, text_col).mapInArrow(run, DIGESTS)


def slices(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(documents(spark, sf_dir), default_path("byte_bpe_multi_50k.tiktoken"))
