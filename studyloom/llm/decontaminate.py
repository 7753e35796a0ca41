"""Benchmark decontamination by SimHash over item-sized windows.

A window has as many words as a benchmark item. Its fingerprint is the 128-bit SimHash of its
five-word shingles, each weighing as often as it occurs. Items' fingerprints are cut
into 16 blocks of 8 bits; of two fingerprints within RADIUS (40) bits, one block at least
differs in 40 // 16 = 2 bits at most, so looking up every block within 2 bits finds all items
within the radius. What is found is verified: the shingle counts of window and item must
overlap by `similarity` (sum of the smaller counts over sum of the larger).

The radius holds for distinct shingles only: one that repeats weighs as often as it occurs and can turn
any number of bits. So where a shingle repeats in the window or in the item, their overlap is counted
exactly, whatever their fingerprints.

Windows with fewer shingles of items of their size than `similarity` takes are passed over
before any fingerprint is made: their overlap with each such item is smaller still.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_text, documents

SHINGLE = 5
SIMILARITY = 0.8
BITS, BLOCKS, RADIUS = 128, 16, 40
#: Items' text that one pass over the documents carries; more items take more passes.
PASS_BYTES = 8 << 20
#: Windows of a text that are looked at together.
WINDOWS = 4096
SCHEMA = "doc_id long, item_id long, similarity double, start_word long, n_words long, distance int"
find_words = re.compile(r"[^\W_]+").findall
POPCOUNT = np.asarray([bin(k).count("1") for k in range(256)], np.uint8)
NEAR = POPCOUNT[np.arange(256)[:, None] ^ np.arange(256)[None, :]] <= RADIUS // BLOCKS


def words_of(text: str) -> list[str]:
    """Runs of letters and digits, in lower case."""
    return find_words(text.lower())


def shingles_of(words: list[str]) -> list[tuple[str, ...]]:
    """Runs of five words; a shorter sequence is one shingle."""
    if len(words) <= SHINGLE:
        return [tuple(words)] if words else []
    return list(zip(*(words[k:] for k in range(SHINGLE)), strict=False))


def overlap(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity: counts as weights."""
    common = sum(min(n, b[s]) for s, n in a.items() if s in b)
    return common / (sum(a.values()) + sum(b.values()) - common) if common else 0.0


def shingle_hashes(words: list[str], q: int) -> np.ndarray:
    """Two 64-bit hashes for each shingle of q words, as (n, 2)."""
    import xxhash

    h = np.asarray([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    out = np.zeros((len(words) - q + 1, 2), np.uint64)
    for col, (seed, times) in enumerate(((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93), (0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F))):
        acc = np.full(len(out), seed, np.uint64)
        for k in range(q):
            acc = (acc ^ h[k : k + len(out)]) * np.uint64(times)
            acc ^= acc >> np.uint64(29)
        acc *= np.uint64(0xBF58476D1CE4E5B9)
        out[:, col] = acc ^ (acc >> np.uint64(32))
    return out


def fingerprints(words: list[str], starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the windows of `size` words at these starts, as 16 bytes each."""
    bits = np.unpackbits(shingle_hashes(words, min(SHINGLE, size)).view(np.uint8), axis=1)
    signs = np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(2 * bits.astype(np.int32) - 1, axis=0)])
    n = max(1, size - SHINGLE + 1)
    return np.packbits(signs[starts + n] - signs[starts] > 0, axis=1)


def repeating(words: list[str], q: int) -> np.ndarray:
    """For each place, where the first shingle of q words ends up that repeats one from that place on; else a place past all."""
    first = np.full(len(words) + 1, 1 << 62, np.int64)
    last: dict[tuple[str, ...], int] = {}
    for p, s in enumerate(zip(*(words[k:] for k in range(q)), strict=False)):
        if s in last:
            first[last[s]] = p
        last[s] = p
    return np.minimum.accumulate(first[::-1])[::-1]


class Items:
    """Benchmark items of one pass, by size in words."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.by_size: dict[int, list] = {}
        self.word_ids: dict[str, int] = {}
        self.counts: dict[int, list[Counter]] = {}  # of word numbers
        self.owners: dict[tuple[int, ...], dict[int, list[int]]] = {}
        for item, text in items:
            words = words_of(text)
            if words:
                ids = [self.word_ids.setdefault(w, len(self.word_ids) + 1) for w in words]
                for s in set(shingles_of(ids)):
                    self.owners.setdefault(s, {}).setdefault(len(words), []).append(len(self.by_size.get(len(words), ())))
                self.counts.setdefault(len(words), []).append(Counter(shingles_of(ids)))
                self.by_size.setdefault(len(words), []).append((item, Counter(shingles_of(words)), fingerprints(words, np.zeros(1, np.int64), len(words))[0]))
        self.prints = {m: np.stack([x[2] for x in own]) for m, own in self.by_size.items()}
        # For each block and byte, which items have a block within reach.
        self.index = {m: np.stack([NEAR[:, p[:, k]] for k in range(BLOCKS)]) for m, p in self.prints.items()}
        self.repeats = {m: {k for k, x in enumerate(own) if max(x[1].values()) > 1} for m, own in self.by_size.items()}
        self.widths = sorted({len(s) for s in self.owners})

    def hits(self, words: list[str]) -> dict[int, list[tuple[int, tuple[int, ...]]]]:
        """For each item size, the places in words where a shingle of such an item begins, with the shingle."""
        ids = np.fromiter((self.word_ids.get(w, 0) for w in words), np.int64, len(words))
        found: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
        for q in self.widths:
            if len(ids) >= q:
                known = np.cumsum(np.concatenate([[0], ids > 0]))
                for p in np.flatnonzero(known[q:] - known[:-q] == q).tolist():
                    s = tuple(ids[p : p + q].tolist())
                    for m in self.owners.get(s, ()):
                        found.setdefault(m, []).append((p, s))
        return found

    def exact(self, m: int, places: list[tuple[int, tuple[int, ...]]], starts: np.ndarray, again: np.ndarray, n: int, similarity: float) -> Iterator[tuple[int, int, float]]:
        """(item's number, index into starts, similarity) of each item's best window, of those in which a shingle
        repeats (again) or, if one repeats in the item, of all. Windows have n shingles."""
        where: dict[int, dict[tuple[int, ...], list[int]]] = {}
        every, repeats = bool(again.any()), self.repeats[m]
        for p, s in places if every or repeats else ():
            for k in self.owners[s][m]:
                if every or k in repeats:
                    where.setdefault(k, {}).setdefault(s, []).append(p)
        total = n + max(1, m - SHINGLE + 1)
        for k, own in where.items():
            if (1 + similarity) * sum(map(len, own.values())) < similarity * total - 1e-9:
                continue
            able = np.arange(len(starts)) if k in repeats else np.flatnonzero(again)
            common = np.zeros(len(able), np.int64)
            for s, at in own.items():
                held = np.searchsorted(at, starts[able] + n) - np.searchsorted(at, starts[able])
                common += np.minimum(held, self.counts[m][k][s])
            best = int(common.argmax())
            alike = float(common[best] / (total - common[best]))
            if common[best] and alike >= similarity:
                yield k, int(able[best]), alike

    def matches(self, text: str, similarity: float) -> list[tuple]:
        """(item, similarity, start, words, distance): the best window for each item that the text holds."""
        words = words_of(text)
        out: dict[tuple, tuple] = {}
        for m, places in self.hits(words).items():
            size = min(m, len(words))
            reach = max(1, m - SHINGLE + 1)
            n = max(1, size - SHINGLE + 1)
            held = np.zeros(len(words) + 1, np.int64)
            held[[p + 1 for p, _ in places]] = 1
            held = np.cumsum(held)
            # The windows that begin less than `reach` places before a hit.
            at, last = np.asarray([p for p, _ in places]), len(words) - size
            within = np.zeros(last + 2, np.int64)
            np.add.at(within, np.clip(at - reach + 1, 0, last), 1)
            np.add.at(within, np.clip(at, 0, last) + 1, -1)
            near = np.flatnonzero(np.cumsum(within) > 0)
            # Common shingles over all shingles can reach the similarity only from here on.
            near = near[(1 + similarity) * (held[near + n] - held[near]) >= similarity * (n + reach) - 1e-9]
            later = repeating(words, min(SHINGLE, size)) if len(near) else None
            # Piece by piece, so that memory does not grow with the text times the items.
            for piece in np.split(near, np.flatnonzero(np.diff(near // WINDOWS)) + 1) if len(near) else ():
                low = int(piece[0])
                prints = fingerprints(words[low : int(piece[-1]) + size], piece - low, size)

                def keep(k: int, w: int, s: float, m=m, size=size, near=piece, prints=prints) -> None:
                    start = int(near[w])
                    if (-s, start) < out.get((m, k), (0, 0, 0))[:2]:
                        distance = int(POPCOUNT[prints[w] ^ self.prints[m][k]].sum())
                        out[m, k] = (-s, start, (self.by_size[m][k][0], s, start, size, distance))

                reached = np.zeros((len(piece), len(self.prints[m])), bool)
                for k in range(BLOCKS):
                    reached |= self.index[m][k][prints[:, k]]
                again = later[piece] < piece + n
                # What exact() counts need not be counted here.
                reached &= ~again[:, None]
                reached[:, list(self.repeats[m])] = False
                for w, k in zip(*np.nonzero(reached), strict=True):
                    if int(POPCOUNT[prints[w] ^ self.prints[m][k]].sum()) > RADIUS:
                        continue
                    start = int(piece[w])
                    s = overlap(Counter(shingles_of(words[start : start + size])), self.by_size[m][k][1])
                    if s >= similarity:
                        keep(int(k), int(w), s)
                inside = [x for x in places if low <= x[0] < int(piece[-1]) + n]
                for k, w, s in self.exact(m, inside, piece, again, n, similarity):
                    keep(k, w, s)
        return [x[2] for x in out.values()]


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words, distance): a row for each document and item whose
    passage it holds, with the best window (the first of equal ones).

    Documents and items without words match nothing, so null and empty texts give no row. A document
    shorter than an item is one window. Null and repeated ids are reported as they are; equal
    (item, text) rows count once. Without items, or without documents, there are no rows. Texts are searched
    whole, whatever their length; columns other than those named are not read.
    """
    spark = docs.sparkSession
    items = doc_text(benchmark, item_col, item_text_col).distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    passes = max(1, -(-size // pass_bytes))
    rows = doc_text(docs, id_col, text_col)
    out = spark.createDataFrame([], SCHEMA)
    for k in range(passes):
        own = [(r["doc_id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(passes)) == k).collect()]

        def run(batches: Iterator[pa.RecordBatch], own=own) -> Iterator[pa.RecordBatch]:
            index = Items(own)
            for b in batches:
                found = [(i.as_py(), *m) for i, t in zip(b.column("doc_id"), b.column("text"), strict=True) for m in index.matches(t.as_py(), similarity)]
                if found:
                    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], ["doc_id", "item_id", "similarity", "start_word", "n_words", "distance"])

        found = rows.mapInArrow(run, SCHEMA)
        out = found if k == 0 else out.unionAll(found)
    return out


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
