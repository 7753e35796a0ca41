"""Exact self-join of documents by the Jaccard similarity of their word n-grams.

Each document becomes the set of its n-gram hashes, and a signature: a bitmap of hashed elements, two to four bits to an element.
A bit that is set in one bitmap and not in the other stands for an element that only the first set has, so the bit
counts bound the overlap from above.

Which documents are compared at all is decided by prefixes, which loses nothing: of two linked sets, each put
into one common order, the first n - ceil(share * n) + 1 elements have one in common. The order puts elements that many sets hold
last, so that prefixes hold the telling ones; how often elements occur is estimated from one text in
SAMPLE, and any order gives the same links. A prefix element is a bucket. Within a bucket `links` cuts the sets into
tiles by size bands: bitmaps first, then, where a pair is left, prefixes, then the exact intersection of sorted arrays. A pair is
intersected in the bucket of its first common element only, and not at all once it is connected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, doc_text, documents
from .links import between_components, classes_of, components, grouped, meeting, set_key, shingle_set, star_pairs, verified, with_key
from .words import mixed, pack, unpack

#: Of so many distinct texts one is counted for the order of elements; so many common elements, the commonest ones, are told to the tasks.
SAMPLE, COMMON_AT, COMMON = 16, 4, 500_000
#: Bits of a bitmap: a power of two, two to four times the elements, within these.
LEAST_BITS, MOST_BITS = 256, 1 << 18


def common_elements(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(elements, counts) of those that COMMON_AT or more of the sampled texts hold, COMMON at most, in order of hash.
    Only the order of elements, and so the size of buckets, depends on it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                sets = [shingle_set(t.as_py(), width) for t in b.column("text").slice(k, 512)]
                own, n = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(n)], ["element", "n"])

    few = with_key(rows).where(F.pmod("text_key", F.lit(SAMPLE)) == 0).groupBy("text_key").agg(F.first("text").alias("text"))
    counted = few.select("text").mapInArrow(run, "element long, n long").groupBy("element").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON_AT)
    found = counted.orderBy(F.desc("n"), "element").limit(COMMON).collect()
    elements = np.asarray([r["element"] for r in found], np.int64).view(np.uint64)
    order = np.argsort(elements)
    return elements[order], np.asarray([r["n"] for r in found], np.int64)[order]


def prefix(elements: np.ndarray, common: tuple[np.ndarray, np.ndarray], num: int, den: int) -> np.ndarray:
    """The first n - ceil(n * num / den) + 1 elements in the common order: by estimated count, then by hash."""
    size = len(elements) - -(-num * len(elements) // den) + 1
    known, counts = common
    if not len(known):
        return elements[:size]
    at = np.minimum(np.searchsorted(known, elements), len(known) - 1)
    held = known[at] == elements
    rare = elements[~held]
    if len(rare) >= size:
        return rare[:size]
    own, n = elements[held], counts[at[held]]
    return np.concatenate([rare, own[np.lexsort((own, n))]])[:size]


def bitmap(elements: np.ndarray) -> np.ndarray:
    """The elements as set bits of 64-bit words. Halves of a bitmap laid over each other are the bitmap of half the length."""
    bits = LEAST_BITS
    while bits < 2 * len(elements) and bits < MOST_BITS:
        bits *= 2
    out = np.zeros(bits, np.uint8)
    out[(mixed(elements) & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    while (now := bits.shape[-1]) > words:
        bits = bits[..., : now // 2] | bits[..., now // 2 :]
    return bits


def may_link(only_a: np.ndarray, only_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets of these sizes can be linked, when so many bits at least are set in one bitmap alone."""
    most = np.minimum(n_a - only_a, n_b - only_b)
    return den * most >= num * (n_a + n_b - most)


def bits_allow(a: pa.Array, b: pa.Array, n_a: np.ndarray, n_b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which of the pairs (a[k], b[k]) of bitmaps can be linked, by their sizes and bits."""
    ok = den * np.minimum(n_a, n_b) >= num * np.maximum(n_a, n_b)
    lengths = np.stack([pc.binary_length(x).to_numpy(zero_copy_only=False) for x in (a, b)])
    for own in np.unique(lengths[:, ok], axis=1).T:
        at, words = np.flatnonzero(ok & (lengths == own[:, None]).all(0)), int(own.min()) // 8
        step = max(1, (1 << 22) // int(own.sum()))
        for k in range(0, len(at), step):
            part = at[k : k + step]
            p, q = (folded(np.frombuffer(b"".join(x.take(pa.array(part)).to_pylist()), np.uint64).reshape(len(part), -1), words) for x in (a, b))
            ok[part] = may_link(np.bitwise_count(p & ~q).sum(1, dtype=np.int64), np.bitwise_count(q & ~p).sum(1, dtype=np.int64), n_a[part], n_b[part], num, den)
    return ok


def signed(rows: DataFrame, width: int, common: tuple[np.ndarray, np.ndarray], num: int, den: int) -> DataFrame:
    """(doc_id, text_key, n, set_key, bits, prefix); a text without words has an empty set and no key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, keys, bits, prefixes = [], [], [], []
            for t in b.column("text"):
                s = shingle_set(t.as_py(), width)
                n.append(len(s))
                keys.append(set_key(s) if len(s) else None)
                bits.append(bitmap(s).tobytes() if len(s) else None)
                prefixes.append(pack(prefix(s, common, num, den)) if len(s) else None)
            columns = [b.column("doc_id"), b.column("text_key"), pa.array(n, pa.int64()), *[pa.array(x, pa.binary()) for x in (keys, bits, prefixes)]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "n", "set_key", "bits", "prefix"])

    return rows.mapInArrow(run, "doc_id long, text_key long, n long, set_key binary, bits binary, prefix binary")


def prefix_rows(classes: DataFrame, num: int, den: int) -> DataFrame:
    """(band, node, n, most): a row per class and prefix element. If the element at this place is the first that another set shares, the
    two have no more in common than what follows, so a set of more than `most` elements is no partner here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                x = b.slice(k, 512)
                own = [unpack(p.as_py()) for p in x.column("prefix")]
                sizes = np.asarray([len(p) for p in own])
                node, n = (np.repeat(x.column(c).to_numpy(), sizes) for c in ("node", "n"))
                place = np.arange(len(n)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                most = (n - place) * (num + den) // num - n
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64)), pa.array(node), pa.array(n), pa.array(most)], ["band", "node", "n", "most"])

    return classes.select("node", "n", "prefix").mapInArrow(run, "band long, node long, n long, most long")


def bounded(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Of (a, b), the pairs whose sizes and bitmaps allow a link."""
    one = classes.select(F.col("node").alias("a"), F.col("bits").alias("bits_a"), F.col("n").alias("n_a"))
    two = classes.select(F.col("node").alias("b"), F.col("bits").alias("bits_b"), F.col("n").alias("n_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ok = bits_allow(*(x.column(c) for c in ("bits_a", "bits_b")), *(x.column(c).to_numpy() for c in ("n_a", "n_b")), num, den)
            yield pa.RecordBatch.from_arrays([x.column("a"), x.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(two, "b").join(one, "a").mapInArrow(run, "a long, b long")


class BitmapFilter:
    """The bitmaps of a tile's classes."""

    def __init__(self, held: list[dict], num: int, den: int) -> None:
        self.num, self.den = num, den
        self.n = np.asarray([r["n"] for r in held], np.int64)
        own = [np.frombuffer(r["bits"], np.uint64) for r in held]
        words = min(map(len, own))
        self.bits = np.stack([folded(b, words) for b in own])
        self.counts = np.bitwise_count(self.bits).sum(1, dtype=np.int64)

    def partners(self, i: int, others: np.ndarray) -> np.ndarray:
        n = self.n[others]
        others = others[self.den * np.minimum(n, self.n[i]) >= self.num * np.maximum(n, self.n[i])]
        if not len(others):
            return others
        both = np.bitwise_count(self.bits[others] & self.bits[i]).sum(1, dtype=np.int64)
        return others[may_link(self.counts[i] - both, self.counts[others] - both, self.n[i], self.n[others], self.num, self.den)]


def bits_meet(a: pa.RecordBatch, b: pa.RecordBatch, num: int, den: int) -> np.ndarray:
    """What BitmapFilter says about the pairs (a[k], b[k])."""
    return bits_allow(a.column("bits"), b.column("bits"), a.column("n").to_numpy(), b.column("n").to_numpy(), num, den)


def first_meet(a: pa.RecordBatch, b: pa.RecordBatch, num: int, den: int) -> np.ndarray:
    """What FirstMeeting says about the pairs (a[k], b[k]), each of one bucket."""
    ok, bands = bits_meet(a, b, num, den), a.column("band").to_numpy().view(np.uint64)
    for k in np.flatnonzero(ok).tolist():
        p, q = (unpack(x.column("prefix")[k].as_py()) for x in (a, b))
        p, q = (x[: int((x == bands[k]).argmax())] for x in (p, q))
        ok[k] = not len(np.intersect1d(p, q, assume_unique=True))
    return ok


class FirstMeeting(BitmapFilter):
    """Bitmaps, and which classes share an element before the tile's own in the common order."""

    def __init__(self, held: list[dict], num: int, den: int) -> None:
        super().__init__(held, num, den)
        at = np.uint64(held[0]["band"] & (2**64 - 1))
        earlier = []
        for r in held:
            p = unpack(r["prefix"])
            earlier.append(p[: int(np.flatnonzero(p == at)[0])])
        elements, place, counts = np.unique(np.concatenate(earlier), return_inverse=True, return_counts=True)
        member = np.repeat(np.arange(len(held)), [len(e) for e in earlier])
        # Elements that one class holds part nobody.
        several = counts[place] > 1
        self.elements, self.members = place[several], member[several]
        self.order = np.argsort(self.elements, kind="stable")
        self.starts = np.searchsorted(self.elements[self.order], np.arange(len(elements) + 1))
        self.by_member = np.searchsorted(self.members, np.arange(len(held) + 1))

    def partners(self, i: int, others: np.ndarray) -> np.ndarray:
        others = super().partners(i, others)
        if not len(others):
            return others
        met = np.zeros(len(self.n), bool)
        for e in self.elements[self.by_member[i] : self.by_member[i + 1]].tolist():
            met[self.members[self.order[self.starts[e] : self.starts[e + 1]]]] = True
        return others[~met[others]]


def ngram_join(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per input row.

    Documents are linked if den * |intersection| >= num * |union| of their sets of `width`-word shingles (A-Z lower-cased, words cut at ASCII
    white space, fewer words than `width` are one shingle); every pair that is linked is found or connected by others. component_id is the
    smallest id reachable over links. A null or empty text, or one of white space, has an empty set and is linked with
    nothing. A null id counts only where a component has no other. Rows that repeat an id are compared by their own
    texts. Texts are taken whole, whatever their length. An empty table gives no rows, other columns are not read. The number of links
    is not counted: that would test all pairs within each group of near copies.
    """
    rows = doc_text(docs, id_col, text_col)
    tables = Tables(docs.sparkSession)
    common = common_elements(rows, width)
    own = tables.stage(signed(with_key(rows), width, common, num, den), "join-sets")
    wide = tables.paths[-1]
    classes = tables.stage(classes_of(own, "bits", "prefix"), "join-classes")
    # Signatures are kept once for each set.
    own = tables.stage(own.select("doc_id", "n", "set_key"), "join-sets")
    tables.drop(wide)
    each = prefix_rows(classes, num, den)
    several = each.groupBy("band").agg(F.count("*").alias("size")).where("size > 1").select("band")
    shared = tables.stage(meeting(tables.stage(each.join(several, "band"), "join-prefixes"), num, den), "join-prefixes")
    star = tables.stage(bounded(star_pairs(shared, num, den), classes, num, den), "join-pairs")
    roots = components(verified(star, classes, rows, width, num, den, tables), tables)
    looks = [
        (lambda held: BitmapFilter(held, num, den), lambda a, b: bits_meet(a, b, num, den), ["bits"]),
        (lambda held: FirstMeeting(held, num, den), lambda a, b: first_meet(a, b, num, den), ["bits", "prefix"]),
    ]
    more = between_components(shared, roots, classes, rows, looks, width, num, den, tables)
    if not more.isEmpty():
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(more), tables)
    found = grouped(own, classes, roots, tables)
    return tables.finish(found.select("doc_id", F.col("n").alias("n_shingles"), "component_id"), "join-groups")


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(documents(spark, sf_dir))
