"""Near-duplicate groups through SetSketch.

Each document becomes the set of its word shingles (64-bit hashes), the set a sketch. Equal sets are one class; from
here on classes stand for their documents. Bands of registers are bucket keys. Pairs that share a bucket are
compared as `links` does it: a pair's similarity is estimated by likelihood from the sketches, and what can be a link is
verified on the full sets. Each pair of classes that shares a bucket is tested, in the first of its buckets, or connected
already. The smallest id of a component names it.

A pair of similarity s shares a bucket with probability 1 - (1 - s**4)**32: at 0.8 all but 5 in
10**8 do. The estimate's margin is five standard deviations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import setsketch
from .common import Tables, doc_text, documents
from .links import between_components, classes_of, components, grouped, meeting, set_key, shingle_set, star_pairs, verified, with_key

MARGIN = 5.0
#: Equal registers are at least as probable as the similarity; that share is looked at before the likelihood.
ROUGH = MARGIN * 0.5 / setsketch.REGISTERS**0.5


def sketched(rows: DataFrame, width: int) -> DataFrame:
    """(doc_id, text_key, n, set_key, sketch) for (doc_id, text, text_key); an empty set has no key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, keys, sketches = [], [], []
            for t in b.column("text"):
                s = shingle_set(t.as_py(), width)
                n.append(len(s))
                keys.append(set_key(s) if len(s) else None)
                sketches.append(setsketch.sketch(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary())], ["doc_id", "text_key", "n", "set_key", "sketch"])

    return rows.mapInArrow(run, "doc_id long, text_key long, n long, set_key binary, sketch binary")


def registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, setsketch.REGISTERS)


def bands_of(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys = setsketch.band_keys(registers(b.column("sketch")))
                each = [pa.array(np.repeat(b.column(c).to_numpy(), keys.shape[1])) for c in ("node", "n")]
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *each], ["band", "node", "n"])

    return classes.select("node", "n", "sketch").mapInArrow(run, "band long, node long, n long")


def possible(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, share: float) -> np.ndarray:
    """Which pairs can reach `share`: their sizes allow it, and so does the likeliest similarity, with a margin."""
    fits = np.minimum(n_a, n_b) >= share * np.maximum(n_a, n_b) - 1e-9
    k = np.flatnonzero(fits)
    j = setsketch.likeliest_jaccard((a[k] > b[k]).sum(1), (a[k] < b[k]).sum(1), n_a[k], n_b[k]) if len(k) else np.zeros(0)
    fits[k] = j >= share - MARGIN * np.sqrt(share * (1 - share) / setsketch.REGISTERS) - 1 / 128
    return fits


def estimated(pairs: DataFrame, classes: DataFrame, share: float) -> DataFrame:
    """Of (a, b), the pairs whose sketches allow a link."""
    one = classes.select(F.col("node").alias("a"), F.col("sketch").alias("sketch_a"), F.col("n").alias("n_a"))
    two = classes.select(F.col("node").alias("b"), F.col("sketch").alias("sketch_b"), F.col("n").alias("n_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 2000):
                x = whole.slice(k, 2000)
                ok = possible(registers(x.column("sketch_a")), registers(x.column("sketch_b")), x.column("n_a").to_numpy(), x.column("n_b").to_numpy(), share)
                yield pa.RecordBatch.from_arrays([x.column("a"), x.column("b")], ["a", "b"]).filter(pa.array(ok))

    return pairs.join(two, "b").join(one, "a").mapInArrow(run, "a long, b long")


class SketchFilter:
    """The sketches of a tile's classes."""

    def __init__(self, held: list[dict], share: float) -> None:
        self.share, self.n = share, np.asarray([r["n"] for r in held], np.int64)
        self.registers = np.frombuffer(b"".join(r["sketch"] for r in held), np.uint16).reshape(len(held), -1)
        keys = setsketch.band_keys(self.registers)
        self.earlier = keys[:, : int(np.flatnonzero(keys[0] == held[0]["band"])[0])]

    def partners(self, i: int, others: np.ndarray) -> np.ndarray:
        others = others[~(self.earlier[others] == self.earlier[i]).any(1)]
        others = others[(self.registers[others] == self.registers[i]).mean(1) >= self.share - ROUGH]
        if not len(others):
            return others
        one = np.broadcast_to(self.registers[i], (len(others), self.registers.shape[1]))
        return others[possible(one, self.registers[others], np.full(len(others), self.n[i]), self.n[others], self.share)]


def similar(a: pa.RecordBatch, b: pa.RecordBatch, share: float) -> np.ndarray:
    """What SketchFilter says about the pairs (a[k], b[k]), each of one bucket."""
    out = np.zeros(a.num_rows, bool)
    for k in range(0, a.num_rows, 2000):
        x, y = a.slice(k, 2000), b.slice(k, 2000)
        p, q = registers(x.column("sketch")), registers(y.column("sketch"))
        keys = setsketch.band_keys(p)
        own = (keys == x.column("band").to_numpy()[:, None]).argmax(1)
        met = ((keys == setsketch.band_keys(q)) & (np.arange(keys.shape[1]) < own[:, None])).any(1)
        at = np.flatnonzero(~met & ((p == q).mean(1) >= share - ROUGH))
        out[k + at] = possible(p[at], q[at], x.column("n").to_numpy()[at], y.column("n").to_numpy()[at], share)
    return out


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per input row.

    Documents are linked if den * |intersection| >= num * |union| of their sets of `width`-word shingles. component_id
    is the smallest id reachable over links; kept is whether the row has it. A null or empty text, or one
    of white space, has an empty set, is linked with nothing and kept. A null id counts only where a
    component has no other. Rows that repeat an id are compared by their own texts and kept alike if they
    have the component's id. An empty table gives no rows, other columns are not read.
    """
    share = num / den
    rows = doc_text(docs, id_col, text_col)
    tables = Tables(docs.sparkSession)
    own = tables.stage(sketched(with_key(rows), width), "near-sketches")
    classes = tables.stage(classes_of(own, "sketch"), "near-classes")
    bands = bands_of(classes)
    crowded = bands.groupBy("band").agg(F.count("*").alias("size")).where("size > 1").select("band")
    shared = tables.stage(meeting(tables.stage(bands.join(crowded, "band"), "near-bands"), num, den), "near-bands")
    star = tables.stage(estimated(star_pairs(shared, num, den), classes, share), "near-pairs")
    roots = components(verified(star, classes, rows, width, num, den, tables), tables)
    looks = [(lambda held: SketchFilter(held, share), lambda a, b: similar(a, b, share), ["sketch"])]
    more = between_components(shared, roots, classes, rows, looks, width, num, den, tables)
    if not more.isEmpty():
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(more), tables)
    found = grouped(own, classes, roots, tables)
    return tables.finish(found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")), "near-groups")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), width=3, num=85, den=100)
