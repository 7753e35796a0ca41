"""Links between sets that share a bucket, and the components they make.

What near-duplicate search and the n-gram join have in common. Documents with equal sets are one class
(`node`); a class is named after one of its rows, by id and text. Buckets (`band`) say which classes can be linked.

1. Each bucket is dealt to parts, and those to smaller parts; every class is paired with the smallest one
   of its part, and these among each other likewise. What a filter of signatures lets pass is verified on full
   sets. Links give components.
2. In buckets that still hold several components, pairs between components are compared in tiles: blocks of classes
   of about one size, against each other and against those of the next size band. A tile holds at most TILE_ELEMENTS elements
   or eight classes a side, whatever the bucket; in large buckets no tile holds the largest component on both sides. First only signatures meet; classes that have a partner left come again with
   their texts, and their sets are compared. A tile sends out only links that join what it has not yet
   joined, fewer than it has members, so no list of pairs is ever made.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LOWER, UPPER, Tables, drop_path, slots, stage
from .words import word_hashes

#: Members and elements of a block of a tile.
BLOCK, TILE_ELEMENTS = 512, 1 << 20
#: A bucket has so many parts, and each of these as many.
FAN = 64
#: From so many members on a bucket's largest component is told apart.
LARGE = 64
TILE = ("band", "size_a", "block_a", "size_b", "block_b")
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


class Filter(Protocol):
    """What signatures say about the pairs of some classes."""

    def partners(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of `others` that can be linked with i and share no earlier bucket with it."""


#: The same for the pairs (a[k], b[k]) of two batches, for the many tiles of two classes.
Pairs = Callable[[pa.RecordBatch, pa.RecordBatch], np.ndarray]


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted hashes of the text's shingles: A-Z lower-cased, words cut at ASCII white space; fewer words than
    `width` are one shingle, no words none."""
    h = word_hashes(text)
    if not len(h):
        return np.zeros(0, np.uint64)
    q = min(width, len(h))
    n = len(h) - q + 1
    acc = np.full(n, q, np.uint64)
    for k in range(q):
        acc = (acc ^ h[k : k + n]) * _ODD[0]
        acc ^= acc >> np.uint64(32)
        acc *= _ODD[1]
        acc ^= acc >> np.uint64(29)
    return np.unique(acc * _ODD[2])


def set_key(elements: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(elements.tobytes())


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Whether den * |intersection| >= num * |union|; both are sorted and without repeats."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return den * common >= num * (len(a) + len(b) - common)


def with_key(rows: DataFrame) -> DataFrame:
    """(doc_id, text) with `text_key`, which tells texts of one id apart."""
    return rows.withColumn("text_key", F.xxhash64("text"))


def classes_of(own: DataFrame, *carried: str) -> DataFrame:
    """A row per set of (doc_id, text_key, n, set_key, ...): node, set_key, n, the id and text it is named after, its least id."""
    named = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("named")
    grouped = own.where("n > 0").groupBy("set_key").agg(named, *[F.first(c).alias(c) for c in ("n", *carried)])
    return grouped.select(F.monotonically_increasing_id().alias("node"), "set_key", "n", F.col("named.doc_id").alias("least_id"), F.col("named.text_key").alias("text_key"), *carried)


def texts_of(nodes: DataFrame, classes: DataFrame, rows: DataFrame, *carried: str) -> DataFrame:
    """(node, set_key, text, ...), one row per class: the text that the class is named after."""
    named = nodes.select("node").distinct().join(classes.select("node", "least_id", F.col("text_key").alias("_key"), "set_key", *carried), "node")
    own = with_key(rows)
    found = own.join(named, (own["text_key"] == named["_key"]) & own["doc_id"].eqNullSafe(named["least_id"]))
    # Rows that repeat an id and a text are one.
    return found.groupBy("node").agg(*[F.first(c).alias(c) for c in ("set_key", "text", *carried)])


def meeting(shared: DataFrame, num: int, den: int) -> DataFrame:
    """Of (band, node, n) or (band, node, n, most), the rows whose bucket holds another class that they could be linked with there, and
    `members`, how many the bucket held. Buckets of two are judged by both rows' bounds, others by those of the bucket."""
    n, bounds = F.col("n"), [F.sum("most").alias("_most"), F.min("n").alias("_low"), F.max("most").alias("_high")] if "most" in shared.columns else []
    buckets = shared.groupBy("band").agg(F.count("*").alias("members"), F.sum("n").alias("_n"), *bounds).where("members > 1")
    other = F.col("_n") - n
    two, more = F.least(n, other) * den >= F.greatest(n, other) * num, F.lit(True)
    if bounds:
        two = two & (other <= F.col("most")) & (n <= F.col("_most") - F.col("most"))
        more = (F.col("_low") <= F.col("most")) & (n <= F.col("_high"))
    return shared.join(buckets, "band").where(F.when(F.col("members") == 2, two).otherwise(more)).select(*shared.columns, "members")


def size_bands(rows: DataFrame, num: int, den: int) -> tuple[DataFrame, float]:
    """rows with `size`, the band of n, and the logarithm of a band's width. Sets of linked classes are in one band or neighbouring ones."""
    # A little more than the sizes of linked sets can differ by, so that rounding never parts them by two bands.
    ratio = max(math.log(den / num), 0.01) * (1 + 1e-9)
    return rows.withColumn("size", F.floor(F.log(F.col("n").cast("double")) / ratio).cast("int")), ratio


def star_pairs(shared: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): each class with the smallest one of its size in its part of its bucket, and those with the smallest one of theirs, up to
    the bucket's; pairs whose sizes allow a link."""
    sized, _ = size_bands(shared, num, den)
    rows, pairs = sized.select("band", "size", F.pmod(F.xxhash64("node"), F.lit(FAN * FAN)).alias("part"), "node", "n"), None
    for level in range(3):
        hub = F.min(F.struct("node", "n")).over(W.partitionBy("band", "size", "part"))
        placed = rows.withColumn("hub", hub)
        fits = F.least("n", "hub.n") * den >= F.greatest("n", "hub.n") * num
        own = placed.where(F.col("node") != F.col("hub.node")).where(fits).select(F.col("hub.node").alias("a"), F.col("node").alias("b"))
        pairs = own if pairs is None else pairs.unionAll(own)
        rows = placed.where(F.col("node") == F.col("hub.node")).select("band", "size", F.floor(F.col("part") / FAN).alias("part") if level == 0 else F.lit(0).alias("part"), "node", "n")
    return pairs.distinct()


def verified(pairs: DataFrame, classes: DataFrame, rows: DataFrame, width: int, num: int, den: int, tables: Tables) -> DataFrame:
    """Of (a, b), the links, on full sets. Texts are read again for the classes at hand; a text whose set is another
    one (its key stands for several texts) is passed over."""
    texts, path = stage(texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node")), classes, rows), "near-texts")
    sides = pairs.unionByName(pairs.select("a", F.col("a").alias("b")).distinct())
    with_text = sides.join(texts.withColumnRenamed("node", "b"), "b").withColumn("member", F.col("a") != F.col("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hub = None, None
        for x in batches:
            links: tuple[list[int], list[int]] = ([], [])
            for a, b, key, text in zip(*(x.column(c) for c in ("a", "b", "set_key", "text")), strict=True):
                a, b, own = a.as_py(), b.as_py(), shingle_set(text.as_py(), width)
                if set_key(own) != key.as_py():
                    continue
                if a == b:
                    at, hub = a, own
                elif at == a and linked(hub, own, num, den):
                    links[0].append(a)
                    links[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(links[0], pa.int64()), pa.array(links[1], pa.int64())], ["a", "b"])

    ordered = with_text.repartition(slots(rows.sparkSession), "a").sortWithinPartitions("a", "member")
    links = tables.stage(ordered.select("a", "b", "set_key", "text").mapInArrow(run, "a long, b long").distinct(), "near-links")
    drop_path(rows.sparkSession, path)
    return links


def components(edges: DataFrame, tables: Tables) -> DataFrame:
    """(node, root) for the nodes of (a, b): root is the smallest node reachable. Large-star and small-star
    steps in turn, until nothing changes; each round's edges are written, so none is repeated on a loss."""

    def star(e: DataFrame, both: bool) -> DataFrame:
        near = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        told = near.where(F.col("b") > F.col("a")) if both else near
        out = told.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return out if both else out.unionAll(least.select("a", F.col("m").alias("b")))

    spark = edges.sparkSession
    now, path = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    while state[0]:
        after = star(star(now, True).where("a <> b").distinct(), False).where("a <> b").distinct()
        after, new_path = stage(after, "components")
        new = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_path(spark, path)
        now, path = after, new_path
        if new == state:
            break
        state = new
    tables.paths.append(path)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def largest(labelled: DataFrame) -> DataFrame:
    """(band, top) of large buckets: the component with most members."""
    each = labelled.where(F.col("members") >= LARGE).groupBy("band", "root").agg(F.count("*").alias("held"))
    return each.groupBy("band").agg(F.max(F.struct("held", "root")).alias("top")).select("band", F.col("top.root").alias("top"))


def dealt_to_tiles(shared: DataFrame, roots: DataFrame, num: int, den: int, tables: Tables) -> DataFrame:
    """(TILE..., node, root, n, side, most): members of buckets that hold several components, for every tile they are in; side is 0 for
    the first block, 1 for the second, 2 where a block meets itself. most is the size that a partner in this bucket can have at most.
    Blocks of a large bucket hold either classes of its largest component, and do not meet each other, or others."""
    sized, ratio = size_bands(shared if "most" in shared.columns else shared.withColumn("most", F.lit((1 << 63) - 1)), num, den)
    labelled = sized.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = labelled.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("band")
    mixed = mixed.join(largest(labelled), "band", "left")
    labelled = tables.stage(labelled.join(mixed, "band").withColumn("inside", F.coalesce(F.col("root") == F.col("top"), F.lit(False))), "near-mixed")
    # So many classes of a size band take one block; sizes of a band differ by the factor den / num at most.
    room = F.least(F.lit(float(BLOCK)), F.greatest(F.lit(8.0), TILE_ELEMENTS / F.exp(F.col("size") * ratio)))
    counted = labelled.groupBy("band", "size").agg(F.count_if(~F.col("inside")).alias("others"), F.count_if("inside").alias("ours"))
    counted = counted.withColumn("open", F.ceil(F.col("others") / room).cast("int")).withColumn("blocks", F.col("open") + F.ceil(F.col("ours") / room).cast("int"))
    by_size = counted.groupBy("band").agg(F.map_from_entries(F.collect_list(F.struct("size", F.struct("open", "blocks")))).alias("blocks"))
    members = labelled.join(by_size, "band")
    # Blocks of a size, those outside the largest component first.
    of = lambda k, name: F.coalesce(F.try_element_at("blocks", F.col("size") + k)[name], F.lit(0))
    first, room_for = F.when(F.col("inside"), of(0, "open")).otherwise(0), F.when(F.col("inside"), of(0, "blocks") - of(0, "open")).otherwise(of(0, "open"))
    members = members.withColumn("own", (first + F.pmod(F.xxhash64("node"), room_for)).cast("int"))
    met = lambda k: F.when(F.col("inside"), of(k, "open")).otherwise(of(k, "blocks"))
    every = lambda k: F.when(met(k) > 0, F.sequence(F.lit(0), met(k) - 1)).otherwise(F.array().cast("array<int>"))
    tile = lambda a, x, b, y, side: F.struct(a.alias("size_a"), x.alias("block_a"), b.alias("size_b"), y.alias("block_b"), side.alias("side"))
    size, own = F.col("size"), F.col("own")
    same = F.transform(every(0), lambda k: tile(size, F.least(own, k), size, F.greatest(own, k), F.when(k == own, 2).when(k > own, 0).otherwise(1)))
    above = F.transform(every(1), lambda k: tile(size, own, size + 1, k, F.lit(0)))
    below = F.transform(every(-1), lambda k: tile(size - 1, k, size, own, F.lit(1)))
    return members.select("band", F.explode(F.concat(same, above, below)).alias("t"), "node", "root", "n", "most").select("band", "t.size_a", "t.block_a", "t.size_b", "t.block_b", "node", "root", "n", "t.side", "most")


def tiles_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each tile, which follow one another."""
    held: list[dict] = []
    for b in batches:
        for k in range(0, b.num_rows, 256):
            for row in b.slice(k, 256).to_pylist():
                if held and any(row[c] != held[0][c] for c in TILE):
                    yield held
                    held = []
                held.append(row)
    if held:
        yield held


def whole_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of whole tiles, with the rows at which these start."""
    held: pa.RecordBatch | None = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(c).to_numpy() for c in TILE])
        starts = np.concatenate([[0], 1 + np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)), [b.num_rows]])
        if held is not None:
            if all(held.column(c)[0] == b.column(c)[0] for c in TILE):
                held = pa.concat_batches([held, b.slice(0, starts[1])])
                starts = starts[1:]
                if len(starts) == 1:
                    continue
            yield held, np.zeros(1, np.int64)
        if len(starts) > 2:
            yield b.slice(starts[0], starts[-2] - starts[0]), starts[:-2] - starts[0]
        held = b.slice(starts[-2])
    if held is not None:
        yield held, np.zeros(1, np.int64)


def open_twos(b: pa.RecordBatch, starts: np.ndarray, pairs: Pairs) -> np.ndarray:
    """Of tiles of two rows, the starts of those whose rows are a pair that open_pairs would give."""
    side, root, n, most = (b.column(c).to_numpy() for c in ("side", "root", "n", "most"))
    left = np.where(side[starts] != 1, starts, starts + 1)
    right = 2 * starts + 1 - left
    ok = (side[left] != 1) & (side[right] > 0) & (root[left] != root[right]) & (n[right] <= most[left]) & (n[left] <= most[right])
    starts, left, right = starts[ok], left[ok], right[ok]
    return starts[pairs(b.take(pa.array(left)), b.take(pa.array(right)))] if len(starts) else starts


def open_pairs(held: list[dict], make: Callable[[list[dict]], Filter]) -> Iterator[tuple[int, np.ndarray]]:
    """(i, others): pairs of a tile between different components that the filter lets pass."""
    side, root, n, most = (np.asarray([r[c] for r in held]) for c in ("side", "root", "n", "most"))
    right = np.flatnonzero(side > 0)
    left = np.flatnonzero(side != 1)
    if not len(left) or not len(right) or (root == root[0]).all():
        return
    check = make(held)
    for i in left.tolist():
        others = right[(root[right] != root[i]) & ((side[right] != 2) | (right > i)) & (n[right] <= most[i]) & (most[right] >= n[i])]
        if len(others):
            others = check.partners(i, others)
            if len(others):
                yield i, others


def links_of(held: list[dict], make: Callable[[list[dict]], Filter], width: int, num: int, den: int) -> tuple[list[int], list[int]]:
    """Links of a tile, as many as join what they can join."""
    sets: dict[int, np.ndarray | None] = {}
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    def set_of(k: int) -> np.ndarray | None:
        if k not in sets:
            s = shingle_set(held[k]["text"], width)
            sets[k] = s if set_key(s) == held[k]["set_key"] else None
        return sets[k]

    out: tuple[list[int], list[int]] = ([], [])
    for i, others in open_pairs(held, make):
        for j in others.tolist():
            a, b = find(held[i]["root"]), find(held[j]["root"])
            if a != b and set_of(i) is not None and set_of(j) is not None and linked(sets[i], sets[j], num, den):
                parent[a] = b
                out[0].append(held[i]["node"])
                out[1].append(held[j]["node"])
    return out


def worth_a_look(dealt: DataFrame, num: int, den: int) -> DataFrame:
    """The rows of tiles that have classes of different components on both sides, where sizes allow a link with the other side."""
    left, right = F.col("side") != 1, F.col("side") != 0
    of = lambda side, name: [F.min(F.when(side, F.col("n"))).alias(f"low_{name}"), F.max(F.when(side, F.col("n"))).alias(f"high_{name}")]
    tiles = dealt.groupBy(*TILE).agg(F.min("root").alias("low"), F.max("root").alias("high"), *of(left, "left"), *of(right, "right")).where("low <> high and low_left is not null and low_right is not null")
    tiles = tiles.select(*[F.col(c).alias(f"_{c}") for c in TILE], "low_left", "high_left", "low_right", "high_right")
    same = [dealt[c] == tiles[f"_{c}"] for c in TILE]
    n, most = F.col("n"), F.col("most")
    meets = lambda name: (F.col(f"low_{name}") <= most) & (F.col(f"high_{name}") * den >= n * num) & (n * den >= F.col(f"low_{name}") * num)
    fits = F.when(F.col("side") == 0, meets("right")).when(F.col("side") == 1, meets("left")).otherwise(meets("left"))
    return dealt.join(tiles, same).where(fits).select(*dealt.columns)


def between_components(shared: DataFrame, roots: DataFrame, classes: DataFrame, rows: DataFrame, looks: list[tuple[Callable[[list[dict]], Filter], Pairs, list[str]]], width: int, num: int, den: int, tables: Tables) -> DataFrame:
    """(a, b): links between classes of one bucket but different components, as many as connect what is linked
    in a tile. shared: as of meeting(); looks: filters, also for pairs, with the columns of classes that each reads, one after another, the
    cheapest first; the last one's pairs are verified on texts."""
    spark = rows.sparkSession
    own = "band long, size_a int, block_a int, size_b int, block_b int, node long, root long, n long, side int, most long"
    names = [x.split()[0] for x in own.split(", ")]

    def survivors(make: Callable[[list[dict]], Filter], pairs: Pairs) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b, starts in whole_tiles(batches):
                sizes = np.diff(np.append(starts, b.num_rows))
                twos = open_twos(b, starts[sizes == 2], pairs)
                stay: set[int] = {*twos.tolist(), *(twos + 1).tolist()}
                for at, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                    for i, others in open_pairs(b.slice(at, size).to_pylist(), make):
                        stay.add(at + i)
                        stay.update((at + others).tolist())
                if stay:
                    yield b.select(names).take(pa.array(sorted(stay)))

        return run

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in tiles_of(batches):
            a, b = links_of(held, looks[-1][0], width, num, den)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def in_tiles(df: DataFrame) -> DataFrame:
        return df.repartition(slots(spark), *TILE).sortWithinPartitions(*TILE, "node")

    left = worth_a_look(tables.stage(dealt_to_tiles(shared, roots, num, den, tables), "near-dealt"), num, den)
    # Where one side has lost its last row, the tile goes.
    left = worth_a_look(tables.stage(left, "near-dealt"), num, den) if "most" in shared.columns else left
    for make, pairs, columns in looks:
        left = tables.stage(in_tiles(left.join(classes.select("node", *columns), "node")).mapInArrow(survivors(make, pairs), own), "near-tiles")
    if left.isEmpty():
        return spark.createDataFrame([], "a long, b long")
    texts = tables.stage(texts_of(left, classes, rows, *looks[-1][2]), "near-texts")
    full = left.join(texts, "node")
    return tables.stage(in_tiles(full).mapInArrow(verify, "a long, b long").distinct(), "near-links")


def grouped(own: DataFrame, classes: DataFrame, roots: DataFrame, tables: Tables) -> DataFrame:
    """(doc_id, n, component_id) for the rows of `own`: the smallest id of their class's component; a row without a set is its own."""
    named = classes.select("set_key", "least_id", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = tables.stage(named.select("set_key", "root").join(least, "root").select("set_key", "component_id"), "near-named")
    full = own.where("n > 0").select("doc_id", "n", "set_key").join(named, "set_key").select("doc_id", "n", "component_id")
    return full.unionAll(own.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))


def reach_sql(width: int, num: int, den: int, kept: bool) -> str:
    """The same by comparing all pairs that share a shingle and following links until nothing is new, for DuckDB and small tables."""
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[ \\t-\\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + {width - 1}], ' ') for i in range(1, len(w) - {width - 2})] END) AS s FROM w),
e AS MATERIALIZED (SELECT doc_id, md5(unnest(s)) AS shingle FROM s),
n AS (SELECT doc_id, len(s) AS n FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE {den} * c >= {num} * (x.n + y.n - c)),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reach)
SELECT doc_id, any_value(n) AS n_shingles, min(reach) AS component_id{", doc_id = min(reach) AS kept" if kept else ""} FROM n JOIN r USING (doc_id) GROUP BY doc_id
"""
