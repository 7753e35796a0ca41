"""Shards cut from a Hilbert curve over metadata.

Each dimension is quantised to 2**BITS cells: strings and sizes by equal shares of rows (a
cell holds the values whose smaller values make up the same share), ids by equal width. The cells are
points of a Hilbert curve; rows are ordered along it, and runs of the order are the
shards, so a shard or file spans small ranges of several dimensions at once. Everything is
a DataFrame expression; the curve is walked by aggregate() over the bit planes with a table
of its states.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, slots, stage

BITS = 8
SHARDS = 8
DIMENSIONS = ("lang", "source", "size", "doc_id")


@cache
def curve(n: int) -> list[tuple[int, int]]:
    """For state*2**n + corner: the corner's place on the curve and the next state.

    A state is an entry corner e and a direction d, as e*n + d. The corner is turned by the state
    (xor e, rotate right by d+1) and its place is the inverse Gray code; the cell's own entry corner and
    direction give the next state.
    """
    full = (1 << n) - 1
    left = lambda x, k: ((x << k % n) | (x >> (n - k % n) % n if k % n else 0)) & full
    gray = lambda w: w ^ (w >> 1)
    places = {gray(w): w for w in range(1 << n)}
    ones = lambda w: ((w ^ (w + 1)).bit_length() - 1) % n  # noqa: E731  trailing ones
    entry = lambda w: 0 if w == 0 else gray(2 * ((w - 1) // 2))
    turn = lambda w: 0 if w == 0 else ones(w - 1) if w % 2 == 0 else ones(w)
    out = []
    for state in range(n << n):
        e, d = divmod(state, n)
        for corner in range(1 << n):
            w = places[left(corner ^ e, n - (d + 1) % n)]
            out.append((w, (e ^ left(entry(w), d + 1)) * n + (d + turn(w) + 1) % n))
    return out


def curve_index(cells: list[Column], bits: int = BITS) -> Column:
    """The place of a point with these coordinates on the Hilbert curve."""
    n = len(cells)
    places, states = (F.array(*[F.lit(x[k]) for x in curve(n)]) for k in range(2))
    corner = lambda k: sum((F.shiftright(c, k).bitwiseAND(F.lit(1)) * F.lit(1 << i) for i, c in enumerate(cells)), F.lit(0))
    corners = F.array(*[corner(k).cast("int") for k in range(bits - 1, -1, -1)])

    def step(acc: Column, x: Column) -> Column:
        at = acc["state"] * F.lit(1 << n) + x + 1
        return F.struct((acc["index"] * F.lit(1 << n) + F.element_at(places, at)).cast("long").alias("index"), F.element_at(states, at).cast("int").alias("state"))

    return F.aggregate(corners, F.struct(F.lit(0).cast("long").alias("index"), F.lit(0).alias("state")), step, lambda acc: acc["index"])


def in_order(df: DataFrame, *keys: Column) -> DataFrame:
    """df, written in the order of keys over all partitions, with `part` and `at`: a row's partition and place in it."""
    ordered = df.repartitionByRange(slots(df.sparkSession), *keys).sortWithinPartitions(*keys)
    numbered = ordered.withColumn("_n", F.monotonically_increasing_id())
    written = numbered.select("*", F.shiftright("_n", 33).cast("int").alias("part"), F.col("_n").bitwiseAND(F.lit((1 << 33) - 1)).alias("at")).drop("_n")
    return stage(written, "curve-order")[0]


def before(ordered: DataFrame, amount: Column) -> DataFrame:
    """(part, base): the amount in all parts before; a row for each part of in_order()."""
    totals = ordered.groupBy("part").agg(F.sum(amount).alias("amount"))
    return totals.select("part", (F.sum("amount").over(W.orderBy("part")) - F.col("amount")).alias("base"))


def equal_shares(rows: DataFrame, name: str, total: int, bits: int) -> DataFrame:
    """(name, cell): each value's cell of 2**bits, by the share of rows with smaller values; null is the smallest."""
    counts = in_order(rows.groupBy(name).agg(F.count("*").alias("rows")), F.col(name).asc_nulls_first())
    smaller = F.col("base") + F.sum("rows").over(W.partitionBy("part").orderBy("at")) - F.col("rows")
    return counts.join(before(counts, F.col("rows")), "part").select(name, F.floor(smaller * F.lit(1 << bits) / F.lit(max(1, total))).cast("int").alias(f"{name}_cell"))


def along_curve(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", string_dimensions: tuple[str, ...] = ("lang", "source"), bits: int = BITS) -> DataFrame:
    """(doc_id, size, text_crc32, the string dimensions, curve, rank): all rows, ranked along the curve from 0.

    size is the text's UTF-8 bytes plus 1; a null text has none and the crc32 of the empty one. A null id
    takes the first cell, a null dimension the smallest value. Rows of one cell follow each other by
    text crc32, so that equal texts lie together, then by id; repeated rows have ranks of their own. An
    empty table gives no rows. Columns other than those named are not read.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), *[docs[c].cast("string").alias(c) for c in string_dimensions])
    rows, _ = stage(rows, "curve-rows")
    total, low, high = rows.agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
    names = [*string_dimensions, "size"]
    for name in names:
        cells = equal_shares(rows, name, total, bits).withColumnRenamed(name, f"{name}_value")
        rows = rows.join(cells, rows[name].eqNullSafe(cells[f"{name}_value"])).drop(f"{name}_value")
    low, high = (low or 0), (high or 0)
    width = F.floor((F.col("doc_id").cast("decimal(38,0)") - F.lit(low)) * F.lit(1 << bits) / F.lit(high - low + 1)).cast("int")
    rows = rows.withColumn("curve", curve_index([*[F.col(f"{c}_cell") for c in names], F.coalesce(width, F.lit(0))], bits)).drop(*[f"{c}_cell" for c in names])
    ordered = in_order(rows, F.col("curve"), F.col("text_crc32"), F.col("doc_id").asc_nulls_first())
    return ordered.join(before(ordered, F.lit(1)), "part").withColumn("rank", (F.col("base") + F.col("at")).cast("long")).drop("part", "at", "base")


def cut(ranked: DataFrame, shards: int = SHARDS) -> DataFrame:
    """ranked, with shard and slot: runs of the order whose row counts differ by one at most."""
    total = max(1, ranked.count())
    shard = F.expr(f"cast(rank * {shards} div {total} as int)")
    return ranked.withColumn("shard", shard).withColumn("slot", F.col("rank") - F.expr(f"(cast(shard as bigint) * {total} + {shards - 1}) div {shards}"))


def write_shards(docs: DataFrame, out: str, shards: int = SHARDS, id_col: str = "doc_id") -> DataFrame:
    """Write the documents to folders shard=0.. of `out`, in the order of the curve, and return each shard's
    rows and its range in every dimension, which is what a reader prunes by. Ids must be unique here."""
    placed = cut(along_curve(docs, id_col), shards).select(F.col("doc_id").alias("_id"), "shard", "slot", F.col("size").alias("_size"))
    rows = docs.join(placed, docs[id_col].eqNullSafe(placed["_id"])).drop("_id")
    n = max(shards, slots(docs.sparkSession))
    rows.repartitionByRange(n, "shard", "slot").sortWithinPartitions("shard", "slot").drop("slot", "_size").write.partitionBy("shard").parquet(out)
    return rows.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("_size").alias("bytes"), *[f(c).alias(f"{label}_{c}") for c in ("lang", "source", id_col) for label, f in (("min", F.min), ("max", F.max))])


def op7_curve_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = cut(along_curve(documents(spark, sf_dir)))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
