"""Nearest neighbours, clustering, scaling and classification over array columns.

Quadratic operators take a query set and work on blocks: the rows are dealt to tasks, the
queries are collected up to QUERY_BYTES and sent along; more queries take more passes. No
pair of rows becomes a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import hash_uniform
from .select import at_ranks

QUERY_BYTES = 32 << 20


def passes(queries: DataFrame, width: int) -> int:
    return max(1, -(-queries.count() * (8 * width + 16) // QUERY_BYTES))


def width_of(df: DataFrame, vector: str) -> int:
    return int(df.agg(F.coalesce(F.max(F.size(vector)), F.lit(1))).first()[0])


def matrix(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 0))
    flat, ends = column.flatten(), pc.list_value_length(column)
    if column.null_count == flat.null_count == 0 and pc.min(ends) == pc.max(ends):
        return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return np.asarray(column.to_pylist(), np.float64)


def nearest(rows: DataFrame, queries: DataFrame, k: int, key: str = "id", vector: str = "v", extra: str | None = None, skip_self: bool = False) -> DataFrame:
    """(query, id, distance, place[, extra]) of each query's k nearest rows by Euclidean distance, ties by id.

    Each task keeps k rows for each query; those meet in a window of at most k rows per task and query."""
    width = width_of(queries, vector)
    n = passes(queries, width)
    keep = [c for c in (key, vector, extra) if c]
    kind = dict(rows.dtypes).get(extra, "int") if extra else "int"
    out = None
    for p in range(n):
        own = queries.where(F.pmod(F.xxhash64(key), F.lit(n)) == p).select(key, vector).collect()
        ids, q = [r[0] for r in own], np.asarray([r[1] for r in own], np.float64).reshape(len(own), -1)

        def run(batches: Iterator[pa.RecordBatch], ids=ids, q=q) -> Iterator[pa.RecordBatch]:
            best: list[list[tuple]] = [[] for _ in ids]
            for b in batches:
                for s in range(0, b.num_rows, 2000):
                    x = b.slice(s, 2000)
                    if not x.num_rows or not len(q):
                        continue
                    m, keys = matrix(x.column(vector)), x.column(key).to_pylist()
                    more = x.column(extra).to_pylist() if extra else [0] * len(keys)
                    for j in range(len(q)):
                        d = np.sqrt(((m - q[j]) ** 2).sum(1))
                        near = np.argpartition(d, k)[: k + 1] if len(d) > k + 1 else np.arange(len(d))
                        edge = d[near].max()
                        near = np.flatnonzero(d <= edge)
                        found = best[j] + [(float(d[i]), keys[i], more[i]) for i in near.tolist() if not (skip_self and keys[i] == ids[j])]
                        best[j] = sorted(found, key=lambda t: t[:2])[:k]
            flat = [(i, key_, d, e) for i, own in zip(ids, best, strict=True) for d, key_, e in own]
            if flat:
                cols = list(zip(*flat, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.int64() if kind in ("int", "bigint", "long") else pa.string())], ["query", "id", "distance", "extra"])

        found = rows.select(*keep).mapInArrow(run, f"query long, id long, distance double, extra {'long' if kind in ('int', 'bigint', 'long') else 'string'}")
        out = found if out is None else out.unionAll(found)
    placed = out.withColumn("place", F.row_number().over(W.partitionBy("query").orderBy("distance", "id"))).where(F.col("place") <= k)
    return placed if extra else placed.drop("extra")


def anomaly_scores(reference: DataFrame, queries: DataFrame, k: int, key: str = "id", vector: str = "v") -> DataFrame:
    """(id, score): mean distance to the k nearest reference rows; 0 without any. k is clamped to 1 at least."""
    near = nearest(reference, queries, max(1, k), key, vector).groupBy("query").agg(F.avg("distance").alias("score"))
    return queries.join(near, queries[key] == near["query"], "left").select(queries[key].alias("id"), F.coalesce("score", F.lit(0.0)).alias("score"))


def nearest_rank(df: DataFrame, value: str, q: float) -> float:
    """The value at place round(q * (n - 1)) in ascending order, halves up; 0 for none. Nulls and NaNs are passed over."""
    at = F.floor(F.lit(min(max(q, 0.0), 1.0)) * (F.col("n") - 1) + 0.5)
    found = at_ranks(df, [], value, {"at": at}).first()
    return found["at"] if found and found["at"] is not None else 0.0


def f1(df: DataFrame, label: str, predicted: str) -> DataFrame:
    tp, fp, fn = F.count_if(F.col(label) & F.col(predicted)), F.count_if(~F.col(label) & F.col(predicted)), F.count_if(F.col(label) & ~F.col(predicted))
    whole = 2 * tp + fp + fn
    return df.agg(F.when(whole > 0, 2 * tp / whole).otherwise(0.0).alias("f1"))


def statistics(df: DataFrame, vector: str = "v") -> DataFrame:
    """(pos, mean, std, low, high) of each coordinate; the population's deviation."""
    each = df.select(F.posexplode(vector).alias("pos", "x"))
    x = F.col("x").cast("double")
    return each.groupBy("pos").agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("low"), F.max(x).alias("high"))


def fit_scaling(train: DataFrame, how: str, vector: str = "v") -> list[tuple[float, float]]:
    """(shift, scale) of each coordinate, from training rows only: mean and deviation, or minimum and span, each
    scale 1e-6 at least; none shifts by 0 and scales by 1."""
    if how == "none":
        return [(0.0, 1.0)] * width_of(train, vector)
    rows = statistics(train, vector).orderBy("pos").collect()  # a row per coordinate
    if how == "standardize":
        return [(r["mean"], max(r["std"], 1e-6)) for r in rows]
    if how == "normalize":
        return [(r["low"], max(r["high"] - r["low"], 1e-6)) for r in rows]
    raise ValueError(f"no such scaling: {how}")


def scaled(vector: str, scaling: list[tuple[float, float]]):
    shift, scale = (F.array(*[F.lit(float(x[k])) for x in scaling]) for k in range(2))
    return F.zip_with(F.zip_with(vector, shift, lambda x, s: x.cast("double") - s), scale, lambda x, s: x / s)


def centroids(df: DataFrame, label: str, vector: str = "v") -> DataFrame:
    """(label, centroid): the mean of each class."""
    means = df.select(F.col(label).alias("label"), F.posexplode(vector).alias("pos", "x")).groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centroid"))


def assign(df: DataFrame, centers: list[tuple[int, list[float]]], vector: str = "v") -> DataFrame:
    """df with `cluster` and `d2`: the nearest centre, the first of equally near ones. Centres are as few as
    classes or clusters."""
    from ..functions.columns import squared_distance

    table = F.array(*[F.struct(squared_distance(F.col(vector), F.array(*[F.lit(float(x)) for x in c])).alias("d2"), F.lit(i).alias("cluster")) for i, c in centers])
    return df.withColumn("_best", F.array_min(table)).withColumn("cluster", F.col("_best.cluster")).withColumn("d2", F.col("_best.d2")).drop("_best")


def centroid_accuracy(train: DataFrame, test: DataFrame, label: str, vector: str = "v") -> float:
    """Percent of test rows whose nearest class mean has their label; ties go to the smallest label."""
    centers = [(r["label"], list(r["centroid"])) for r in centroids(train, label, vector).orderBy("label").collect()]
    if not centers:
        return 0.0
    return assign(test, centers, vector).agg(F.coalesce(F.avg((F.col("cluster") == F.col(label)).cast("double")) * 100, F.lit(0.0))).first()[0]


def knn_predictions(train: DataFrame, test: DataFrame, k: int, label: str, key: str = "id", vector: str = "v") -> DataFrame:
    """(id, predicted): the majority of the k nearest training rows; distance ties by id, vote ties to the
    largest label."""
    near = nearest(train, test, k, key, vector, extra=label)
    votes = near.groupBy("query", "extra").agg(F.count("*").alias("n"))
    return votes.groupBy("query").agg(F.max_by("extra", F.struct("n", "extra")).alias("predicted")).select(F.col("query").alias("id"), "predicted")


def lloyd_step(df: DataFrame, centers: list[list[float]], vector: str = "v") -> tuple[list[list[float]], float, bool]:
    """(new centres, inertia, whether any moved); a cluster without points keeps its centre."""
    assigned = assign(df, list(enumerate(centers)), vector)
    sums = assigned.select("cluster", F.posexplode(vector).alias("pos", "x")).groupBy("cluster", "pos").agg(F.avg(F.col("x").cast("double")).alias("m")).collect()  # clusters x coordinates
    inertia = assigned.agg(F.coalesce(F.sum("d2"), F.lit(0.0))).first()[0]
    out = [list(c) for c in centers]
    for r in sums:
        out[r["cluster"]][r["pos"]] = r["m"]
    return out, inertia, out != [list(c) for c in centers]


def kmeans(df: DataFrame, k: int, seed: int = 0, iterations: int = 50, key: str = "id", vector: str = "v") -> tuple[DataFrame, list[list[float]], float]:
    """(assignments, centres, inertia): centres drawn by squared distance, then Lloyd's rounds until nothing
    moves. A draw is the row with the largest u ** (1 / d2), u by hash of its id."""
    from ..functions.columns import hash_uniform as u

    first = df.orderBy(u(seed, F.col(key), F.lit(0))).select(vector).head()
    if first is None:
        return df.withColumn("cluster", F.lit(0)), [], 0.0
    centers = [list(map(float, first[0]))]
    while len(centers) < k:
        near = assign(df, list(enumerate(centers)), vector)
        weight = F.log(F.greatest(u(seed, F.col(key), F.lit(len(centers))), F.lit(1e-300))) / F.col("d2")
        drawn = near.where("d2 > 0").orderBy(F.desc(weight), key).select(vector).head()
        centers.append(list(map(float, drawn[0])) if drawn else list(centers[0]))
    inertia = 0.0
    for _ in range(iterations):
        centers, inertia, moved = lloyd_step(df, centers, vector)
        if not moved:
            break
    out = assign(df, list(enumerate(centers)), vector)
    return out, centers, out.agg(F.sum("d2")).first()[0]


def distances(rows: np.ndarray, q: np.ndarray, square: np.ndarray) -> np.ndarray:
    """Euclidean distances by one product of matrices; those of near pairs, where that would lose digits, from differences. square: the queries' squared lengths."""
    own = (rows * rows).sum(1)
    d2 = np.c_[-2.0 * rows, own, np.ones(len(rows))] @ np.c_[q, np.ones(len(q)), square].T
    if d2.size and not d2.min() > 1e-6 * (own.max() + square.max()):
        near = ~(d2 > 1e-6 * (own[:, None] + square))
        for i in np.flatnonzero(near.any(1)):
            d2[i, near[i]] = ((q[near[i]] - rows[i]) ** 2).sum(1)
    return np.sqrt(d2, out=d2)


def silhouette(df: DataFrame, cluster: str, key: str = "id", vector: str = "v", queries: DataFrame | None = None) -> float:
    """The mean silhouette by Euclidean distance of the query rows (all by default) against all rows. Clusters of
    one row are left out; 0 if nothing remains. A task sends a row per query and cluster."""
    queries = df if queries is None else queries
    n = passes(queries, width_of(df, vector))
    sums = None
    for p in range(n):
        own = queries.where(F.pmod(F.xxhash64(key), F.lit(n)) == p).select(key, vector).collect()
        ids, q = np.asarray([r[0] for r in own], np.int64), np.asarray([r[1] for r in own], np.float64).reshape(len(own), -1)

        def run(batches: Iterator[pa.RecordBatch], ids=ids, q=q) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            square = (q * q).sum(1)
            for b in batches:
                for s in range(0, b.num_rows, 256):
                    x = b.slice(s, 256)
                    m, labels = matrix(x.column(vector)), x.column(cluster).to_numpy(zero_copy_only=False)
                    for c in np.unique(labels):
                        own = m[labels == c]
                        if c not in total:
                            total[c] = np.zeros(len(q))
                        # A block of queries that stays in the processor's cache.
                        for k in range(0, len(q), 1024):
                            total[c][k : k + 1024] += distances(own, q[k : k + 1024], square[k : k + 1024]).sum(0)
            for c, d in total.items():
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([int(c)] * len(ids), pa.int64()), pa.array(d)], ["id", "cluster", "d"])

        part = df.select(F.col(vector), F.col(cluster)).mapInArrow(run, "id long, cluster long, d double")
        sums = part if sums is None else sums.unionAll(part)
    sizes = df.groupBy(F.col(cluster).cast("long").alias("cluster")).agg(F.count("*").alias("size"))
    each = sums.groupBy("id", "cluster").agg(F.sum("d").alias("d")).join(F.broadcast(sizes), "cluster")
    mine = queries.select(F.col(key).alias("id"), F.col(cluster).cast("long").alias("mine"))
    joined = each.join(mine, "id").groupBy("id").agg(F.max(F.when((F.col("cluster") == F.col("mine")) & (F.col("size") > 1), F.col("d") / (F.col("size") - 1))).alias("a"), F.min(F.when(F.col("cluster") != F.col("mine"), F.col("d") / F.col("size"))).alias("b"))
    s = F.when(F.greatest("a", "b") > 0, (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(0.0)
    return joined.where("a is not null and b is not null").agg(F.coalesce(F.avg(s), F.lit(0.0))).first()[0]


def split(df: DataFrame, share: float, seed: int, key: str = "id") -> DataFrame:
    """df with `held_out`: clamp(round(n * share), 1, n - 1) rows, drawn by hash of the key."""
    n = df.count()
    tail = max(1, min(n - 1, int(np.floor(n * share + 0.5))))
    order = hash_uniform(seed, F.col(key))
    edge = df.select(order.alias("u")).orderBy(F.desc("u")).limit(tail).agg(F.min("u")).first()[0] if n else None
    return df.withColumn("held_out", order >= F.lit(edge) if edge is not None else F.lit(False))
