"""Dominance, fronts, ranks, crowding and hypervolume over objective vectors.

Input frames have (group, id, o0, o1, ...) with every objective turned so that smaller is better
(`objectives` does that). Two objectives take one sorted pass; with more, points are dealt to a grid of cells, cells that
another cell dominates go as a whole, and points meet those of cells that can hold a dominating one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import hash_uniform
from ..plans.scratch import slots, stage
from ..schema import sign
from .scan import cut, lag, lead, place, running, scan
from .select import matched


def objectives(df: DataFrame, group: str, key: str, columns: list[tuple[str, str]]) -> DataFrame:
    """(group, id, o0, ...), larger-is-better objectives negated; rows that lack one are left out."""
    values = [(F.lit(float(sign(d))) * F.col(c).cast("double")).alias(f"o{k}") for k, (c, d) in enumerate(columns)]
    return df.select(F.col(group).alias("group"), F.col(key).alias("id"), *values).dropna(subset=[f"o{k}" for k in range(len(columns))])


def names(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c[0] == "o" and c[1:].isdigit()]


def dominates(a: list[Column], b: list[Column]) -> Column:
    """a is nowhere worse than b and somewhere better; false if an objective is missing."""
    nowhere = reduce(lambda x, y: x & y, [p <= q for p, q in zip(a, b, strict=True)])
    somewhere = reduce(lambda x, y: x | y, [p < q for p, q in zip(a, b, strict=True)])
    return F.coalesce(nowhere & somewhere, F.lit(False))


def distinct_points(points: DataFrame) -> DataFrame:
    """Of equal vectors the one with the smallest id."""
    return points.groupBy("group", *names(points)).agg(F.min("id").alias("id"))


def front(points: DataFrame) -> DataFrame:
    """Non-dominated points; of equal ones the smallest id."""
    own = names(points)
    unique = distinct_points(points)
    if len(own) == 1:
        least = W.partitionBy("group")
        return unique.withColumn("_m", F.min("o0").over(least)).where("o0 = _m").drop("_m")
    if len(own) == 2:
        # Of one o0 only the least o1 can stay; those meet before the window.
        steps = unique.groupBy("group", "o0").agg(F.min(F.struct("o1", "id")).alias("s")).select("group", "o0", "s.*")
        before = W.partitionBy("group").orderBy("o0").rowsBetween(W.unboundedPreceding, -1)
        return steps.withColumn("_m", F.min("o1").over(before)).where("_m is null or o1 < _m").drop("_m")
    return cell_front(unique)


#: A group's grid has so many cells at most.
CELLS = 4096


def with_cells(points: DataFrame) -> DataFrame:
    """points with `cell`, the places on a grid over their group's bounds; a point that is better in an objective is in no later place of it."""
    own = names(points)
    side = max(2, int(CELLS ** (1 / len(own)) + 1e-9))
    bounds = points.groupBy(F.col("group").alias("_g")).agg(*[F.min(c).alias(f"_low_{c}") for c in own], *[F.max(c).alias(f"_high_{c}") for c in own])
    at = lambda c: F.when(F.col(c) == F.col(f"_high_{c}"), side - 1).otherwise(F.least(F.floor((F.col(c) - F.col(f"_low_{c}")) / (F.col(f"_high_{c}") - F.col(f"_low_{c}")) * side), F.lit(side - 1))).cast("int")
    joined = points.join(bounds, points["group"].eqNullSafe(bounds["_g"]))
    return joined.select(*points.columns, F.array(*[at(c) for c in own]).alias("cell"))


def cell_front(unique: DataFrame) -> DataFrame:
    """The front of distinct points. Points of one cell meet in parts first, then in the cell, then in later cells that no cell
    dominates and that do not lie beyond them in every objective."""
    own = names(unique)
    placed = with_cells(unique)
    places = placed.select("group", "cell").distinct()
    other = places.select(F.col("group").alias("_g"), F.col("cell").alias("_c"))
    every = lambda a, b, how: F.forall(F.zip_with(a, b, how), lambda x: x)
    better = other["_g"].eqNullSafe(places["group"]) & every(other["_c"], places["cell"], lambda x, y: x < y)
    alive = stage(places.join(other, better, "left_anti"), "front-cells")
    salted = stage(placed.join(alive.select(F.col("group").alias("_g"), F.col("cell").alias("_c")), placed["group"].eqNullSafe(F.col("_g")) & (F.col("cell") == F.col("_c")), "left_semi").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64))), "front-points")
    local = beaten(salted, salted, ["group", "cell", "part"]).drop("part")
    local = stage(beaten(local, local, ["group", "cell"]), "front-local")
    # Which cells a cell's points are told to: those that are nowhere before it.
    after = alive.select(F.col("group").alias("_g"), F.col("cell").alias("_c"))
    told = alive.join(after, alive["group"].eqNullSafe(after["_g"]) & (alive["cell"] != after["_c"]) & every(alive["cell"], after["_c"], lambda x, y: x <= y)).select("group", "cell", F.col("_c").alias("to"))
    t = told.select(F.col("group").alias("_g"), F.col("cell").alias("_c"), "to")
    rivals = local.join(t, local["group"].eqNullSafe(t["_g"]) & (local["cell"] == t["_c"])).select("group", F.col("to").alias("cell"), *own)
    return beaten(local, rivals, ["group", "cell"]).select(*unique.columns)


def beaten(points: DataFrame, rivals: DataFrame, keys: list[str]) -> DataFrame:
    """Points that no rival with the same keys dominates."""
    own = names(points)
    other = rivals.select(*[F.col(k).alias(f"r_{k}") for k in keys], *[F.col(c).alias(f"r_{c}") for c in own])
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in keys])
    return points.join(other, same & dominates([F.col(f"r_{c}") for c in own], [F.col(c) for c in own]), "left_anti")


def ranks(points: DataFrame) -> DataFrame:
    """(group, id, o0, ..., rank): fronts peeled one after another, equal vectors in the same one. Two objectives take one pass
    (chain_ranks), others a peel for each front."""
    own, unique = names(points), distinct_points(points)
    if len(own) == 2:
        found = chain_ranks(unique)
    else:
        rest, found, rank = stage(unique, "ranks"), None, 0
        while not rest.isEmpty():
            top = front(rest).withColumn("rank", F.lit(rank))
            found = top if found is None else found.unionByName(top)
            rest = stage(rest.join(top.select("group", "id"), ["group", "id"], "left_anti"), "ranks")
            rank += 1
        if found is None:
            return points.withColumn("rank", F.lit(None).cast("int"))
    return matched(points, found.select("group", *own, "rank"), ["group", *own])


def chain_ranks(unique: DataFrame) -> DataFrame:
    """(group, o0, o1, rank) of distinct points with two objectives: the longest chain of points that dominate each.

    In the order of (o0, o1) the least o1 of each rank so far rises with the rank, so a point's rank is found by bisection. Groups are cut
    into ranges; a range goes on with the least values that the one before it has left, so a group takes as many steps as it has ranges, and all
    groups take them together. What is handed on has eight bytes for each front of the group."""
    import bisect

    import pyarrow as pa

    kind = dict(unique.dtypes)["group"]
    rows = cut(unique.select("group", "o0", "o1"), ["group"], ["o0", "o1"])
    parts = rows.select("group", "_part").distinct()
    steps = parts.withColumn("_step", F.row_number().over(W.partitionBy("group").orderBy("_part")))
    rows = stage(matched(rows, steps, ["group", "_part"]).drop("_part"), "ranks-steps")
    last = rows.agg(F.coalesce(F.max("_step"), F.lit(0))).first()[0]
    schema = f"group {kind}, o0 double, o1 double, rank int, left binary"

    def run(batches):
        import numpy as np

        group, least, seen = None, [], False

        def leave(b, out):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (b.schema.field("group").type, pa.float64(), pa.float64(), pa.int32(), pa.binary()), strict=True)], ["group", "o0", "o1", "rank", "left"])

        for b in batches:
            out = []
            for g, x, y, before in zip(*(b.column(c).to_pylist() for c in ("group", "o0", "o1", "left")), strict=True):
                if not seen or g != group:
                    if seen:
                        out.append((group, None, None, None, np.asarray(least).tobytes()))
                    group, least, seen = g, [], True
                if before is not None:
                    least = np.frombuffer(before).tolist()
                    continue
                r = bisect.bisect_right(least, y)
                if r == len(least):
                    least.append(y)
                else:
                    least[r] = y
                out.append((g, x, y, r, None))
            if out:
                yield leave(b, out)
        if seen:
            yield leave(b, [(group, None, None, None, np.asarray(least).tobytes())])

    left, found = None, None
    for step in range(1, last + 1):
        own = rows.where(F.col("_step") == step).select("group", "o0", "o1", F.lit(None).cast("binary").alias("left"), F.lit(1).alias("kind"))
        own = own if left is None else own.unionByName(matched(left, own.select("group").distinct(), ["group"]).withColumn("kind", F.lit(0)))
        ordered = own.repartition(slots(unique.sparkSession), "group").sortWithinPartitions("group", "kind", "o0", "o1")
        done = stage(ordered.select("group", "o0", "o1", "left").mapInArrow(run, schema), "ranks-found")
        left = done.where("rank is null").select("group", "o0", "o1", "left")
        ranked = done.where("rank is not null").select("group", "o0", "o1", "rank")
        found = ranked if found is None else found.unionByName(ranked)
    return unique.select("group", "o0", "o1").withColumn("rank", F.lit(None).cast("int")) if found is None else found


def crowding(ranked: DataFrame) -> DataFrame:
    """(.., crowding): summed over objectives, the distance of a point's neighbours in its rank over the rank's
    span; the ends have infinity, and so has a rank of two or fewer."""
    own = names(ranked)
    spans = ranked.groupBy("group", "rank").agg(F.count("*").alias("_n"), *[F.greatest(F.max(c) - F.min(c), F.lit(1e-12)).alias(f"_span_{c}") for c in own])
    out, total = ranked, F.lit(0.0)
    for c in own:
        out = scan(out, ["group", "rank"], [c, "id"], {f"_before_{c}": lag(c), f"_after_{c}": lead(c)})
        total = total + F.coalesce((F.col(f"_after_{c}") - F.col(f"_before_{c}")) / F.col(f"_span_{c}"), F.lit(float("inf")))
    crowded = matched(out, spans, ["group", "rank"]).withColumn("crowding", F.when(F.col("_n") <= 2, F.lit(float("inf"))).otherwise(total))
    return crowded.select(*ranked.columns, "crowding")


def elite(crowded: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("group").orderBy("rank", F.desc("crowding"), "id")
    return crowded.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def hypervolume(points: DataFrame, reference: list[float], samples: int = 20_000, seed: int = 0) -> DataFrame:
    """(group, hypervolume) of the points that lie inside the reference, exact for one and two objectives and
    by hash-drawn samples for more."""
    own = names(points)
    inside = points.where(reduce(lambda x, y: x & y, [F.col(c) < r for c, r in zip(own, reference, strict=True)]))
    groups = points.select("group").distinct()
    if len(own) == 1:
        found = inside.groupBy("group").agg(F.max(F.lit(reference[0]) - F.col("o0")).alias("hypervolume"))
    elif len(own) == 2:
        before = W.partitionBy("group").orderBy("o0").rowsBetween(W.unboundedPreceding, -1)
        found = front(inside).withColumn("top", F.coalesce(F.min("o1").over(before), F.lit(reference[1])))
        found = found.groupBy("group").agg(F.sum((F.lit(reference[0]) - F.col("o0")) * (F.col("top") - F.col("o1"))).alias("hypervolume"))
    else:
        # The front is what matters, and a group's samples are as many whatever its size.
        best = front(inside)
        ideal = best.groupBy("group").agg(*[F.min(c).alias(f"low_{c}") for c in own])
        drawn = ideal.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
        drawn = drawn.select("group", "sample", *[(F.col(f"low_{c}") + hash_uniform(seed, F.col("sample"), F.lit(c)) * (F.lit(r) - F.col(f"low_{c}"))).alias(f"s_{c}") for c, r in zip(own, reference, strict=True)])
        at = best.select(F.col("group").alias("g"), *own)
        hit = drawn.join(at, (F.col("group") == F.col("g")) & reduce(lambda x, y: x & y, [F.col(c) <= F.col(f"s_{c}") for c in own]), "left_semi")
        box = reduce(lambda x, y: x * y, [F.lit(r) - F.col(f"low_{c}") for c, r in zip(own, reference, strict=True)])
        share = hit.groupBy("group").agg((F.count("*") / samples).alias("share"))
        found = ideal.join(share, "group", "left").select("group", (F.coalesce("share", F.lit(0.0)) * box).alias("hypervolume"))
    return groups.join(found, "group", "left").select("group", F.coalesce("hypervolume", F.lit(0.0)).alias("hypervolume"))


#: Points that a sample meets together.
BLOCK = 512


def hypervolume_history_sampled(points: DataFrame, reference: list[float], samples: int = 20_000, seed: int = 0) -> DataFrame:
    """(group, id, hypervolume): the volume of all points up to this id, for any number of objectives, by the share of hash-drawn samples.

    A group's samples lie between its ideal point and the reference at all times. Each sample has one number, the least id that dominates it,
    and volumes of all prefixes come from counts of those. A point with an earlier one that is as good everywhere is first for no
    sample, so only the front with the id as one more objective meets the samples, in blocks. Points outside the reference add nothing."""
    own = names(points)
    inside = points.where(reduce(lambda x, y: x & y, [F.col(c) < r for c, r in zip(own, reference, strict=True)]))
    firsts = stage(front(inside.withColumn(f"o{len(own)}", F.col("id").cast("double"))), "volume-firsts")
    ideal = inside.groupBy("group").agg(*[F.min(c).alias(f"low_{c}") for c in own])
    drawn = ideal.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    drawn = drawn.select("group", "sample", *[(F.col(f"low_{c}") + hash_uniform(seed, F.col("sample"), F.lit(c)) * (F.lit(r) - F.col(f"low_{c}"))).alias(f"s_{c}") for c, r in zip(own, reference, strict=True)])
    placed = scan(firsts, ["group"], ["id"], {"_place": place()})
    blocks = placed.groupBy("group", F.floor((F.col("_place") - 1) / BLOCK).alias("_block")).agg(F.collect_list(F.struct("id", *own)).alias("_b"))
    under = lambda p: reduce(lambda x, y: x & y, [p[c] <= F.col(f"s_{c}") for c in own])
    first = F.array_min(F.transform(F.filter("_b", under), lambda p: p["id"]))
    hit = matched(drawn, blocks, ["group"]).select("group", "sample", first.alias("id")).where("id is not null").groupBy("group", "sample").agg(F.min("id").alias("id"))
    counts = hit.groupBy("group", "id").agg(F.count("*").alias("_hits"))
    each = matched(points.select("group", "id"), counts, ["group", "id"], "left").withColumn("_hits", F.coalesce("_hits", F.lit(0)))
    curve = scan(each, ["group"], ["id"], {"_sum": running("sum", "_hits")})
    volume = reduce(lambda x, y: x * y, [F.lit(r) - F.col(f"low_{c}") for c, r in zip(own, reference, strict=True)], F.col("_sum") / samples)
    found = matched(curve, ideal, ["group"], "left")
    return found.select("group", "id", F.coalesce(volume, F.lit(0.0)).alias("hypervolume"))


def hypervolume_history(points: DataFrame, reference: tuple[float, float]) -> DataFrame:
    """(group, id, hypervolume): the volume of all points up to this id, for two objectives.

    A group's points arrive in the order of ids and one front is kept, so each costs a search instead of a
    sweep over all before it. The front of a group is held by one task, its points are streamed."""
    import bisect

    import pyarrow as pa

    rx, ry = reference

    def run(batches):
        group, xs, ys, volume = object(), [], [], 0.0
        for b in batches:
            out = []
            for g, i, x, y in zip(*(b.column(c).to_pylist() for c in ("group", "id", "o0", "o1")), strict=True):
                if g != group:
                    group, xs, ys, volume = g, [], [], 0.0
                if x < rx and y < ry:
                    k = bisect.bisect_right(xs, x)
                    top = ys[k - 1] if k else ry
                    if y < top:
                        first = k - 1 if k and xs[k - 1] == x else k
                        left, roof, at = x, top, k
                        while at < len(xs) and ys[at] >= y:
                            volume += (xs[at] - left) * (roof - y)
                            left, roof, at = xs[at], ys[at], at + 1
                        volume += ((xs[at] if at < len(xs) else rx) - left) * (roof - y)
                        xs[first:at], ys[first:at] = [x], [y]
                out.append(volume)
            yield pa.RecordBatch.from_arrays([b.column("group"), b.column("id"), pa.array(out, pa.float64())], ["group", "id", "hypervolume"])

    kinds = dict(points.dtypes)
    ordered = points.select("group", "id", "o0", "o1").repartition("group").sortWithinPartitions("group", "id")
    return ordered.mapInArrow(run, f"group {kinds['group']}, id {kinds['id']}, hypervolume double")
