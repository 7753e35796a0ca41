"""Kernel densities over many studies: how likely a value is among good trials, against bad ones.

The components of a study's density are one per trial and a wide one in the middle. Those of one width whose means share a cell, an
eighth of a width wide, are summed up as powers of their distance to its middle, from which their sum at a
candidate up to REACH widths away follows to double precision. Packs of candidates meet blocks of cells; each candidate keeps two numbers
for a block, the largest exponent and the sum of what is left, which add up over blocks in any order. A study of any
size has as many cells as its range holds widths, so work grows with candidates and trials, not with their product.
Where cells beyond REACH could matter, in ranges that are nearly empty, a candidate meets the components one by one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import scratch
from .scan import lag, lead, place, scan, size
from .select import matched

#: Cells of a block, and candidates of a pack, about.
BLOCK, PACK = 1024, 2048
#: Cells of a width; how many widths from its middle a cell's powers are exact enough; the highest power.
CELLS, REACH, POWERS = 8, 12.0, 16


def bandwidths(df: DataFrame, keys: list[str], value: str, tie: str, least: float, most: float, name: str = "sigma") -> DataFrame:
    """df with `sigma`: the gap to the nearer neighbour in the group, between least and most; most where there is none."""
    found = scan(df, keys, [value, tie], {"_before": lag(value), "_after": lead(value), "_place": place()})
    gap = F.least(F.col(value) - F.col("_before"), F.col("_after") - F.col(value))
    return found.withColumn(name, F.least(F.greatest(F.coalesce(gap, F.lit(most)), F.lit(least)), F.lit(most))).drop("_before", "_after")


def parzen(df: DataFrame, keys: list[str], value: str, low: float, high: float) -> DataFrame:
    """(keys, mu, sigma, _place) of each group: its values, with gaps to their neighbours as widths between a hundredth of the range and the
    range, and one component as wide as the range in its middle. Null and NaN values are left out; a group without
    others has the middle one only."""
    span, mid = max(high - low, 1e-12), (low + high) / 2
    x = F.col(value).cast("double")
    own = df.where(x.isNotNull() & ~F.isnan(x)).select(*keys, x.alias("mu"), F.lit(1).alias("_tie"))
    prior = df.select(*keys).distinct().select(*keys, F.lit(mid).alias("mu"), F.lit(0).alias("_tie"))
    found = bandwidths(own.unionByName(prior), keys, "mu", "_tie", span / 100, span)
    return found.select(*keys, "mu", F.when(F.col("_tie") == 0, F.lit(span)).otherwise(F.col("sigma")).alias("sigma"), "_place")


def dealt(df: DataFrame, keys: list[str], by: list[str], size: int, name: str) -> DataFrame:
    """df with `name`: a number within the group, shared by about `size` rows of those that `by` tells apart."""
    counted = df.groupBy(*keys).agg(F.ceil(F.count("*") / size).alias("_parts"))
    return matched(df, counted, keys).withColumn(name, F.pmod(F.xxhash64(*by), F.col("_parts"))).drop("_parts")


def cells(components: DataFrame, keys: list[str], powers: int) -> DataFrame:
    """(keys, center, sigma, n, m): components of one width near each other; m[k] sums exp(-d * d / 2) * d ** k / k! over their distances d to
    the centre, in widths. With powers = 0, components that are equal."""
    at = F.col("mu") / F.col("sigma")
    inside = (F.abs(at) < float(1 << 40)) if powers else F.lit(False)
    center = F.when(inside, (F.floor(at * CELLS) + 0.5) * F.col("sigma") / CELLS).otherwise(F.col("mu"))
    d = F.when(F.col("center") == F.col("mu"), F.lit(0.0)).otherwise((F.col("mu") - F.col("center")) / F.col("sigma"))
    placed = components.select(*keys, "mu", "sigma", center.alias("center")).withColumn("_d", d).withColumn("_w", F.exp(-0.5 * F.col("_d") * F.col("_d")))
    power = lambda k: F.lit(1.0) if k == 0 else F.pow(F.col("_d"), F.lit(float(k))) / float(math.factorial(k))
    sums = [F.sum(F.col("_w") * power(k)) for k in range(powers + 1)]
    return placed.groupBy(*keys, "center", "sigma").agg(F.count("*").alias("n"), F.array(*sums).alias("m"))


def sums_at(x: np.ndarray, center: np.ndarray, sigma: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each candidate the largest exponent, the sum of the cells' parts over it, and the logarithm of what cells out of reach add at most."""
    top, total, far = (np.full(len(x), -np.inf) for _ in range(3))
    scale, most = np.log(sigma * math.sqrt(2 * math.pi)), np.log(n) + math.log(len(n))
    for s in range(0, len(x), 256):
        own = slice(s, s + 256)
        u = (x[own, None] - center) / sigma
        e = -0.5 * u * u - scale
        near = np.abs(u) <= REACH if m.shape[1] > 1 else np.ones(u.shape, bool)
        beyond = -0.5 * (np.abs(u) - 0.5 / CELLS) ** 2 - scale + most
        far[own] = np.where(near, -np.inf, beyond).max(1)
        e = np.where(near, e, -np.inf)
        top[own] = e.max(1)
        part = np.broadcast_to(m[:, -1], u.shape)
        for k in range(m.shape[1] - 2, -1, -1):
            part = part * u + m[:, k]
        total[own] = (np.exp(e - np.where(np.isfinite(top[own]), top[own], 0.0)[:, None]) * np.where(near, part, 0.0)).sum(1)
    return top, total, far


def log_sums(at: DataFrame, components: DataFrame, keys: list[str], key: str, powers: int) -> DataFrame:
    """(keys, key, _v, _far): the logarithm of the sum of a study's components at each candidate, and of what was out of reach at most."""
    made = dealt(cells(components, keys, powers), keys, ["center", "sigma"], BLOCK, "_block")
    blocks = made.groupBy(*keys, "_block").agg(F.collect_list(F.struct("center", "sigma", "n", "m")).alias("_c"))
    packs = dealt(at, keys, [key], PACK, "_pack").groupBy(*keys, "_pack").agg(F.collect_list(F.struct(key, "_x")).alias("_q"))
    met = matched(packs, blocks, keys).repartition(scratch.slots(at.sparkSession), *keys, "_pack", "_block")
    fields = [at.schema[c] for c in [*keys, key]] + [T.StructField(c, T.DoubleType()) for c in ("_top", "_s", "_far")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                one = b.slice(r, 1)
                ids, x = one.column("_q").flatten().flatten()
                center, sigma, n, m = one.column("_c").flatten().flatten()
                number = lambda column: column.to_numpy(zero_copy_only=False).astype(np.float64)
                found = sums_at(number(x), number(center), number(sigma), number(n), number(m.flatten()).reshape(len(n), -1))
                shared = [one.column(c).take(pa.array(np.zeros(len(ids), np.int64))) for c in keys]
                yield pa.RecordBatch.from_arrays([*shared, ids, *map(pa.array, found)], [f.name for f in fields])

    each = met.select(*keys, "_q", "_c").mapInArrow(run, T.StructType(fields))
    # Sums of different blocks are brought to the largest exponent of all.
    own = W.partitionBy(*keys, key)
    whole = each.withColumns({"_most": F.max("_top").over(own), "_blocks": F.count("*").over(own)})
    part = F.when(F.col("_s") == 0, 0.0).otherwise(F.col("_s") * F.exp(F.col("_top") - F.col("_most")))
    return whole.groupBy(*keys, key).agg((F.first("_most") + F.log(F.sum(part))).alias("_v"), (F.max("_far") + F.log(F.first("_blocks"))).alias("_far"))


def log_density(candidates: DataFrame, components: DataFrame, keys: list[str], key: str, value: str, name: str) -> DataFrame:
    """candidates, which `key` tells apart within their group, with the logarithm of the density at `value`; null without components
    or a value."""
    components = scratch.stage(components.select(*keys, "mu", "sigma"), "density-components")
    at = scratch.stage(candidates.select(*keys, key, F.col(value).cast("double").alias("_x")).where("_x is not null"), "density-candidates")
    found = scratch.stage(log_sums(at, components, keys, key, POWERS), "density-sums")
    # What is left out is below the rounding of the sum, or the candidate comes again.
    settled = F.coalesce(F.col("_far") < F.col("_v") - 36, F.lit(False))
    again = found.where(~settled).select(*keys, key)
    if not again.isEmpty():
        found = found.where(settled).unionByName(log_sums(matched(at, again, [*keys, key]), components, keys, key, 0))
    counted = components.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = matched(found, counted, keys).select(*keys, key, (F.col("_v") - F.log("_n")).alias(name))
    return matched(candidates, total, [*keys, key], "left")


def good_and_bad(trials: DataFrame, keys: list[str], score: str, trial: str, gamma: float = 0.25) -> DataFrame:
    """trials with `good`: the best ceil(gamma * n) of each study by a score where smaller is better, one at least, 25 and n - 1 at most. NaN
    comes last, ties go by trial."""
    ordered = scan(trials, keys, [F.isnan(score), F.col(score), F.col(trial)], {"_place": place(), "_n": size()})
    g = min(max(gamma, 0.01), 0.99)
    n = F.least(F.lit(25), F.greatest(F.ceil(F.col("_n") * g), F.lit(1)), F.col("_n") - 1)
    return ordered.withColumn("good", F.col("_place") <= n).drop("_place", "_n")


def tpe_scores(candidates: DataFrame, trials: DataFrame, keys: list[str], key: str, value: str, score: str, trial: str, low: float, high: float, gamma: float = 0.25) -> DataFrame:
    """candidates with `l`, `g` and `gain` = l - g: the log densities among good and bad trials of their study, for a parameter on [low, high] (its
    logarithm, where the scale is one). Null for a study without trials."""
    parted = good_and_bad(trials, keys, score, trial, gamma)
    out = log_density(candidates, parzen(parted.where("good"), keys, value, low, high), keys, key, value, "l")
    # A study whose only trial is bad has no good density, and the other way round.
    out = log_density(out, parzen(parted.where("not good"), keys, value, low, high), keys, key, value, "g")
    return out.withColumn("gain", F.col("l") - F.col("g"))


def best_candidates(scored: DataFrame, keys: list[str], key: str) -> DataFrame:
    """The candidate with the largest gain of each study, the smallest key of equal ones."""
    best = F.max_by(F.struct(*scored.columns), F.struct("gain", (-F.col(key)).alias("_k"))).alias("_b")
    return scored.where("gain is not null").groupBy(*[F.col(k).alias(f"_g{k}") for k in keys]).agg(best).select("_b.*")


def laplace(counts: DataFrame, keys: list[str], n: str) -> DataFrame:
    """counts with `p`: (n + 1) over its sum within the group, the share of a choice that none is refused. A row per choice."""
    total = counts.groupBy(*keys).agg(F.sum(F.col(n) + 1).alias("_total"))
    return matched(counts, total, keys).withColumn("p", (F.col(n) + 1) / F.col("_total")).drop("_total")


def choice_gain(good: Column, bad: Column) -> Column:
    """How much likelier a choice is among good trials than among bad ones."""
    return F.log(good) - F.log(bad)
