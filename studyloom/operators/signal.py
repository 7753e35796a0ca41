"""Waveforms, frames, masks and schedules as array expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def spectrogram(wave: Column, length: int, window: int, hop: int, bins: int) -> Column:
    """Frames of ln(1 + magnitude) of a Hann-windowed transform, `bins` (window / 2 at most) each, for waves of
    `length` samples; an expression over arrays with the frame's basis as a constant."""
    bins = min(bins, window // 2)
    hann = [0.5 - 0.5 * math.cos(2 * math.pi * i / max(1, window - 1)) for i in range(window)]

    def basis(f) -> Column:
        return F.array(*[F.array(*[F.lit(hann[i] * f(2 * math.pi * k * i / window)) for i in range(window)]) for k in range(bins)])

    dot = lambda frame, row: F.aggregate(F.zip_with(frame, row, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    starts = F.array(*[F.lit(s) for s in range(0, length - window + 1, hop)])
    real, imag = basis(math.cos), basis(lambda a: -math.sin(a))

    def frame(start: Column) -> Column:
        part = F.slice(wave, start + 1, F.lit(window))
        return F.zip_with(real, imag, lambda c, s: F.log1p(F.sqrt(dot(part, c) * dot(part, c) + dot(part, s) * dot(part, s))))

    return F.transform(starts, frame)


def frame_pool(frame: Column, channels: int, height: int, width: int, grid: int) -> Column:
    """Averages over a grid of even cells, channel by channel; cell g covers rows g*h//grid to (g+1)*h//grid."""
    cells = []
    for c in range(channels):
        for gy in range(grid):
            for gx in range(grid):
                ys, xs = (range(g * n // grid, max(g * n // grid + 1, (g + 1) * n // grid)) for g, n in ((gy, height), (gx, width)))
                at = [c * height * width + y * width + x for y in ys for x in xs]
                cells.append(sum((frame[k].cast("double") for k in at), F.lit(0.0)) / len(at))
    return F.array(*cells)


def stride(frames: Column, every: int) -> Column:
    return F.filter(frames, lambda _, i: i % max(1, every) == 0)


def mean_iou(df: DataFrame, keys: list[str], actual: str, predicted: str, classes: int) -> DataFrame:
    """(keys, miou): the mean over classes that occur in either mask, from 0 to 1."""
    both = lambda c, f: F.size(F.filter(F.arrays_zip(F.col(actual).alias("a"), F.col(predicted).alias("p")), lambda x: f(x["a"] == c, x["p"] == c)))
    rows = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("c"), both(c, lambda a, p: a & p).alias("i"), both(c, lambda a, p: a | p).alias("u")) for c in range(classes)])).alias("s"))
    return rows.where("s.u > 0").groupBy(*keys).agg(F.avg(F.col("s.i") / F.col("s.u")).alias("miou"))


def linear_schedule(spark: SparkSession, steps: int, low: float = 1e-4, high: float = 0.02) -> DataFrame:
    """(step, beta, alpha_bar) with evenly spaced betas."""
    beta = F.lit(low) + F.col("step") * F.lit((high - low) / max(1, steps - 1))
    return products(spark.range(steps).select(F.col("id").alias("step")).withColumn("beta", beta), steps)


def cosine_schedule(spark: SparkSession, steps: int, offset: float = 0.008) -> DataFrame:
    """Betas from the ratio of squared cosines, 0.999 at most."""
    level = lambda t: F.pow(F.cos((t / steps + offset) / (1 + offset) * (math.pi / 2)), 2)
    beta = F.least(F.greatest(1 - level(F.col("step") + 1) / level(F.col("step")), F.lit(0.0)), F.lit(0.999))
    return products(spark.range(steps).select(F.col("id").alias("step")).withColumn("beta", beta), steps)


def products(betas: DataFrame, steps: int) -> DataFrame:
    """alpha_bar: the product of 1 - beta up to each step; steps are a parameter, so one row holds them."""
    row = betas.groupBy().agg(F.array_sort(F.collect_list(F.struct("step", "beta"))).alias("b"))
    run = F.aggregate("b", F.struct(F.lit(1.0).alias("p"), F.array().cast("array<struct<step:bigint,beta:double,alpha_bar:double>>").alias("out")), lambda acc, x: F.struct((acc["p"] * (1 - x["beta"])).alias("p"), F.concat(acc["out"], F.array(F.struct(x["step"].alias("step"), x["beta"].alias("beta"), (acc["p"] * (1 - x["beta"])).alias("alpha_bar")))).alias("out")), lambda acc: acc["out"])
    return row.select(F.inline(run))


def sinusoidal(spark: SparkSession, length: int, width: int) -> DataFrame:
    """(pos, dim, value): sines at even places, cosines at odd ones."""
    rows = spark.range(length * width).select(F.floor(F.col("id") / width).alias("pos"), (F.col("id") % width).alias("dim"))
    angle = F.col("pos") / F.pow(F.lit(10000.0), (2 * F.floor(F.col("dim") / 2)) / width)
    return rows.select("pos", "dim", F.when(F.col("dim") % 2 == 0, F.sin(angle)).otherwise(F.cos(angle)).alias("value"))


def noised(df: DataFrame, schedule: DataFrame, clean: str, noise: str, step: str, name: str = "noised") -> DataFrame:
    """df with sqrt(alpha_bar) * clean + sqrt(1 - alpha_bar) * noise at each row's step; null where the schedule has no such step. A
    schedule is as long as a parameter, so it goes to every task."""
    levels = F.broadcast(schedule.select(F.col("step").alias("_s"), "alpha_bar"))
    mixed = F.zip_with(clean, noise, lambda x, e: F.sqrt("alpha_bar") * x.cast("double") + F.sqrt(1 - F.col("alpha_bar")) * e.cast("double"))
    return df.join(levels, df[step] == F.col("_s"), "left").withColumn(name, F.when(F.col("alpha_bar").isNotNull(), mixed)).drop("_s", "alpha_bar")


def position_code(pos: Column, width: int) -> Column:
    """The sinusoidal code of a place: sines at even, cosines at odd places of an array."""
    return F.array(*[(F.sin if d % 2 == 0 else F.cos)(pos / F.pow(F.lit(10000.0), F.lit(2 * (d // 2) / width))) for d in range(width)])


def pixel_normalise(pixels: Column, mean: float = 0.1307, deviation: float = 0.3081) -> Column:
    return F.transform(pixels, lambda x: (x.cast("double") / 255 - mean) / deviation)


def kernel_size(op: Column) -> Column:
    """The kernel an operation stands for: 3 or 5; null for no convolution."""
    return F.when(op == "conv3", 3).when(op == "conv5", 5)
