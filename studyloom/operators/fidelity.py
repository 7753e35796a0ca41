"""Bracket schedules, survivors, promotion and the analytics of budgets."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import sign
from .scan import place, scan, size


def s_max(max_resource: int, eta: int) -> int:
    """The highest bracket, by logarithms in floating point: 4, not 5, for 243 and 3."""
    return math.trunc(math.log(max_resource) / math.log(eta))


def schedule(max_resource: int, eta: int = 3) -> list[dict]:
    """(bracket, rung, configs, resource, keep) from the highest bracket to 0."""
    eta, out, top = max(2, eta), [], s_max(max_resource, max(2, eta))
    for s in range(top, -1, -1):
        n = math.ceil((top + 1) / (s + 1) * eta**s)
        first = max_resource / eta**s
        for i in range(s + 1):
            n_i = max(1, n // eta**i)
            r_i = max(1, int(first * eta**i + 0.5))
            out.append({"bracket": s, "rung": i, "configs": n_i, "resource": min(r_i, max_resource), "keep": max(1, n_i // eta) if i < s else 0})
    return out


def schedule_table(spark: SparkSession, max_resource: int, eta: int = 3) -> DataFrame:
    rows = [tuple(r.values()) for r in schedule(max_resource, eta)]
    return spark.createDataFrame(rows, "bracket int, rung int, configs long, resource long, keep long")


def schedules(df: DataFrame, resource: str, eta: int = 3) -> DataFrame:
    """df with (bracket, rung, configs, resource, keep) for each row's own largest resource, as schedule() gives them; a row
    per bracket and rung. Rows without a resource of 1 at least are left out."""
    eta = max(2, eta)
    most = F.col("_most").cast("double")
    power = lambda k: F.pow(F.lit(float(eta)), k)
    # Where each bracket begins: a power of eta, or one more where the logarithms fall short of it.
    starts = [eta**s if s_max(eta**s, eta) >= s else eta**s + 1 for s in range(1, 63) if eta**s < 1 << 62]
    top = F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in starts]), lambda x: x <= F.col("_most")))
    rows = df.withColumn("_most", F.col(resource)).where("_most >= 1").withColumn("_top", top)
    rows = rows.withColumn("bracket", F.explode(F.sequence(F.lit(0), F.col("_top")))).withColumn("rung", F.explode(F.sequence(F.lit(0), F.col("bracket"))))
    start = F.ceil((F.col("_top") + 1) / (F.col("bracket") + 1) * power(F.col("bracket")))
    configs = F.greatest(F.lit(1).cast("long"), F.floor(start / power(F.col("rung"))))
    used = F.least(F.greatest(F.lit(1).cast("long"), F.floor(most / power(F.col("bracket")) * power(F.col("rung")) + 0.5)), F.col("_most").cast("long"))
    keep = F.when(F.col("rung") < F.col("bracket"), F.greatest(F.lit(1).cast("long"), F.floor(configs / eta))).otherwise(F.lit(0).cast("long"))
    return rows.select(*df.columns, "bracket", "rung", configs.alias("configs"), used.alias("used"), keep.alias("keep"))


def survivors(df: DataFrame, keys: list[str], score: str, order: str, direction: str, keep) -> DataFrame:
    """The best `keep` of each group, of equal scores the earlier one; NaN comes last."""
    w = W.partitionBy(*keys).orderBy(F.isnan(score), F.lit(float(sign(direction))) * F.col(score), order)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= keep)


def promoted(df: DataFrame, rung: str, score: str, trial: str, direction: str, eta: int = 3) -> DataFrame:
    """(.., place, promoted): of n trials in a rung the best ceil(n / eta) are promoted."""
    order = [F.lit(float(sign(direction))) * F.col(score), F.col(trial)]
    placed = scan(df, [rung], order, {"place": place(), "_n": size()})
    return placed.withColumn("promoted", F.col("place") <= F.ceil(F.col("_n") / max(2, eta))).withColumn("place", F.col("place").cast("int")).drop("_n")


def warm_start(df: DataFrame, rung: str, score: str, trial: str, direction: str, eta: int = 3) -> DataFrame:
    """The best promoted trial of each rung."""
    return promoted(df, rung, score, trial, direction, eta).where("place = 1")
