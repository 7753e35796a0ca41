"""Folds, time splits, lag windows and forecast metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import hash_uniform
from ..schema import StudyError
from .scan import lag, last, place, scan


def order_by_hash(seed, key: str) -> Column:
    return hash_uniform(seed, F.col(key))


def numbered(df: DataFrame, seed, key: str, keys: list[str] | None = None) -> DataFrame:
    """df with `_i`: each row's place by hash within its keys, from 0."""
    placed = scan(df, keys or [], [order_by_hash(seed, key), F.col(key)], {"_i": place()})
    return placed.withColumn("_i", F.col("_i") - 1)


def holdout(df: DataFrame, share: float, seed: int, key: str = "id") -> DataFrame:
    """df with fold 0 for the last clamp(round(n * share), 1, n - 1) rows by hash, -1 for the others."""
    n = df.count()
    tail = max(1, min(n - 1, int(n * share + 0.5)))
    return numbered(df, seed, key).withColumn("fold", F.when(F.col("_i") >= n - tail, 0).otherwise(-1)).drop("_i")


def kfold(df: DataFrame, k: int, seed: int, key: str = "id") -> DataFrame:
    """df with `fold`: the place by hash modulo k, k between 2 and the number of rows."""
    k = max(2, min(k, max(2, df.count())))
    return numbered(df, seed, key).withColumn("fold", (F.col("_i") % k).cast("int")).drop("_i")


def stratified_kfold(df: DataFrame, k: int, seed: int, label: str, key: str = "id") -> DataFrame:
    """df with `fold`: the place among rows of the same label, modulo k."""
    k = max(2, min(k, max(2, df.count())))
    return numbered(df, seed, key, [label]).withColumn("fold", (F.col("_i") % k).cast("int")).drop("_i")


def evaluation(df: DataFrame, how: str, k: int = 5, seed: int = 0, label: str | None = None, key: str = "id", share: float = 0.2) -> DataFrame:
    """df with `fold`, as holdout, kfold or stratified say; stratified folds without labels are plain ones."""
    if how == "holdout":
        return holdout(df, share, seed, key)
    if how == "kfold" or how == "stratified" and label is None:
        return kfold(df, k, seed, key)
    if how == "stratified":
        return stratified_kfold(df, k, seed, label, key)
    raise StudyError(f"no such evaluation: {how}")


def train_and_test(folded: DataFrame) -> DataFrame:
    """Each row once for each fold that occurs, with `fold_id` and `train`."""
    ids = [r[0] for r in folded.select("fold").where("fold >= 0").distinct().orderBy("fold").collect()]  # as few as folds
    return folded.withColumn("fold_id", F.explode(F.array(*[F.lit(i) for i in ids]))).withColumn("train", F.col("fold") != F.col("fold_id"))


def time_folds(spark: SparkSession, n: int, initial: int, horizon: int, step: int | None = None, sliding: bool = False) -> DataFrame:
    """(fold, train_start, train_end, test_start, test_end), ends exclusive: training grows, or slides with a
    fixed length. A fold whose training overlaps its test is an error."""
    if initial < 1 or horizon < 1:
        raise StudyError("a time split needs an initial length and a horizon")
    ends = F.explode(F.sequence(F.lit(initial), F.lit(n - horizon), F.lit(step or horizon))) if n - horizon >= initial else F.explode(F.array().cast("array<int>"))
    rows = spark.range(1).select(ends.alias("train_end"))
    start = F.col("train_end") - initial if sliding else F.lit(0)
    out = rows.select(F.floor((F.col("train_end") - initial) / (step or horizon)).cast("int").alias("fold"), start.cast("long").alias("train_start"), F.col("train_end").cast("long"), F.col("train_end").cast("long").alias("test_start"), (F.col("train_end") + horizon).cast("long").alias("test_end"))
    return out.where(F.assert_true(F.col("train_end") <= F.col("test_start")).isNull())


def time_folds_of(df: DataFrame, n: str, initial: int, horizon: int, step: int | None = None, sliding: bool = False) -> DataFrame:
    """df with (fold, train_start, train_end, test_start, test_end) for each row's own length `n`, as time_folds() gives them; a series that is too short
    has none."""
    if initial < 1 or horizon < 1:
        raise StudyError("a time split needs an initial length and a horizon")
    last_end = F.col(n).cast("long") - horizon
    ends = F.when(last_end >= initial, F.sequence(F.lit(initial).cast("long"), last_end, F.lit(step or horizon).cast("long")))
    rows = df.withColumn("train_end", F.explode(ends))
    start = F.col("train_end") - initial if sliding else F.lit(0).cast("long")
    return rows.select(*df.columns, F.floor((F.col("train_end") - initial) / (step or horizon)).cast("int").alias("fold"), start.alias("train_start"), "train_end", F.col("train_end").alias("test_start"), (F.col("train_end") + horizon).alias("test_end"))


def lag_windows(df: DataFrame, width: int, keys: list[str], order: str = "t", value: str = "y") -> DataFrame:
    """(keys, t, features, y): the `width` values before each one that has so many."""
    found = scan(df, keys, [order], {"features": last(value, width)}).where((F.size("features") == width) & ~F.exists("features", lambda x: x.isNull()))
    return found.select(*keys, order, "features", F.col(value).alias("y"))


def forecast_metrics(df: DataFrame, keys: list[str], actual: str = "actual", predicted: str = "predicted", q: float = 0.5, naive_scale: str | None = None) -> DataFrame:
    """mae, rmse, smape (a pair of zeros counts as 0), pinball, and mase if a naive scale is given (infinite where
    that is 0)."""
    a, p = F.col(actual), F.col(predicted)
    e = F.abs(a - p)
    size = F.abs(a) + F.abs(p)
    aggs = [F.avg(e).alias("mae"), F.sqrt(F.avg((a - p) * (a - p))).alias("rmse"), (F.avg(F.when(size > 0, 2 * e / size).otherwise(0.0)) * 100).alias("smape"), F.avg(F.when(a >= p, q * (a - p)).otherwise((1 - q) * (p - a))).alias("pinball")]
    if naive_scale:
        aggs.append(F.when(F.first(naive_scale) > 0, F.avg(e) / F.first(naive_scale)).otherwise(F.lit(float("inf"))).alias("mase"))
    return df.groupBy(*keys).agg(*aggs)


def naive_scale(train: DataFrame, keys: list[str], order: str = "t", value: str = "y") -> DataFrame:
    """The mean step of a series: what predicting the last value costs."""
    steps = scan(train, keys, [order], {"_before": lag(value)}).withColumn("_d", F.abs(F.col(value) - F.col("_before")))
    return steps.groupBy(*keys).agg(F.coalesce(F.avg("_d"), F.lit(0.0)).alias("scale"))


def accuracy(df: DataFrame, label: str, predicted: str, keys: list[str] | None = None) -> DataFrame:
    """Percent of equal pairs; 0 for none."""
    return df.groupBy(*(keys or [])).agg(F.coalesce(F.avg((F.col(label) == F.col(predicted)).cast("double")) * 100, F.lit(0.0)).alias("accuracy"))


def rmse(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Root mean squared error; infinite for none."""
    d = F.col(actual) - F.col(predicted)
    return df.agg(F.coalesce(F.sqrt(F.avg(d * d)), F.lit(float("inf"))).alias("rmse"))
