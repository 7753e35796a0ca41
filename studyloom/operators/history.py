"""Views of a history: trials (study_id, trial_id, state, final, ...) and reports (study_id,
trial_id, step, metric, value, seq)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import COMPLETE, PEERS, STATES, TERMINAL, sign
from .scan import running, scan


def completed(trials: DataFrame) -> DataFrame:
    return trials.where(F.col("state") == COMPLETE)


def is_terminal(state: Column | str = "state") -> Column:
    return (F.col(state) if isinstance(state, str) else state).isin(*TERMINAL)


def final_value(objective: str) -> Column:
    return F.try_element_at("final", F.lit(objective))


def completed_values(trials: DataFrame, objective: str) -> DataFrame:
    """(study_id, trial_id, value) of completed trials that have the metric; in order of trial_id where it matters."""
    return completed(trials).select("study_id", "trial_id", final_value(objective).alias("value")).where("value is not null")


def current_reports(reports: DataFrame) -> DataFrame:
    """One row per (study, trial, step, metric): the one written last."""
    return reports.groupBy("study_id", "trial_id", "step", "metric").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))


def peers(reports: DataFrame, trials: DataFrame, objective: str) -> DataFrame:
    """(study_id, trial_id, step, value) of completed and pruned trials."""
    states = trials.where(F.col("state").isin(*PEERS)).select("study_id", "trial_id")
    return reports.where(F.col("metric") == objective).join(states, ["study_id", "trial_id"]).select("study_id", "trial_id", "step", "value")


def intermediate_values_at(reports: DataFrame, trials: DataFrame, step: int, objective: str) -> DataFrame:
    return peers(reports.where(F.col("step") == step), trials, objective)


def intermediate_metrics_at(reports: DataFrame, trials: DataFrame, step: int) -> DataFrame:
    """(study_id, trial_id, metrics) at exactly this step."""
    states = trials.where(F.col("state").isin(*PEERS)).select("study_id", "trial_id")
    bags = reports.where(F.col("step") == step).groupBy("study_id", "trial_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("metrics"))
    return bags.join(states, ["study_id", "trial_id"])


def last_reports(reports: DataFrame, objective: str) -> DataFrame:
    """(study_id, trial_id, last_step, last_value): a trial's latest step, whatever its metrics, and the
    objective's value there (null if that report lacks it)."""
    at = F.max("step").alias("last_step")
    latest = F.max_by(F.when(F.col("metric") == objective, F.col("value")), F.struct("step", (F.col("metric") == objective).alias("own")))
    return reports.groupBy("study_id", "trial_id").agg(at, latest.alias("last_value"))


def value_at(reports: DataFrame, trial_id: int, step: int, objective: str) -> DataFrame:
    return reports.where((F.col("trial_id") == trial_id) & (F.col("step") == step) & (F.col("metric") == objective)).select("value")


def wall_time_ms() -> Column:
    """End minus start, 0 at least; null unless both are known."""
    return F.when(F.col("started_ms").isNotNull() & F.col("completed_ms").isNotNull(), F.greatest(F.col("completed_ms") - F.col("started_ms"), F.lit(0)))


def best_trial(trials: DataFrame, objective: str, direction: str) -> DataFrame:
    """(study_id, trial_id, value): the best completed trial of each study, the first of equal ones. If a study's
    first completed value is NaN nothing displaces it."""
    values = completed_values(trials, objective)
    rank = F.when(F.isnan("value"), F.lit(None)).otherwise(F.lit(float(sign(direction))) * F.col("value"))
    best = F.min(F.struct(rank.isNull().alias("nan"), rank.alias("rank"), F.col("trial_id").alias("trial_id"), F.col("value").alias("value")))
    first = F.min(F.struct("trial_id", "value"))
    picked = values.groupBy("study_id").agg(best.alias("best"), first.alias("first"))
    chosen = F.when(F.isnan("first.value"), F.struct(F.col("first.trial_id").alias("trial_id"), F.col("first.value").alias("value"))).otherwise(F.struct(F.col("best.trial_id").alias("trial_id"), F.col("best.value").alias("value")))
    return picked.select("study_id", chosen.alias("c")).select("study_id", "c.*")


def best_configs(trials: DataFrame, objective: str, direction: str, n: int) -> DataFrame:
    """The n best completed trials with finite values of each study, ties by id."""
    values = completed_values(trials, objective).where(~F.isnan("value") & (F.abs("value") < float("inf")))
    w = W.partitionBy("study_id").orderBy(F.lit(float(sign(direction))) * F.col("value"), "trial_id")
    return values.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def consumption(trials: DataFrame, reports: DataFrame) -> DataFrame:
    """(study_id, trials, epochs, steps): trials, the sum of last steps, the number of reports."""
    bags = reports.select("study_id", "trial_id", "step").distinct()
    each = bags.groupBy("study_id", "trial_id").agg(F.max("step").alias("last"), F.count("*").alias("n"))
    used = each.groupBy("study_id").agg(F.sum("last").cast("long").alias("epochs"), F.sum("n").cast("long").alias("steps"))
    counted = trials.groupBy("study_id").agg(F.count("*").alias("trials"))
    return counted.join(used, "study_id", "left").select("study_id", "trials", F.coalesce("epochs", F.lit(0)).cast("long").alias("epochs"), F.coalesce("steps", F.lit(0)).cast("long").alias("steps"))


def summary(trials: DataFrame) -> DataFrame:
    """A row per study: how many trials it has, and how many in each state."""
    return trials.groupBy("study_id").agg(F.count("*").alias("trials"), *[F.count_if(F.col("state") == s).alias(s.lower()) for s in STATES])


def summarize(trials: DataFrame) -> DataFrame:
    """(study_id, line): the summary as text."""
    parts = [F.format_string(f"%d {s}", s) for s in ("complete", "pruned", "failed", "running", "waiting", "cancelled")]
    return summary(trials).select("study_id", F.concat(F.format_string("%d trials: ", "trials"), F.concat_ws(", ", *parts)).alias("line"))


def is_drained(trials: DataFrame) -> DataFrame:
    return trials.groupBy("study_id").agg(F.bool_and(is_terminal()).alias("drained"))


def best_so_far(trials: DataFrame, objective: str, direction: str) -> DataFrame:
    """(study_id, trial_id, value, best): the running best over completed trials in order of id."""
    best = running("min" if sign(direction) > 0 else "max", "value")
    return scan(completed_values(trials, objective), ["study_id"], ["trial_id"], {"best": best})


def wall_time_stats(trials: DataFrame) -> DataFrame:
    t = trials.select("study_id", wall_time_ms().alias("ms")).where("ms is not null")
    return t.groupBy("study_id").agg(F.sum("ms").cast("long").alias("total_ms"), F.avg("ms").alias("mean_ms"), F.max("ms").alias("max_ms"))


def param_scatter(trials: DataFrame, objective: str) -> DataFrame:
    """(study_id, trial_id, name, x, value): a point per completed trial and numeric parameter; booleans count as 0 and 1."""
    values = completed(trials).select("study_id", "trial_id", final_value(objective).alias("value"), F.explode("params").alias("name", "p")).where("value is not null")
    x = F.coalesce(F.col("p.f"), F.col("p.i").cast("double"), F.col("p.b").cast("double"))
    return values.select("study_id", "trial_id", "name", x.alias("x"), "value").where("x is not null")


def curves_by_fate(reports: DataFrame, trials: DataFrame, objective: str) -> DataFrame:
    """(study_id, state, step, trials, mean, low, high): what trials that ended alike have reported at each step, NaNs left out."""
    states = trials.select("study_id", "trial_id", "state")
    own = reports.where((F.col("metric") == objective) & ~F.isnan("value")).join(states, ["study_id", "trial_id"])
    return own.groupBy("study_id", "state", "step").agg(F.count("*").alias("trials"), F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))
