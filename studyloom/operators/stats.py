"""Parameter importance and robust aggregation of noisy values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import no_nan
from .scan import place, running, scan, size
from .select import at_ranks, matched, medians, middle

BINS = 10


def numeric(value: Column) -> Column:
    """A parameter value as a number: booleans as 0 and 1."""
    return F.coalesce(value["f"], value["i"].cast("double"), value["b"].cast("double"))


def long_params(trials: DataFrame, objective: str) -> DataFrame:
    """(study_id, trial_id, y, name, x, label): a row per completed trial and parameter; label for
    categorical and boolean ones, x for numbers."""
    own = trials.where("state = 'Complete'").select("study_id", "trial_id", F.try_element_at("final", F.lit(objective)).alias("y"), F.explode("params").alias("name", "v"))
    own = own.where(F.col("y").isNotNull() & ~F.isnan("y"))
    label = F.when(F.col("v.kind").isin("categorical", "bool"), F.coalesce(F.col("v.s"), F.col("v.b").cast("string")))
    return own.select("study_id", "trial_id", "y", "name", F.when(label.isNull(), numeric(F.col("v"))).alias("x"), label.alias("label"))


def quantile_bins(rows: DataFrame, keys: list[str], x: str = "x", tie: str = "trial_id", bins: int = BINS) -> DataFrame:
    """bin = floor(i * k / n) for the i-th row by x, with k = min(bins, distinct x)."""
    distinct = rows.groupBy(*keys).agg(F.countDistinct(x).alias("_d"))
    placed = matched(scan(rows, keys, [x, tie], {"_i": place(), "_n": size()}), distinct, keys)
    return placed.withColumn("bin", F.expr(f"cast((_i - 1) * least({bins}, _d) div _n as int)")).drop("_i", "_d", "_n")


def importance(rows: DataFrame) -> DataFrame:
    """(study_id, name, importance) for rows of long_params: the share of variance between a parameter's groups,
    made to sum to 1 over a study's parameters; all 0 where nothing explains any."""
    numbers = quantile_bins(rows.where("label is null and x is not null"), ["study_id", "name"]).select("study_id", "name", "y", F.col("bin").cast("string").alias("grp"))
    labels = rows.where("label is not null").select("study_id", "name", "y", F.col("label").alias("grp"))
    grouped = numbers.unionByName(labels)
    cells = grouped.groupBy("study_id", "name", "grp").agg(F.count("*").alias("n"), F.avg("y").alias("m"))
    total = grouped.groupBy("study_id", "name").agg(F.var_pop("y").alias("total"), F.avg("y").alias("mean"), F.count("*").alias("rows"))
    apart = F.col("n") * (F.col("m") - F.col("mean")) * (F.col("m") - F.col("mean")) / F.col("rows")
    between = cells.join(total, ["study_id", "name"]).groupBy("study_id", "name").agg(F.sum(apart).alias("between"))
    share = F.when(F.col("total") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("between") / F.col("total")))).otherwise(0.0)
    each = between.join(total, ["study_id", "name"]).select("study_id", "name", share.alias("share"))
    whole = F.sum("share").over(W.partitionBy("study_id"))
    return each.select("study_id", "name", F.when(whole > 0, F.col("share") / whole).otherwise(0.0).alias("importance"))


def robust(df: DataFrame, keys: list[str], value: str, how: str = "mean", trim: float = 0.1) -> DataFrame:
    """(keys, value, spread): mean, median or trimmed mean without NaNs (null if nothing is left). The spread is
    the standard error for the mean, else 1.4826 * MAD / sqrt(n); 0 below two values."""
    rows = df.select(*keys, no_nan(F.col(value).cast("double")).alias("v")).where("v is not null")
    groups = df.select(*keys).distinct()
    if how == "mean":
        out = rows.groupBy(*keys).agg(F.avg("v").alias("value"), F.when(F.count("*") < 2, 0.0).otherwise(F.sqrt(F.var_samp("v") / F.count("*"))).alias("spread"))
        return matched(groups, out, keys, "left")
    if how not in ("median", "trimmed"):
        raise ValueError(f"no such aggregate: {how}")
    share = min(max(trim, 0.0), 0.49)
    cut = F.floor(F.col("n") * share)
    ends = {"_first": cut, "_last": F.col("n") - cut - 1} if how == "trimmed" else {}
    found = at_ranks(rows, keys, "v", middle(F.col("n")) | ends).withColumn("middle", (F.col("_low") + F.col("_high")) / 2)
    off = medians(matched(rows, found.select(*keys, "middle"), keys).withColumn("off", F.abs(F.col("v") - F.col("middle"))), keys, "off", "mad")
    found = matched(found, off.select(*keys, "mad"), keys)
    spread = F.when(F.col("n") < 2, 0.0).otherwise(F.lit(1.4826) * F.col("mad") / F.sqrt("n")).alias("spread")
    if how == "median":
        return matched(groups, found.select(*keys, F.col("middle").alias("value"), spread), keys, "left")
    # What lies between the bounds, and as many of each bound as the trimmed ranks hold.
    first, last = F.col("_first"), F.col("_last")
    inside = (F.col("v") > first) & (F.col("v") < last)
    sums = matched(rows, found.select(*keys, "_first", "_last"), keys).groupBy(*keys).agg(F.sum(F.when(inside, F.col("v"))).alias("_sum"), F.count_if(F.col("v") <= first).alias("_to_first"), F.count_if(F.col("v") < last).alias("_to_last"))
    kept = F.coalesce("_sum", F.lit(0.0)) + (F.col("_to_first") - cut) * first + (F.col("n") - cut - F.col("_to_last")) * last
    value = F.when(first == last, first).otherwise(kept / (F.col("n") - 2 * cut)).alias("value")
    return matched(groups, matched(found, sums, keys).select(*keys, value, spread), keys, "left")


def running_mean(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """df with `running`: the mean of the values so far, NaNs left out, by a segmented scan. Sums are exact to 15 decimals, so they do
    not depend on how rows are cut into parts, unless a value is too large for that."""
    known = df.withColumn("_v", no_nan(F.col(value))).withColumn("_exact", F.col("_v").try_cast("decimal(33,15)"))
    found = scan(known, keys, [order], {"_sum": running("sum", "_exact"), "_exacts": running("count", "_exact"), "_n": running("count", "_v"), "_mean": running("mean", "_v")})
    exact = (F.col("_exacts") == F.col("_n")) & (F.col("_n") > 0)
    return found.withColumn("running", F.when(exact, F.col("_sum").cast("double") / F.col("_n")).otherwise(F.col("_mean"))).select(*df.columns, "running")
