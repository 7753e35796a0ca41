"""Which running trials to stop, from what peers reported at the same step.

Each function returns (study_id, trial_id, step, prune) for running trials that have reported.
Peers are completed and pruned trials with a report at exactly that step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import median
from ..schema import RUNNING, sign
from .history import last_reports, peers
from .scan import place, scan, size
from .scan import running as running_of
from .select import matched, medians


def running(reports: DataFrame, trials: DataFrame, objective: str) -> DataFrame:
    """(study_id, trial_id, step, value): each running trial's latest report."""
    ids = trials.where(F.col("state") == RUNNING).select("study_id", "trial_id")
    return last_reports(reports, objective).join(ids, ["study_id", "trial_id"]).select("study_id", "trial_id", F.col("last_step").alias("step"), F.col("last_value").alias("value"))


def no_prune(reports: DataFrame, trials: DataFrame, objective: str) -> DataFrame:
    return running(reports, trials, objective).select("study_id", "trial_id", "step", F.lit(False).alias("prune"))


def median_prune(reports: DataFrame, trials: DataFrame, objective: str, direction: str, warmup: int = 1, min_trials: int = 1, window: int = 1) -> DataFrame:
    """Prune what is strictly worse than its peers' median. No decision before step `warmup` or with fewer than
    min_trials peers (counted before NaNs are dropped). window: the median of the last reported values stands for
    the trial's value."""
    now = running(reports, trials, objective)
    if window > 1:
        own = reports.where(F.col("metric") == objective).join(now.select("study_id", "trial_id"), ["study_id", "trial_id"])
        recent = own.withColumn("back", F.row_number().over(W.partitionBy("study_id", "trial_id").orderBy(F.desc("step")))).where(F.col("back") <= window)
        now = now.drop("value").join(recent.groupBy("study_id", "trial_id").agg(median(F.col("value")).alias("value")), ["study_id", "trial_id"])
    them = peers(reports, trials, objective)
    # The least number of peers counts NaNs, the median does not.
    counted = them.groupBy("study_id", "step").agg(F.count("value").alias("peers"))
    at_step = matched(counted, medians(them, ["study_id", "step"], "value", "middle"), ["study_id", "step"], "left")
    s = float(sign(direction))
    worse = (F.col("step") >= warmup) & (F.col("peers") >= max(1, min_trials)) & (s * F.col("value") > s * F.col("middle")) & ~F.isnan("value")
    return now.join(at_step, ["study_id", "step"], "left").select("study_id", "trial_id", "step", F.coalesce(worse, F.lit(False)).alias("prune"))


def rungs(min_resource: int, eta: int, most: int) -> list[int]:
    out, r = [], max(1, min_resource)
    while r <= most:
        out.append(r)
        r *= max(2, eta)
    return out


def is_rung(step: Column, min_resource: int = 1, eta: int = 3) -> Column:
    """Whether step is min_resource * eta**k for some k; exact, without logarithms."""
    return step.cast("long").isin(*rungs(min_resource, eta, (1 << 62) - 1))


def asha_prune(reports: DataFrame, trials: DataFrame, objective: str, direction: str, min_resource: int = 1, eta: int = 3) -> DataFrame:
    """At rungs with eta trials or more (the trial itself counts): prune unless it is among the best
    max(1, n // eta)."""
    s = float(sign(direction))
    now = running(reports, trials, objective)
    at_rung = now.where(is_rung(F.col("step"), min_resource, eta) & F.col("value").isNotNull() & ~F.isnan("value"))
    both = at_rung.select("study_id", "step", "trial_id", (s * F.col("value")).alias("v"), F.lit(0).alias("peer")).unionByName(peers(reports.where(is_rung(F.col("step"), min_resource, eta)), trials, objective).where(~F.isnan("value")).select("study_id", "step", "trial_id", (s * F.col("value")).alias("v"), F.lit(1).alias("peer")))
    # Peers by distinct value, then added up in order: equal values meet before the window.
    group = both.groupBy("study_id", "step", "v").agg(F.sum("peer").alias("peers"))
    order = W.partitionBy("study_id", "step").orderBy("v")
    better = group.withColumn("better", F.coalesce(F.sum("peers").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.sum("peers").over(W.partitionBy("study_id", "step")))
    placed = at_rung.withColumn("v", s * F.col("value")).join(better, ["study_id", "step", "v"])
    keep = F.greatest(F.lit(1), F.floor((F.col("n") + 1) / eta))
    verdict = placed.select("study_id", "trial_id", ((F.col("n") + 1 >= eta) & (F.col("better") >= keep)).alias("prune"))
    return now.join(verdict, ["study_id", "trial_id"], "left").select("study_id", "trial_id", "step", F.coalesce("prune", F.lit(False)).alias("prune"))


def multi_objective_prune(reports: DataFrame, trials: DataFrame, objectives: list[tuple[str, str]], min_trials: int = 1) -> DataFrame:
    """Prune a trial that more than half of its peers dominate at its latest step. A report that lacks an
    objective dominates nothing and is dominated by nothing.

    Peers are grouped by their vectors first, so equal ones count once."""
    names = [n for n, _ in objectives]
    signs = F.array(*[F.lit(float(sign(d))) for _, d in objectives])
    bags = reports.where(F.col("metric").isin(*names)).groupBy("study_id", "trial_id", "step").agg(*[F.max(F.when(F.col("metric") == n, F.col("value"))).alias(f"_{k}") for k, n in enumerate(names)])
    vectors = bags.select("study_id", "trial_id", "step", F.zip_with(F.array(*[f"_{k}" for k in range(len(names))]), signs, lambda x, s: x * s + 0.0).alias("v"))
    state = trials.select("study_id", "trial_id", "state")
    steps = reports.groupBy("study_id", "trial_id").agg(F.max("step").alias("step"))
    now = steps.join(state.where(F.col("state") == RUNNING).drop("state"), ["study_id", "trial_id"]).join(vectors, ["study_id", "trial_id", "step"], "left")
    them = vectors.join(state.where(F.col("state").isin("Complete", "Pruned")).drop("state"), ["study_id", "trial_id"]).groupBy("study_id", "step", "v").agg(F.count("*").alias("n"))
    total = them.groupBy("study_id", "step").agg(F.sum("n").alias("peers"))
    worse = dominators(now.where("v is not null"), them, len(names)).groupBy("study_id", "trial_id").agg(F.sum("dominated_by").alias("dominated_by"))
    out = now.join(worse, ["study_id", "trial_id"], "left").join(total, ["study_id", "step"], "left")
    return out.select("study_id", "trial_id", "step", F.coalesce((F.col("peers") >= max(1, min_trials)) & (2 * F.col("dominated_by") > F.col("peers")), F.lit(False)).alias("prune"))


def dominators(now: DataFrame, them: DataFrame, width: int) -> DataFrame:
    """now (study_id, trial_id, step, v) with `dominated_by`: how many of them (study_id, step, v, n) are no larger in any coordinate and smaller in
    one. A vector with a null dominates nothing and is dominated by nothing.

    With two coordinates no vectors are paired: ranks of the first are cut into intervals of each power of two, a vector is a member
    of one of each, those up to it are one of some, and running sums in order of the second count within them. More coordinates are compared in pairs."""
    at = ["study_id", "step"]
    if width != 2:
        p = them.withColumnRenamed("v", "w")
        beats = F.forall(F.zip_with("w", "v", lambda a, b: a <= b), lambda x: F.coalesce(x, F.lit(False))) & F.exists(F.zip_with("w", "v", lambda a, b: a < b), lambda x: F.coalesce(x, F.lit(False)))
        return now.join(p, at).withColumn("dominated_by", F.when(beats, F.col("n")).otherwise(0))
    both = now.select(*at, "v", F.lit(0).cast("long").alias("n"), F.lit(1).alias("q")).unionByName(them.select(*at, "v", "n", F.lit(0).alias("q")))
    points = both.where(F.forall("v", lambda x: x.isNotNull())).groupBy(*at, F.col("v")[0].alias("a"), F.col("v")[1].alias("b")).agg(F.sum("n").alias("n"), F.max("q").alias("q"))
    ranks = scan(points.select(*at, "a").distinct(), at, ["a"], {"r": place(), "size": size()})
    placed = points.join(ranks, [*at, "a"]).withColumns({"r": F.col("r").cast("long"), "levels": F.floor(F.log2(F.col("size").cast("double")) + 1e-9).cast("int")})
    # The first r ranks are the intervals that r has bits for; r >> k is odd there, so members of others are not needed.
    levels = F.sequence(F.lit(0), F.col("levels"))
    cell = lambda k, r: F.call_function("shiftright", r, k)
    member = F.transform(levels, lambda k: F.struct(k.alias("level"), cell(k, F.col("r") - 1).alias("cell")))
    member = F.filter(member, lambda m: m["cell"] % 2 == 0)
    upto = F.transform(F.filter(levels, lambda k: cell(k, F.col("r")) % 2 == 1), lambda k: F.struct(k.alias("level"), (cell(k, F.col("r")) - 1).alias("cell")))
    members = placed.where("n > 0").select(*at, F.explode(member).alias("m"), "a", "b", "n", F.lit(0).alias("q"))
    queries = placed.where("q = 1").select(*at, F.explode(upto).alias("m"), "a", "b", F.lit(0).cast("long").alias("n"), F.lit(1).alias("q"))
    rows = members.unionByName(queries).select(*at, "m.*", "a", "b", "n", "q")
    counted = scan(rows, [*at, "level", "cell"], ["b", "q"], {"below": running_of("sum", "n")}).where("q = 1").groupBy(*at, "a", "b").agg(F.sum("below").alias("below"))
    own = points.where("q = 1").select(*at, "a", "b", F.col("n").alias("equal")).join(counted, [*at, "a", "b"])
    found = own.select(*at, F.array("a", "b").alias("v"), (F.col("below") - F.col("equal")).alias("dominated_by"))
    return now.join(found, [*at, "v"])
