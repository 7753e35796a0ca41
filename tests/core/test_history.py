import math
import random

import pytest
from pyspark.sql import functions as F

from studyloom.operators import fidelity, history, pareto, prune, stats
from studyloom.schema import MAXIMIZE, MINIMIZE

NAN = float("nan")


def trials(spark, rows):
    """(trial, state, final)"""
    data = [(1, i, s, {"loss": float(v)} if v is not None else None) for i, s, v in rows]
    return spark.createDataFrame(data, "study_id long, trial_id long, state string, final map<string,double>")


def reports(spark, rows, metric="loss"):
    data = [(1, t, s, m if isinstance(m, str) else metric, float(v)) for t, s, m, v in [(*r[:2], metric, r[2]) if len(r) == 3 else r for r in rows]]
    return spark.createDataFrame(data, "study_id long, trial_id long, step long, metric string, value double")


def decisions(df):
    return {r["trial_id"]: r["prune"] for r in df.collect()}


PEERS = [(0, 1, 0.1), (1, 1, 0.2), (2, 1, 0.3)]
STATES = [(0, "Complete", 0.1), (1, "Complete", 0.2), (2, "Pruned", 0.3), (9, "Running", None)]


def test_median(spark):
    t = trials(spark, STATES)
    assert decisions(prune.median_prune(reports(spark, [*PEERS, (9, 1, 0.5)]), t, "loss", MINIMIZE)) == {9: True}
    assert decisions(prune.median_prune(reports(spark, [*PEERS, (9, 1, 0.1)]), t, "loss", MINIMIZE)) == {9: False}
    assert decisions(prune.median_prune(reports(spark, [*PEERS, (9, 1, 9.9)]), t, "loss", MINIMIZE, warmup=5)) == {9: False}
    assert decisions(prune.median_prune(reports(spark, [*PEERS, (9, 1, 0.2)]), t, "loss", MINIMIZE)) == {9: False}
    assert decisions(prune.no_prune(reports(spark, [*PEERS, (9, 1, 9.0)]), t, "loss")) == {9: False}


def test_robust_window(spark):
    t = trials(spark, STATES)
    r = reports(spark, [(0, 3, 0.2), (1, 3, 0.2), (2, 3, 0.2), (9, 1, 0.1), (9, 2, 0.12), (9, 3, 0.9)])
    assert decisions(prune.median_prune(r, t, "loss", MINIMIZE)) == {9: True}
    assert decisions(prune.median_prune(r, t, "loss", MINIMIZE, window=3)) == {9: False}


@pytest.mark.parametrize(("peers", "value", "step", "verdict"), [((0.1, 0.2, 0.3), 0.9, 1, True), ((0.4, 0.5, 0.6), 0.1, 1, False), ((0.1, 0.2, 0.3), 0.9, 2, False), ((0.1,), 0.9, 1, False)])
def test_asha(spark, peers, value, step, verdict):
    t = trials(spark, STATES)
    r = reports(spark, [(k, step, v) for k, v in enumerate(peers)] + [(9, step, value)])
    assert decisions(prune.asha_prune(r, t, "loss", MINIMIZE, 1, 3)) == {9: verdict}


def test_rungs():
    assert prune.rungs(1, 3, 30) == [1, 3, 9, 27]


@pytest.mark.parametrize(("peers", "own", "verdict"), [([(0.1, 0.1), (0.2, 0.2), (0.3, 0.3)], (0.9, 0.9), True), ([(0.5, 0.1), (0.4, 0.2), (0.3, 0.3)], (0.05, 0.9), False)])
def test_multi_objective(spark, peers, own, verdict):
    t = trials(spark, STATES)
    rows = [(k, 1, m, v) for k, p in enumerate(peers) for m, v in zip(("err", "size"), p, strict=True)] + [(9, 1, m, v) for m, v in zip(("err", "size"), own, strict=True)]
    assert decisions(prune.multi_objective_prune(reports(spark, rows), t, [("err", MINIMIZE), ("size", MINIMIZE)])) == {9: verdict}


def test_best(spark):
    t = trials(spark, [(1, "Complete", 0.5), (2, "Complete", 0.1), (3, "Complete", 0.9), (4, "Complete", 0.2), (5, "Complete", 0.1), (6, "Failed", None)])
    assert tuple(history.best_trial(t, "loss", MINIMIZE).head())[1:] == (2, 0.1)
    assert tuple(history.best_trial(t, "loss", MAXIMIZE).head())[1:] == (3, 0.9)
    assert [r["trial_id"] for r in history.best_configs(t, "loss", MINIMIZE, 2).orderBy("place").collect()] == [2, 5]
    nan = trials(spark, [(1, "Complete", NAN), (2, "Complete", 0.1)])
    assert history.best_trial(nan, "loss", MINIMIZE).head()["trial_id"] == 1
    late = trials(spark, [(1, "Complete", 0.3), (2, "Complete", NAN)])
    assert history.best_trial(late, "loss", MINIMIZE).head()["trial_id"] == 1


def test_upsert_and_summary(spark):
    r = spark.createDataFrame([(1, 1, 1, "loss", 0.9, 1), (1, 1, 1, "loss", 0.4, 2)], "study_id long, trial_id long, step long, metric string, value double, seq long")
    assert [x["value"] for x in history.current_reports(r).collect()] == [0.4]
    t = trials(spark, [(1, "Complete", 1), (2, "Pruned", None), (3, "Failed", None)])
    assert history.summarize(t).head()["line"].startswith("3 trials: 1 complete, 1 pruned, 1 failed")


def points(spark, rows):
    return spark.createDataFrame([(0, k, *map(float, r)) for k, r in enumerate(rows)], "group int, id long, " + ", ".join(f"o{k} double" for k in range(len(rows[0]))))


def brute_ranks(rows):
    left, out, rank = dict(enumerate(rows)), {}, 0
    beats = lambda a, b: all(x <= y for x, y in zip(a, b, strict=True)) and a != b
    while left:
        top = [k for k, p in left.items() if not any(beats(q, p) for q in left.values())]
        out |= dict.fromkeys(top, rank)
        left = {k: p for k, p in left.items() if k not in top}
        rank += 1
    return out


@pytest.mark.parametrize("n", [2, 3])
def test_fronts(spark, n):
    rng = random.Random(n)
    rows = [tuple(float(rng.randrange(7)) for _ in range(n)) for _ in range(40)]
    ranks = brute_ranks(rows)
    first = {}
    for k, p in enumerate(rows):
        if ranks[k] == 0:
            first.setdefault(p, k)
    assert {r["id"] for r in pareto.front(points(spark, rows)).collect()} == set(first.values())
    assert {r["id"]: r["rank"] for r in pareto.ranks(points(spark, rows)).collect()} == ranks


def test_crowding_and_hypervolume(spark):
    df = points(spark, [(0, 3), (1, 2), (2, 1), (3, 0)])
    c = {r["id"]: r["crowding"] for r in pareto.crowding(df.withColumn("rank", F.lit(0))).collect()}
    assert math.isinf(c[0]) and math.isinf(c[3]) and c[1] == c[2] == pytest.approx(4 / 3)
    assert pareto.hypervolume(points(spark, [(1, 3), (2, 2)]), [4.0, 4.0]).head()["hypervolume"] == 5.0
    three = pareto.hypervolume(points(spark, [(0, 0, 0)]), [1.0, 1.0, 1.0]).head()["hypervolume"]
    assert three == pytest.approx(1.0)


def test_hypervolume_history(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(12), rng.randrange(12)) for _ in range(60)]

    def volume(own):
        return float(sum(any(x <= a and y <= b for x, y in own) for a in range(10) for b in range(10)))

    got = {r["id"]: r["hypervolume"] for r in pareto.hypervolume_history(points(spark, rows), (10.0, 10.0)).collect()}
    assert got == {k: volume(rows[: k + 1]) for k in range(len(rows))}


def test_robust(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 1.1, 0.9, 1.0, 10.0)] + [("b", v) for v in (1.0, 2.0, 3.0, 4.0, 100.0)] + [("c", NAN), ("d", 2.0), ("d", NAN), ("d", 4.0)], "k string, v double")
    of = lambda how, **more: {r["k"]: r["value"] for r in stats.robust(df, ["k"], "v", how, **more).collect()}
    assert of("mean")["a"] > 2 and of("median")["a"] == 1.0 and of("trimmed", trim=0.2)["b"] == 3.0
    assert of("mean")["c"] is None and of("mean")["d"] == 3.0


def test_importance(spark):
    rows = [(1, k, (k - 3.0) ** 2, "x", float(k), None) for k in range(10)]
    df = spark.createDataFrame(rows, "study_id long, trial_id long, y double, name string, x double, label string")
    assert stats.importance(df).head()["importance"] == 1.0
    flat = df.withColumn("y", F.lit(2.0))
    assert stats.importance(flat).head()["importance"] == 0.0
    bins = {r["trial_id"]: r["bin"] for r in stats.quantile_bins(df.where("trial_id < 7").withColumn("x", F.least("x", F.lit(4.0))), ["name"]).collect()}
    assert [bins[k] for k in range(7)] == [0, 0, 1, 2, 2, 3, 4]


def test_schedules():
    s = fidelity.schedule(27, 3)
    assert sum(r["configs"] for r in s) == 69 and sum(r["configs"] * r["resource"] for r in s) == 423
    s = fidelity.schedule(9, 3)
    assert sum(r["configs"] for r in s) == 22 and sum(r["configs"] * r["resource"] for r in s) == 78
    assert fidelity.s_max(243, 3) == 4


def test_promotion(spark):
    df = spark.createDataFrame([(0, k, v) for k, v in enumerate((0.1, 0.9, 0.5, 0.8, 0.2, 0.3))], "rung int, trial long, score double")
    got = fidelity.promoted(df, "rung", "score", "trial", MAXIMIZE).where("promoted")
    assert {r["trial"] for r in got.collect()} == {1, 3}
    assert fidelity.warm_start(df, "rung", "score", "trial", MAXIMIZE).head()["trial"] == 1


def test_dominators_by_intervals(spark):
    """Two coordinates are counted without pairs: equal vectors, ties, signs of zero, NaN and nulls as in all pairs."""
    import random

    rng = random.Random(6)
    some = [0.0, -0.0, 1.0, 2.0, 3.5, float("nan"), None]
    draw = lambda: [rng.choice(some), rng.choice([*some, rng.random()])]
    now = [(s, k, 1, draw()) for s in "ab" for k in range(40)]
    them = [(s, 1, draw(), rng.randint(1, 3)) for s in "ab" for _ in range(60)]
    # NaN is the largest number, as in Spark.
    key = lambda x: (x != x, 0.0 if x != x else x)
    beats = lambda w, v: None not in w + v and all(key(x) <= key(y) for x, y in zip(w, v)) and any(key(x) < key(y) for x, y in zip(w, v))
    wanted = {(s, k): sum(n for t, _, w, n in them if t == s and beats(w, v)) for s, k, _, v in now if None not in v}
    p = spark.createDataFrame(them, "study_id string, step long, v array<double>, n long").groupBy("study_id", "step", "v").agg(F.sum("n").alias("n"))
    found = prune.dominators(spark.createDataFrame(now, "study_id string, trial_id long, step long, v array<double>"), p, 2)
    assert "BroadcastNestedLoopJoin" not in found._jdf.queryExecution().toString()
    assert {(r["study_id"], r["trial_id"]): r["dominated_by"] for r in found.collect()} == wanted
