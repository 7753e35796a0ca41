import math
import random

import numpy as np
import pytest

from studyloom.operators import density, leases
from studyloom.plans.samplers import History, Parzen, TpeSampler


@pytest.mark.parametrize("block", [3, 1024])
def test_density_equals_the_samplers(spark, monkeypatch, block):
    monkeypatch.setattr(density, "BLOCK", block)
    rng = random.Random(1)
    values = {"a": [rng.uniform(0, 10) for _ in range(40)], "b": [5.0, 5.0, 2.0], "c": [1e-3], "d": []}
    rows = [(g, x) for g, own in values.items() for x in own] + [("d", None), ("d", math.nan), ("b", math.nan)]
    c = density.parzen(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", 0.0, 10.0)
    asked = [(g, k, rng.uniform(-300, 310)) for g in values for k in range(20)] + [("none", 0, 1.0)]
    got = {(r["g"], r["k"]): r["v"] for r in density.log_density(spark.createDataFrame(asked, "g string, k long, q double"), c, ["g"], "k", "q", "v").collect()}
    for g, k, q in asked:
        assert got[g, k] is None if g == "none" else got[g, k] == pytest.approx(float(Parzen(values[g], 0.0, 10.0).log_pdf(np.asarray([q]))[0]), rel=1e-9)


def test_split_and_choice(spark):
    rng = random.Random(2)
    for n in (2, 3, 30, 150):
        trials = [("s", k, rng.uniform(0, 1), rng.choice([math.nan, rng.random()]) if n == 30 else rng.random()) for k in range(n)]
        df = spark.createDataFrame(trials, "study string, t long, x double, y double")
        good = {r["t"] for r in density.good_and_bad(df, ["study"], "y", "t").where("good").collect()}
        history = History([({"t": t}, [y]) for _, t, _, y in trials], n)
        assert good == {p["t"] for p in TpeSampler().split(history)[0]}
    asked = spark.createDataFrame([("s", k, k / 20) for k in range(20)] + [("t", 1, 0.5)], "study string, k long, x double")
    scored = density.tpe_scores(asked, df, ["study"], "k", "x", "y", "t", 0.0, 1.0)
    best = max((r for r in scored.collect() if r["gain"] is not None), key=lambda r: (r["gain"], -r["k"]))
    assert [tuple(r) for r in density.best_candidates(scored, ["study"], "k").collect()] == [tuple(best)]


def test_leases(spark):
    rows = [(1, 1, "Complete", None), (1, 2, "Running", 50), (1, 3, "Waiting", None), (2, 4, "Running", 51), (2, 5, "Running", None), (3, 6, "Running", 99)]
    df = spark.createDataFrame(rows, "study_id long, trial_id long, state string, lease_expiry long")
    assert sorted(map(tuple, leases.claim_next(df, 50).collect())) == [(1, 2), (2, 5)]
    after = {r["trial_id"]: (r["state"], r["lease_expiry"]) for r in leases.recovered(df, 50).collect()}
    assert after == {1: ("Complete", None), 2: ("Waiting", None), 3: ("Waiting", None), 4: ("Running", 51), 5: ("Running", None), 6: ("Running", 99)}


def test_best_fit(spark):
    rng = random.Random(3)
    asks, own = [(k, rng.choice([None, float(rng.randint(0, 30))])) for k in range(80)], [(k, float(rng.randint(0, 25))) for k in range(12)]
    got = leases.best_fit(spark.createDataFrame(asks, "r long, x double"), spark.createDataFrame(own, "d long, c double"), "x", "r", "c", "d").collect()
    wanted = {(r, min((c, d) for d, c in own if c >= x)[1]) for r, x in asks if x is not None and any(c >= x for _, c in own)}
    assert set(map(tuple, got)) == wanted


def test_cells_stand_for_components(spark):
    """A study's cells are as many as its range has room for, however many trials it has, and say the same as all of them."""
    rng = random.Random(4)
    own = [rng.gauss(3, 1) for _ in range(4000)]
    c = density.parzen(spark.createDataFrame([("a", x) for x in own], "g string, x double"), ["g"], "x", 0.0, 10.0).persist()
    assert density.cells(c, ["g"], density.POWERS).count() < 900 and density.cells(c.union(c), ["g"], density.POWERS).count() < 900
    asked = [("a", k, q) for k, q in enumerate([rng.uniform(0, 10) for _ in range(30)] + [60.0, -4000.0])]
    got = density.log_density(spark.createDataFrame(asked, "g string, k long, q double"), c, ["g"], "k", "q", "v").collect()
    for r in got:
        assert r["v"] == pytest.approx(float(Parzen(own, 0.0, 10.0).log_pdf(np.asarray([r["q"]]))[0]), rel=1e-9)
    # Without the wide component a far candidate is settled by the components themselves.
    narrow = c.where("sigma < 1").persist()
    far = density.log_density(spark.createDataFrame([("a", 1, 40.0)], "g string, k long, q double"), narrow, ["g"], "k", "q", "v").first()["v"]
    mu, sigma = (np.asarray([r[k] for r in narrow.collect()]) for k in ("mu", "sigma"))
    e = -0.5 * ((40.0 - mu) / sigma) ** 2 - np.log(sigma * math.sqrt(2 * math.pi))
    assert far == pytest.approx(e.max() + math.log(np.exp(e - e.max()).sum()) - math.log(len(mu)), rel=1e-12)
    c.unpersist(), narrow.unpersist()
