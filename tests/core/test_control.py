import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from studyloom.auto import search
from studyloom.plans import samplers as S
from studyloom.plans import space as P
from studyloom.plans.budget import Budget, Used
from studyloom.plans.coord import Devices, Resources, Worker, enqueue_pending
from studyloom.plans.samplers import History
from studyloom.plans.space import Distribution as D
from studyloom.plans.study import MedianRule, Study, aggregate, hyperband, replicate
from studyloom.schema import InvalidDistribution, InvalidSpace, MissingParam, NotFound, StorageError, TypeMismatch
from studyloom.sources.store import Store, claim_file


def demo():
    return P.SearchSpace().add("model", D.categorical(("mlp", "transformer"))).add("d_model", D.int(64, 128), ("model", ["transformer"])).add("hidden", D.int(16, 32), ("model", ["mlp"]))


def test_grids():
    assert len(demo().grid()) == 82
    assert D.int(0, 6, 3).grid() == [0, 3, 6] and D.float(0, 10).grid(3) == [0, 5, 10]


@pytest.mark.parametrize("d", [D.float(2, 1), D.log_float(0, 1), D.categorical(()), D.float(0, math.inf), D.int(0, 5, 0), D.float(1, 2, True, 0.5)])
def test_invalid_distributions(d):
    with pytest.raises(InvalidDistribution):
        d.validate("x")


def test_invalid_spaces():
    with pytest.raises(InvalidSpace):
        P.SearchSpace().add("b", D.boolean(), ("a", [1])).add("a", D.int(0, 2)).validate()
    with pytest.raises(InvalidSpace):
        P.SearchSpace().add("a", D.int(0, 2)).add("b", D.boolean(), ("a", [7])).validate()
    with pytest.raises(InvalidSpace):
        P.SearchSpace().add("a", D.boolean()).add("a", D.boolean()).validate()


def test_params():
    p = P.ParamSet({"b": 1, "a": 2.0})
    assert list(p) == ["a", "b"] and p.int("b") == 1
    with pytest.raises(MissingParam):
        p.float("c")
    with pytest.raises(TypeMismatch):
        p.int("a")
    for v in (1, 2.5, "x", True):
        assert P.from_struct(P.to_struct(v)) == v


def test_structures():
    shape = P.LayerSpace.of(("conv3", "conv5", "identity", "conv3"), 2, 4, (8, 16, 32), skips=True)
    assert len(shape.encode().params) == 13 and len(P.LayerSpace.of(("a",), 2, 4, (8,), False).encode().params) == 9
    rng = np.random.default_rng(0)
    layers = shape.sample(rng)
    for _ in range(100):
        layers = shape.mutate(layers, rng)
        assert 2 <= len(layers) <= 4 and all(op in shape.ops and w in shape.widths for op, w, _ in layers)
    stages = {"pre": {"std": {}, "none": {}}, "model": {"knn": {"k": D.int(1, 15)}, "mean": {}}}
    s = P.pipeline_space(stages)
    assert len(s.params) == 3
    assert P.describe_plan(P.pipeline_plan(stages, {"pre": "std", "model": "knn", "model.knn.k": 3})) == "pre=std · model=knn"
    assert P.fused_dim([6, 6], "mean") == 6 and P.fused_dim([6, 4], "concat") == 10
    with pytest.raises(InvalidSpace):
        P.fused_dim([6, 4], "mean")


def test_van_der_corput():
    assert [S.radical_inverse(k, 2) for k in range(1, 8)] == [0.5, 0.25, 0.75, 0.125, 0.625, 0.375, 0.875]
    u = sorted(S.HaltonSampler().suggest(P.SearchSpace().add("x", D.float(0, 1)), History(), k)["x"] for k in range(64))
    assert max(b - a for a, b in zip([0, *u], [*u, 1], strict=True)) < 0.06


@st.composite
def spaces(draw):
    s = P.SearchSpace()
    for k in range(draw(st.integers(1, 4))):
        kind = draw(st.sampled_from(("float", "log", "int", "categorical", "bool")))
        s.add(f"p{k}", {"float": D.float(-2, 3), "log": D.log_float(1e-3, 10), "int": D.int(1, 9), "categorical": D.categorical(("a", "b", "c")), "bool": D.boolean()}[kind])
    if draw(st.booleans()):
        s.add("gate", D.boolean()).add("gated", D.float(0, 1), ("gate", [True]))
    return s


@settings(max_examples=40, deadline=None)
@given(spaces(), st.integers(0, 1000))
def test_samplers_stay_in_the_space(space, seed):
    rng = np.random.default_rng(seed)
    done = [(space.sample(rng), [float(rng.random()), float(rng.random())]) for _ in range(45)]
    for s in (S.RandomSampler(seed), S.GridSampler(3), S.HaltonSampler(), S.TpeSampler(seed), S.TpeSampler(seed, multivariate=True), S.EvolutionSampler(seed), S.Nsga2Sampler(seed), S.WarmStartSampler([dict(done[0][0])], S.RandomSampler(seed))):
        assert space.valid(s.suggest(space, History(done, 45), 45)), s.name


def test_tpe_beats_random():
    space = P.SearchSpace().add("x", D.float(-5, 5)).add("y", D.float(-5, 5))
    f = lambda p, _: {"objective": (p["x"] - 2) ** 2 + (p["y"] + 1) ** 2}
    score = lambda make: np.mean([Study(space, sampler=make(k), seed=k).optimize(f, 100).best()["final"]["objective"] for k in range(4)])
    assert score(lambda k: S.TpeSampler(k, multivariate=True)) < score(S.RandomSampler)


def test_pruning_and_failures():
    def f(p, sink):
        if p["x"] < -4:
            raise ValueError
        for step in range(1, 4):
            sink.report(step, {"objective": p["x"] ** 2})
            if sink.should_stop():
                break
        return {"objective": p["x"] ** 2}

    s = Study(P.SearchSpace().add("x", D.float(-5, 5)), pruner=MedianRule()).optimize(f, 60)
    states = {r["state"] for r in s.records}
    assert "Pruned" in states and s.best()["state"] == "Complete"


def test_budgets_and_aggregates():
    assert Budget("steps", 5).exhausted(Used(steps=5)) and Budget().remaining(Used()) is None and Budget("trials", 3).describe() == "3 trials"
    assert replicate(None, lambda seed: {1: 1.0, 2: 3.0, 3: 1.0, 0: 3.0}[seed % 4], 4, 1, "mean")[0] == 2.0
    assert aggregate([], "mean") == (None, 0.0) and aggregate([1, 2, 3, 4, 100], "trimmed", 0.2)[0] == 3.0


def test_hyperband():
    out = hyperband(P.SearchSpace().add("x", D.float(0, 1)), S.RandomSampler(1), lambda p, r: (p["x"] - 0.5) ** 2 + 1 / r, 27)
    assert out["evaluations"] == 69 and out["resource"] == 423 and abs(out["best"]["x"] - 0.5) < 0.3


def test_leases(spark):
    store = Store(spark, clock=lambda: 0)
    study = store.create_study("s", [("objective", "minimize")])
    t = store.enqueue_trial(study, {"x": 1.0}, (1 << 64) - 1)
    assert store.claim_trial(study, "a", 0, 100) == t and store.claim_trial(study, "b", 50, 150) is None
    assert store.renew_lease(t, "a", 200) and not store.renew_lease(t, "b", 300)
    assert store.claim_trial(study, "b", 250, 350) == t and store.recover_orphans(study, 400) == 1
    assert store.trials[t]["state"] == "Waiting" and store.trials[t]["seed"] == -1
    with pytest.raises(NotFound):
        store.enqueue_trial(99, {})


def test_workers_finish_after_crashes(spark):
    now = [0]
    store = Store(spark, clock=lambda: now[0])
    study = store.create_study("s", [("objective", "minimize")])
    space = P.SearchSpace().add("x", D.float(0, 1))
    enqueue_pending(store, study, space, S.RandomSampler(), History(), 12)
    for k in range(12):
        if k % 3 == 0:
            store.claim_trial(study, f"dead{k}", now[0], now[0] + 10)
        else:
            assert Worker(store, study, f"w{k}", 10, lambda: now[0]).poll(lambda p, s: {"objective": p["x"]}) == "ran"
    now[0] = 100
    store.recover_orphans(study, now[0])
    assert Worker(store, study, "last", 10, lambda: now[0]).run_until_idle(lambda p, s: {"objective": p["x"]}) == 4
    assert all(t["state"] == "Complete" for t in store.trials.values())


def test_lost_lease(spark):
    now = [0]
    store = Store(spark, clock=lambda: now[0])
    study = store.create_study("s", [("objective", "minimize")])
    store.enqueue_trial(study, {"x": 1.0})

    def slow(p, sink):
        now[0] = 50
        store.claim_trial(study, "b", now[0], 100)
        sink.report(1, {"objective": 1.0})
        return {"objective": 1.0}

    assert Worker(store, study, "a", 10, lambda: now[0]).poll(slow) == "lost"


def test_claim_files(tmp_path):
    assert [claim_file(str(tmp_path), 1, f"w{k}") for k in range(16)].count(True) == 1


def test_devices():
    d = Devices({x: {"cpus": 4.0, "gpus": 1.0, "memory_mb": 8000.0} for x in ("a", "b")})
    r = Resources(2, 0.5, 4000)
    assert [d.admit(r) for _ in range(5)] == ["a", "a", "b", "b", "no capacity"]
    assert d.admit(Resources(1, 0, 32_000)) == "impossible"
    d.release("a", r)
    assert d.admit(r) == "a"


def test_parquet_store(spark, tmp_path):
    root = str(tmp_path / "store")
    store = Store(spark, root)
    space = P.SearchSpace().add("x", D.float(-5, 5)).add("kind", D.categorical(("a", "b")))
    f = lambda p, sink: sink.report(1, {"objective": 9.0}) or sink.report(1, {"objective": p["x"] ** 2}) or {"objective": p["x"] ** 2}
    s = Study(space, store=store).optimize(f, 4)
    store.save_artifact(1, "m", b"one")
    store.save_artifact(1, "m", b"two")
    store.flush()
    again = Store(spark, root)
    assert again.schema_version() == 4 and again.study_ids() == [1] and again.load_artifact(1, "m") == b"two" and again.list_artifacts(1) == ["m"]
    trials, reports = again.load_history(1)
    assert trials.count() == 4 and {r["value"] for r in reports.collect()} == {r["final"]["objective"] for r in s.records}
    resumed = Study.resume(again, 1, space, S.RandomSampler()).optimize(f, 2)
    assert len(resumed.records) == 6
    from studyloom.dashboard import render

    page = render(again.trials_frame(), "objective", "minimize", "a <b>")
    assert "a &lt;b&gt;" in page and "6 trials" in page


def test_store_versions(spark, tmp_path):
    root = str(tmp_path / "store")
    store = Store(spark, root, clock=lambda: 7, flush_rows=6)
    assert store.schema_version() == 4
    study = store.create_study("s", [("objective", "minimize")])
    for k in range(3):
        t = store.enqueue_trial(study, {"x": float(k)})
        store.report(t, 1, {"objective": 1.0 * k})
        store.report(t, 1, {"objective": 2.0 * k})
    assert store.snapshot.version > 4  # flushed by itself
    store.flush()
    before, rows = store.snapshot.version, sorted(map(tuple, store.reports_frame().collect()))
    store.compact()
    assert sorted(map(tuple, store.reports_frame().collect())) == rows and store._disk("reports").count() == 3
    old = Store(spark, root, version=before)
    assert old._disk("reports").count() == 6 and sorted(map(tuple, old.reports_frame().collect())) == rows
    old.create_study("no", [])
    with pytest.raises(StorageError):
        old.flush()
    # A commit that another writer was faster with changes nothing.
    late = Store(spark, root)
    store.report(1, 2, {"objective": 5.0})
    store.flush()
    late.report(1, 3, {"objective": 6.0})
    with pytest.raises(StorageError):
        late.flush()
    assert {r["step"] for r in Store(spark, root).reports_frame().collect()} == {1, 2}
    # A compaction that breaks off before its commit leaves the version as it was; what it wrote goes with the next vacuum.
    real, store.manifest.commit = store.manifest.commit, lambda *a: 1 / 0
    with pytest.raises(ZeroDivisionError):
        store.compact()
    store.manifest.commit = real
    assert Store(spark, root).reports_frame().count() == 4
    assert store.vacuum() > 2 and Store(spark, root).reports_frame().count() == 4 and Store(spark, root).study_ids() == [1]


def test_store_migrations(spark, tmp_path):
    root = str(tmp_path / "old")
    spark.createDataFrame([(1,)], "version int").write.parquet(f"{root}/_schema_version")
    spark.createDataFrame([(1, "old", "random", "none", 5)], "study_id long, name string, sampler string, pruner string, created_ms long").write.parquet(f"{root}/studies")
    spark.createDataFrame([(1, 3, "Complete", {"objective": 2.0}, 9, 1)], "study_id long, trial_id long, state string, final map<string,double>, seed long, seq long").write.parquet(f"{root}/trials")
    store = Store(spark, root)
    assert [store.manifest.at(v).schema for v in range(1, 5)] == [1, 2, 3, 4] and store.schema_version() == 4
    assert store.trials[3]["lease_owner"] is None and store.trials[3]["final"] == {"objective": 2.0} and store.list_artifacts(3) == []
    store.save_artifact(3, "a", b"x")
    store.flush()
    assert Store(spark, root).load_artifact(3, "a") == b"x" and Store(spark, root).snapshot.version == 5
    store.manifest.commit(store.snapshot, 99, store.snapshot.tables)
    with pytest.raises(StorageError):
        Store(spark, root)


def test_reports_come_as_they_are_made(spark):
    store = Store(spark)

    def objective(p, sink):
        sink.report(1, {"objective": p["x"]})
        raise SystemExit

    with pytest.raises(SystemExit):
        Study(P.SearchSpace().add("x", D.float(0, 1)), store=store, pruner=MedianRule()).optimize(objective, 3)
    assert store.reports_frame().count() == 1


def test_rules_equal_the_operators(spark):
    from studyloom.operators import prune
    from studyloom.plans.study import AshaRule, DominanceRule

    rng = np.random.default_rng(5)
    for rule, names in ((AshaRule(1, 3), [("objective", "minimize")]), (DominanceRule(), [("a", "minimize"), ("b", "maximize")])):
        for _ in range(12):
            s = Study(P.SearchSpace().add("x", D.float(0, 1)), names)
            metrics = [{n: float(rng.integers(0, 6)) for n, _ in names} for _ in range(7)]
            s.bags, s.curves, s.latest = {3: metrics[1:]}, {3: [m[names[0][0]] for m in metrics[1:]]}, metrics[0]
            rows = [(1, k, 3, n, v) for k, m in enumerate(metrics) for n, v in m.items()]
            states = [(1, k, "Complete" if k else "Running") for k in range(7)]
            frames = (spark.createDataFrame(rows, "study_id long, trial_id long, step long, metric string, value double"), spark.createDataFrame(states, "study_id long, trial_id long, state string"))
            wanted = prune.asha_prune(*frames, "objective", "minimize") if len(names) == 1 else prune.multi_objective_prune(*frames, names)
            assert rule.decide(s, [metrics[0][names[0][0]]], 3) == wanted.first()["prune"]


def test_searches():
    assert search.reinforcement(trials=6).score > 0
    assert search.forecaster(np.sin(np.arange(120) / 5) + np.arange(120) / 100, trials=4, epochs=20).score < 1.5


def test_evolution_draws_from_all_finite_trials():
    space = P.SearchSpace().add("x", D.float(0, 1))
    done = [(P.ParamSet({"x": k / 40}), (float(k),)) for k in range(40)] + [(P.ParamSet({"x": 0.999}), (-math.inf,)), (P.ParamSet({"x": 0.998}), (math.nan,))]
    sampler = S.EvolutionSampler(1, mutation=0.0)
    drawn = {round(sampler.suggest(space, History(done, []), k)["x"] * 40, 6) for k in range(400)}
    assert max(drawn) >= 20 and max(drawn) < 39.9  # parents beyond the best twenty, none without a finite value


def test_anomaly_search(spark):
    rng = np.random.default_rng(3)
    near = [(k, rng.uniform(-1, 1, 2).tolist(), False) for k in range(40)]
    rows = [(100 + k, rng.uniform(-1, 1, 2).tolist(), False) for k in range(20)] + [(200 + k, rng.uniform(8, 12, 2).tolist(), True) for k in range(5)]
    kind = "id long, v array<double>, label boolean"
    found = search.anomalies(spark.createDataFrame(near, kind), spark.createDataFrame(rows, kind), trials=6, max_k=4)
    assert found.score > 0.5
