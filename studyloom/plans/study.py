"""The study loop: ask on the driver, evaluate a batch as Spark tasks, tell the store."""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..operators import pareto
from ..schema import COMPLETE, FAILED, MINIMIZE, PRUNED, ObjectiveFailed, sign
from ..sources.store import Store
from .budget import Budget, Used
from .samplers import History, RandomSampler, Sampler, trial_seed
from .space import ParamSet, SearchSpace, from_struct

Objective = Callable[[ParamSet, "Sink"], dict]


class Sink:
    """What an objective reports to. should_stop() says whether to end early."""

    def __init__(self, stop: Callable[[int, dict], bool] | None = None) -> None:
        self.reports: list[tuple[int, dict]] = []
        self.stop, self.stopped = stop, False

    def report(self, step: int, metrics: dict) -> None:
        self.reports.append((step, dict(metrics)))
        if self.stop and not self.stopped:
            self.stopped = self.stop(step, metrics)

    def should_stop(self) -> bool:
        return self.stopped


def evaluate(spark: SparkSession | None, objective: Objective, batch: list[tuple[int, ParamSet]]) -> list[tuple[int, str, dict | None, list]]:
    """(trial, state, final, reports) of each; on the driver without a session, else one task per trial."""

    def one(trial: int, params: ParamSet) -> tuple:
        sink = Sink()
        try:
            final = objective(params, sink)
            return trial, PRUNED if sink.stopped else COMPLETE, final, sink.reports
        except Exception:  # a failed objective is a result
            return trial, FAILED, None, sink.reports

    if spark is None or len(batch) == 1:
        return [one(t, p) for t, p in batch]

    def run(frames):
        import pandas as pd

        for f in frames:
            out = [one(int(t), ParamSet(json.loads(p))) for t, p in zip(f["trial"], f["params"], strict=True)]
            yield pd.DataFrame({"trial": [o[0] for o in out], "result": [json.dumps(o[1:]) for o in out]})

    rows = spark.createDataFrame([(t, json.dumps(p)) for t, p in batch], "trial long, params string")
    found = rows.repartition(len(batch), "trial").mapInPandas(run, "trial long, result string").collect()  # a row per trial of the batch
    by_trial = {r["trial"]: json.loads(r["result"]) for r in found}
    return [(t, by_trial[t][0], by_trial[t][1], [(s, m) for s, m in by_trial[t][2]]) for t, _ in batch]


@dataclass
class MedianRule:
    """Median pruning inside a sequential loop: as operators.prune.median_prune, over what the driver holds."""

    warmup: int = 1
    min_trials: int = 1
    window: int = 1

    def decide(self, study: Study, own: list[float], step: int) -> bool:
        peers = [v for v in study.curves.get(step, []) if v is not None]
        if step < self.warmup or len(peers) < max(1, self.min_trials):
            return False
        finite = sorted(v for v in peers if not math.isnan(v))
        recent = sorted(v for v in own[-self.window :] if not math.isnan(v))
        if not finite or not recent:
            return False
        return sign(study.directions[0][1]) * middle(recent) > sign(study.directions[0][1]) * middle(finite)


@dataclass
class AshaRule:
    """Successive halving inside a sequential loop: as operators.prune.asha_prune."""

    min_resource: int = 1
    eta: int = 3

    def decide(self, study: Study, own: list[float], step: int) -> bool:
        eta, rung = max(2, self.eta), max(1, self.min_resource)
        while rung < step:
            rung *= eta
        if rung != step or math.isnan(own[-1]):
            return False
        s = sign(study.directions[0][1])
        peers = [v for v in study.curves.get(step, []) if v is not None and not math.isnan(v)]
        n = len(peers) + 1
        return n >= eta and sum(s * v < s * own[-1] for v in peers) >= max(1, n // eta)


@dataclass
class DominanceRule:
    """Several objectives inside a sequential loop: as operators.prune.multi_objective_prune."""

    min_trials: int = 1

    def decide(self, study: Study, own: list[float], step: int) -> bool:
        mine, peers = study.vector(study.latest), [study.vector(b) for b in study.bags.get(step, [])]
        if mine is None or len(peers) < max(1, self.min_trials):
            return False
        worse = sum(p is not None and all(x <= y for x, y in zip(p, mine, strict=True)) and p != mine for p in peers)
        return 2 * worse > len(peers)


def middle(ordered: list[float]) -> float:
    n = len(ordered)
    return ordered[n // 2] if n % 2 else (ordered[n // 2 - 1] + ordered[n // 2]) / 2


@dataclass
class Study:
    space: SearchSpace
    directions: list[tuple[str, str]] = field(default_factory=lambda: [("objective", MINIMIZE)])
    sampler: Sampler = field(default_factory=RandomSampler)
    pruner: MedianRule | AshaRule | DominanceRule | None = None
    store: Store | None = None
    spark: SparkSession | None = None
    name: str = "study"
    seed: int = 0
    batch: int = 1
    study_id: int | None = None
    records: list[dict] = field(default_factory=list)
    curves: dict[int, list] = field(default_factory=dict)
    #: All metrics that ended trials reported at each step, and the latest of the running one.
    bags: dict[int, list[dict]] = field(default_factory=dict)
    latest: dict = field(default_factory=dict)
    used: Used = field(default_factory=Used)

    def __post_init__(self) -> None:
        self.space.validate()
        if self.store is not None and self.study_id is None:
            self.study_id = self.store.create_study(self.name, self.directions, self.sampler.name, "median" if self.pruner else "none")

    @classmethod
    def resume(cls, store: Store, study_id: int, space: SearchSpace, sampler: Sampler, **more) -> Study:
        """A study that goes on where the store's history ends."""
        meta = store.load_meta(study_id)
        s = cls(space, [(d["name"], d["direction"]) for d in meta["directions"]], sampler, store=store, study_id=study_id, name=meta["name"], **more)
        for t in sorted((t for t in store.trials.values() if t["study_id"] == study_id), key=lambda t: t["trial_id"]):
            s.records.append({"trial": t["trial_id"], "params": ParamSet({k: from_struct(v) for k, v in (t["params"] or {}).items()}), "state": t["state"], "final": t["final"], "reports": []})
        s.used.trials = len(s.records)
        return s

    def history(self) -> History:
        done = []
        for r in self.records:
            values = [sign(d) * (r["final"] or {}).get(n, math.nan) for n, d in self.directions]
            if r["state"] == COMPLETE and not any(math.isnan(v) for v in values):
                done.append((r["params"], values))
        return History(done, len(self.records))

    def optimize(self, objective: Objective, budget: Budget | int) -> Study:
        budget = Budget("trials", len(self.records) + budget) if isinstance(budget, int) else budget
        while not budget.exhausted(self.used):
            n = self.batch if budget.what != "trials" or budget.limit is None else min(self.batch, budget.remaining(self.used))
            history, first, began = self.history(), len(self.records), time.time()
            asked = [self.sampler.suggest(self.space, history, first + k) for k in range(n)]
            ids = [self.store.enqueue_trial(self.study_id, p, trial_seed(self.seed, first + k)) if self.store else first + k for k, p in enumerate(asked)]
            for i in ids if self.store else ():
                self.store.start_trial(i)
            for r in self._evaluate(objective, list(zip(ids, asked, strict=True))):
                self._tell(*r, dict(zip(ids, asked, strict=True))[r[0]])
            self.used.trials += n
            self.used.wall_ms += int((time.time() - began) * 1000)
            if self.store:
                self.store.flush()
        return self

    def vector(self, metrics: dict) -> list[float] | None:
        """The objectives turned so that smaller is better; none where one is missing or NaN."""
        values = [sign(d) * metrics.get(n, math.nan) for n, d in self.directions]
        return None if any(math.isnan(v) for v in values) else values

    def _evaluate(self, objective, batch):
        if self.pruner is None or len(batch) > 1:
            return evaluate(self.spark, objective, batch)
        own: list[float] = []

        trial, params = batch[0]

        def stop(step, metrics):
            own.append(metrics.get(self.directions[0][0], math.nan))
            self.latest = metrics
            if self.store:  # as they come: a crash keeps what the store has flushed
                self.store.report(trial, step, metrics)
            return self.pruner.decide(self, own, step)

        sink = Sink(stop)
        try:
            final = objective(params, sink)
            return [(trial, PRUNED if sink.stopped else COMPLETE, final, sink.reports)]
        except Exception:  # a failed objective is a result
            return [(trial, FAILED, None, sink.reports)]

    def _tell(self, trial, state, final, reports, params) -> None:
        self.records.append({"trial": trial, "params": params, "state": state, "final": final, "reports": reports})
        for step, m in dict(reports).items():
            if state in (COMPLETE, PRUNED):
                self.curves.setdefault(step, []).append(m.get(self.directions[0][0]))
                self.bags.setdefault(step, []).append(m)
        self.used.steps += len(dict(reports))
        self.used.epochs += max((s for s, _ in reports), default=0)
        if self.store:
            for step, m in reports if self.pruner is None or self.batch > 1 else ():
                self.store.report(trial, step, m)
            self.store.complete(trial, state, final)

    def best(self) -> dict | None:
        """The first best completed trial; none for several objectives."""
        if len(self.directions) != 1:
            return None
        (name, d), best = self.directions[0], None
        for r in self.records:
            if r["state"] == COMPLETE and name in (r["final"] or {}) and (best is None or sign(d) * r["final"][name] < sign(d) * best["final"][name]):
                best = r
        return best

    def points(self, spark: SparkSession) -> DataFrame:
        names = [n for n, _ in self.directions]
        rows = [(self.study_id or 0, r["trial"], *[float(r["final"][n]) for n in names]) for r in self.records if r["state"] == COMPLETE and all(n in (r["final"] or {}) for n in names)]
        frame = spark.createDataFrame(rows, "study long, trial long, " + ", ".join(f"`{n}` double" for n in names))
        return pareto.objectives(frame, "study", "trial", self.directions)

    def pareto_front(self, spark: SparkSession) -> DataFrame:
        return pareto.front(self.points(spark))


def replicate(spark: SparkSession | None, objective: Callable[[int], float], n: int, base_seed: int, how: str = "median", trim: float = 0.1) -> tuple[float | None, float]:
    """(value, spread) of an objective over seeds base, base+1, ..., each its own task."""
    results = evaluate(spark, lambda p, _: {"v": objective(p["seed"])}, [(k, ParamSet({"seed": base_seed + k})) for k in range(n)])
    return aggregate([r[2]["v"] for r in results if r[2]], how, trim)


def aggregate(values: list[float], how: str = "mean", trim: float = 0.1) -> tuple[float | None, float]:
    """As operators.stats.robust, for values at hand."""
    v = sorted(x for x in values if not math.isnan(x))
    n = len(v)
    if not n:
        return None, 0.0
    mean = sum(v) / n
    if how == "mean":
        return mean, 0.0 if n < 2 else math.sqrt(sum((x - mean) ** 2 for x in v) / (n - 1) / n)
    m = middle(v)
    spread = 0.0 if n < 2 else 1.4826 * middle(sorted(abs(x - m) for x in v)) / math.sqrt(n)
    if how == "median":
        return m, spread
    cut = int(n * min(max(trim, 0.0), 0.49))
    kept = v[cut : n - cut]
    return sum(kept) / len(kept), spread


def hyperband(space: SearchSpace, sampler: Sampler, objective: Callable[[ParamSet, int], float], max_resource: int, eta: int = 3, direction: str = MINIMIZE, spark: SparkSession | None = None) -> dict:
    """Brackets of successive halving; the best is sought among evaluations at the full resource."""
    from ..operators.fidelity import schedule

    evaluations: list[tuple[ParamSet, int, float]] = []
    pool: list[ParamSet] = []
    for r in schedule(max_resource, eta):
        if r["rung"] == 0:
            done = [(p, [sign(direction) * v]) for p, res, v in evaluations if res == max_resource]
            pool = [sampler.suggest(space, History(done, len(evaluations)), len(evaluations) + k) for k in range(r["configs"])]
        results = evaluate(spark, lambda p, _, res=r["resource"]: {"v": objective(p, res)}, list(enumerate(pool)))
        scores = [x[2]["v"] if x[2] else math.nan for x in results]
        evaluations += [(p, r["resource"], s) for p, s in zip(pool, scores, strict=True)]
        order = sorted(range(len(pool)), key=lambda k: (math.isnan(scores[k]), sign(direction) * scores[k] if not math.isnan(scores[k]) else 0))
        pool = [pool[k] for k in order[: r["keep"]]]
    full = [(p, v) for p, res, v in evaluations if res == max_resource and not math.isnan(v)]
    if not full:
        raise ObjectiveFailed("no evaluation at the full resource")
    best = min(full, key=lambda x: sign(direction) * x[1])
    return {"best": best[0], "value": best[1], "evaluations": len(evaluations), "resource": sum(r for _, r, _ in evaluations)}
