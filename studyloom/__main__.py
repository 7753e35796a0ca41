"""python -m studyloom list|importance|dashboard|worker STORE ..."""

from __future__ import annotations

import argparse
import importlib
import os

from pyspark.sql import SparkSession

from .dashboard import render
from .operators import history, stats
from .plans.coord import Worker
from .sources.store import Store, now_ms


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="studyloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name, more in (("list", ()), ("importance", ("study", "objective")), ("dashboard", ("study", "objective", "out")), ("worker", ("study", "target"))):
        c = sub.add_parser(name)
        c.add_argument("store")
        for m in more:
            c.add_argument(m)
        if name == "dashboard":
            c.add_argument("--direction", default="minimize")
        if name == "worker":
            c.add_argument("--ttl-ms", type=int, default=30_000)
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    store = Store(spark, a.store)
    if a.command == "list":
        lines = {r["study_id"]: r["line"] for r in history.summarize(store.trials_frame()).collect()}
        for i in store.study_ids():
            print(f"{i}\t{store.load_meta(i)['name']}\t{lines.get(i, '0 trials')}")
    elif a.command == "importance":
        trials, _ = store.load_history(int(a.study))
        for r in stats.importance(stats.long_params(trials, a.objective)).orderBy("importance", ascending=False).collect():
            print(f"{r['name']}\t{r['importance']:.4f}")
    elif a.command == "dashboard":
        trials, _ = store.load_history(int(a.study))
        with open(a.out, "w", encoding="utf-8") as f:
            f.write(render(trials, a.objective, a.direction, store.load_meta(int(a.study))["name"]))
    else:
        module, _, name = a.target.partition(":")
        done = Worker(store, int(a.study), f"pid-{os.getpid()}", a.ttl_ms, now_ms).run_until_idle(getattr(importlib.import_module(module), name))
        store.flush()
        print(f"ran {done} trials")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
