import random

from studyloom.streaming import stops

SCHEMA = "study_id string, trial_id long, step long, value double, peer boolean"


def reports(seed):
    rng = random.Random(seed)
    peers = [(s, t, k, rng.choice([rng.random(), float("nan")]) if t == 3 else rng.random(), True) for s in "ab" for t in range(1, 9) for k in range(1, 5)]
    asked = [(s, t, k, rng.random() if rng.random() < 0.95 else float("nan"), False) for s in "abc" for t in range(50, 75) for k in range(1, 5)]
    return peers, asked


def test_stream_equals_replay_over_a_restart(spark, tmp_path):
    peers, asked = reports(1)
    source, out, checkpoint = (f"{tmp_path}/{x}" for x in ("source", "out", "checkpoint"))

    def put(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)

    run = lambda: {tuple(r) for r in stops.run_to_end(spark, source, SCHEMA, out, checkpoint, direction="minimize", min_trials=3).collect()}
    put(peers)
    assert run() == set()
    first, second = [r for r in asked if r[2] <= 2], [r for r in asked if r[2] > 2]
    put(first)
    early = run()
    put(second + first[:20])  # some reports come again
    late = run()  # a new query on the same checkpoint
    assert early and early < late and len({r[:2] for r in late}) == len(late)
    whole = spark.createDataFrame(peers + asked, SCHEMA)
    assert late == {tuple(r) for r in stops.replay(whole, "minimize", min_trials=3).collect()}
    assert run() == late  # nothing new, nothing twice


def test_replay_by_hand(spark):
    rows = [("a", 1, 1, 1.0, True), ("a", 2, 1, 3.0, True), ("a", 9, 1, 2.0, False), ("a", 8, 1, 2.5, False), ("a", 8, 2, 9.0, False), ("a", 7, 1, 1.0, False)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r) for r in stops.replay(df, "minimize").collect()] == [("a", 8, 1, 2.5, 2.0)]
    assert [tuple(r) for r in stops.replay(df, "maximize").collect()] == [("a", 7, 1, 1.0, 2.0)]
    assert stops.replay(df, "minimize", warmup=2).count() == 0 and stops.replay(df, "minimize", min_trials=3).count() == 0


def test_peers_spread_over_tasks(spark, tmp_path):
    """Peers come in files of several epochs, kept as a table; the last value of one that reports again counts."""
    rng = random.Random(5)
    source, out, checkpoint = (f"{tmp_path}/{x}" for x in ("source", "out", "checkpoint"))
    old = [("a", t, 1, rng.random() + 5, True) for t in range(3000)]
    new = [("a", t, 1, rng.random(), True) for t in range(3000)]
    asked = [("a", 5000 + t, 1, rng.random(), False) for t in range(50)]
    for rows in (old, new, asked):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        got = stops.run_to_end(spark, source, SCHEMA, out, checkpoint, direction="minimize")
    assert spark.read.parquet(f"{checkpoint}/peers").count() == 6000
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in stops.replay(spark.createDataFrame(new + asked, SCHEMA), "minimize").collect()}
