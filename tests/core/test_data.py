import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from studyloom.functions import columns as C
from studyloom.operators import folds, signal, text, vectors
from studyloom.streaming import reports


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).head())


def arr(*x):
    return F.array(*[F.lit(v) for v in x])


def fnv(s):
    h = 0xCBF29CE484222325
    for b in s.encode():
        h = ((h ^ b) * 0x100000001B3) & ((1 << 64) - 1)
    return h


def test_columns(spark):
    words = ["cat", "", "é日本", "a" * 50]
    df = spark.createDataFrame([(w,) for w in words], "w string").select(C.hash_bucket(F.col("w"), 128), C.hash_bucket(F.col("w"), 1000))
    assert [tuple(r) for r in df.collect()] == [(fnv(w) % 128, fnv(w) % 1000) for w in words]
    assert fnv("cat") % 128 == 39
    assert one(spark, C.tokens(F.lit("Hello, world! 42"))) == (["hello", "world", "42"],)
    iou = [C.box_iou(arr(0.0, 0.0, 2.0, 2.0), arr(*b)) for b in ((2.0, 2.0, 0.0, 0.0), (5.0, 5.0, 6.0, 6.0), (1.0, 0.0, 3.0, 2.0))]
    assert one(spark, *iou) == (1.0, 0.0, pytest.approx(1 / 3))
    assert one(spark, *[C.radical_inverse(F.lit(k), 2) for k in range(1, 4)]) == (0.5, 0.25, 0.75)
    two = F.array(arr(1.0, 2.0), arr(3.0, 6.0))
    assert one(spark, C.fuse(two, "mean"), C.fuse(two, "sum"), C.fuse(two, "concat")) == ([2.0, 4.0], [4.0, 8.0], [1.0, 2.0, 3.0, 6.0])


def test_signal(spark):
    tone = [math.sin(2 * math.pi * 4 * k / 32) for k in range(256)]
    s = one(spark, signal.spectrogram(arr(*tone), 256, 32, 16, 16))[0]
    assert all(abs(int(np.argmax(row)) - 4) <= 1 for row in s)
    assert one(spark, signal.frame_pool(arr(1.0, 2.0, 3.0, 4.0), 1, 2, 2, 2), signal.frame_pool(arr(1.0, 2.0, 3.0, 4.0), 1, 2, 2, 1)) == ([1.0, 2.0, 3.0, 4.0], [2.5])
    m = spark.createDataFrame([(1, [0, 1, 1, 0], [0, 1, 0, 0])], "id int, a array<int>, p array<int>")
    assert signal.mean_iou(m, ["id"], "a", "p", 2).head()["miou"] == pytest.approx((2 / 3 + 1 / 2) / 2)
    for table in (signal.linear_schedule(spark, 50), signal.cosine_schedule(spark, 50)):
        rows = table.orderBy("step").collect()
        assert all(a["beta"] <= b["beta"] and a["alpha_bar"] > b["alpha_bar"] for a, b in zip(rows, rows[1:], strict=False))


def test_text(spark):
    df = spark.createDataFrame([(1, "cat dog cat"), (2, "dog bird"), (3, None)], "k int, t string")
    v = text.vocabulary(df, "t", 3)
    assert [(r["token"], r["id"]) for r in v.orderBy("id").collect()] == [("cat", 1), ("dog", 2)]
    assert {r["k"]: r["ids"] for r in text.encode(df, "k", "t", v, 4).collect()} == {1: [1, 2, 1, 0], 2: [2, 0, 0, 0], 3: [0, 0, 0, 0]}
    assert one(spark, text.token_accuracy(arr(1, 2, 3, 4), arr(1, 2, 0, 4))) == (75.0,)


def blobs(spark, n=30, k=3):
    rng = random.Random(1)
    return spark.createDataFrame([(i, [10.0 * (i % k) + rng.uniform(-0.6, 0.6), rng.uniform(-0.6, 0.6)], i % k) for i in range(n)], "id long, v array<double>, label long")


def test_vectors(spark):
    df = blobs(spark)
    assert vectors.silhouette(df, "label") > 0.7
    assigned, centers, inertia = vectors.kmeans(df, 3, 1)
    assert len(centers) == 3 and inertia < 30
    assert assigned.groupBy("label").agg(F.countDistinct("cluster").alias("c")).where("c > 1").isEmpty()
    assert vectors.centroid_accuracy(df, df, "label") == 100.0
    found = vectors.knn_predictions(df, df, 3, "label").join(df, "id")
    assert found.where("predicted <> label").isEmpty()
    scores = vectors.anomaly_scores(df, spark.createDataFrame([(99, [100.0, 100.0]), (98, [0.0, 0.0])], "id long, v array<double>"), 3)
    by = {r["id"]: r["score"] for r in scores.collect()}
    assert by[99] > 50 > by[98]
    assert vectors.nearest_rank(df, "id", 0.5) == 15.0 and vectors.nearest_rank(df.limit(0), "id", 0.5) == 0.0


def test_folds(spark):
    df = spark.range(50)
    sizes = [r["n"] for r in folds.kfold(df, 5, 1).groupBy("fold").agg(F.count("*").alias("n")).collect()]
    assert sizes == [10] * 5
    lab = df.limit(40).withColumn("y", F.col("id") % 2)
    counts = folds.stratified_kfold(lab, 4, 1, "y").groupBy("fold", "y").count().collect()
    assert [r["count"] for r in counts] == [5] * 8
    assert folds.holdout(df, 0.2, 1).where("fold = 0").count() == 10
    each = folds.train_and_test(folds.kfold(df, 5, 1))
    assert each.count() == 250 and each.where("not train").count() == 50
    split = folds.time_folds(spark, 20, 8, 4).collect()
    assert [(r["train_start"], r["train_end"], r["test_end"]) for r in split] == [(0, 8, 12), (0, 12, 16), (0, 16, 20)]
    s = spark.createDataFrame([(0, k, float(k)) for k in range(1, 6)], "g int, t int, y double")
    assert [r["y"] for r in folds.lag_windows(s, 2, ["g"]).orderBy("t").collect()] == [3.0, 4.0, 5.0]
    pairs = spark.createDataFrame([(0, float(k), k + 1.0, 1.0) for k in range(1, 5)], "g int, actual double, predicted double, scale double")
    m = folds.forecast_metrics(pairs, ["g"], naive_scale="scale").head()
    assert (m["mae"], m["mase"], m["pinball"]) == (1.0, 1.0, 0.5)


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = [(1, rng.randrange(5), rng.randrange(3), "loss", rng.random(), k) for k in range(200)]
    rng.shuffle(rows)
    kinds = "study_id long, trial_id long, step long, metric string, value double, seq long"
    for k in range(4):
        spark.createDataFrame(rows[k * 50 : (k + 1) * 50] + rows[:5], kinds).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    source = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = reports.upserts(source).writeStream.format("memory").queryName("ups").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = reports.upserts(spark.createDataFrame(rows, kinds))
    assert sorted(map(tuple, spark.sql("SELECT * FROM ups").collect())) == sorted(map(tuple, batch.collect()))


def test_upserts_of_equal_and_missing_seq(spark):
    """Of equal seq the highest value, whatever the order; reports without any seq have no last value."""
    rows = [(1, 1.0, 5), (1, 3.0, 5), (1, 9.0, 4), (2, 7.0, None), (2, 8.0, None), (3, 2.0, None), (3, 1.0, 0), (4, None, 2), (4, 5.0, 1)]
    df = spark.createDataFrame(rows, "trial_id long, value double, seq long")
    for some in (df, df.orderBy(F.desc("value"))):
        assert {tuple(r) for r in reports.upserts(some, "trial_id").collect()} == {(1, 3.0, 5), (2, None, None), (3, 1.0, 0), (4, None, 2)}


def test_epochs_of_upserts(spark, tmp_path):
    """Reports come late, again and over a restart; a batch that is run again replaces itself."""
    rng = random.Random(4)
    kinds = "trial_id long, step long, metric string, value double, seq long"
    rows = [(rng.randrange(40), rng.randrange(3), "loss", rng.random(), k) for k in range(400)]
    rng.shuffle(rows)
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    write = reports.upsert_writer(out, 4)

    def run():
        q = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
        q.awaitTermination()

    for k in range(4):
        spark.createDataFrame(rows[k * 100 : (k + 1) * 100] + rows[:5], kinds).coalesce(1).write.mode("append").parquet(source)
        if k % 2:
            run()
    known = spark.read.parquet(out)
    assert {r["epoch"] for r in known.select("epoch").distinct().collect()} == {0, 1, 2, 3} and known.groupBy("trial_id").agg({"bucket": "max"}).count() == known.select("trial_id", "bucket").distinct().count()
    key = ("trial_id", "step", "metric")
    last = sorted(map(tuple, reports.upserts(known, *key).collect()))
    assert last == sorted(map(tuple, reports.upserts(spark.createDataFrame(rows, kinds), *key).collect()))
    before = known.count()
    write(spark.createDataFrame(rows[:50], kinds), 4)
    write(spark.createDataFrame(rows[:50], kinds), 4)
    again = spark.read.parquet(out)
    assert before < again.count() <= before + 50 and sorted(map(tuple, reports.upserts(again, *key).collect())) == last


def test_schedules_of_rows(spark):
    from studyloom.operators import fidelity

    for eta in (2, 3, 4):
        got = {}
        for r in fidelity.schedules(spark.range(0, 800).withColumnRenamed("id", "most"), "most", eta).collect():
            got.setdefault(r["most"], []).append((r["bracket"], r["rung"], r["configs"], r["used"], r["keep"]))
        assert 0 not in got
        assert all(sorted(got[m]) == sorted(tuple(x.values()) for x in fidelity.schedule(m, eta)) for m in range(1, 800))


def test_time_folds_of_rows(spark):
    from studyloom.operators import folds

    for sliding in (False, True):
        got = folds.time_folds_of(spark.range(0, 45).withColumnRenamed("id", "n"), "n", 10, 5, 3, sliding).collect()
        for n in (0, 14, 15, 40, 44):
            assert [tuple(r)[1:] for r in got if r["n"] == n] == [tuple(r) for r in folds.time_folds(spark, n, 10, 5, 3, sliding).collect()]


def test_noise_and_positions(spark):
    from studyloom.operators import signal

    df = spark.createDataFrame([(0, [1.0, 2.0], [0.5, -0.5]), (7, [1.0], [1.0])], "step long, x array<double>, e array<double>")
    levels = {r["step"]: r["alpha_bar"] for r in signal.linear_schedule(spark, 5).collect()}
    got = {r["step"]: r["noised"] for r in signal.noised(df, signal.linear_schedule(spark, 5), "x", "e", "step").collect()}
    assert got[7] is None and got[0] == [levels[0] ** 0.5 * x + (1 - levels[0]) ** 0.5 * e for x, e in ((1.0, 0.5), (2.0, -0.5))]
    table = {(r["pos"], r["dim"]): r["value"] for r in signal.sinusoidal(spark, 4, 6).collect()}
    from pyspark.sql import functions as F

    for r in spark.range(4).select("id", signal.position_code(F.col("id"), 6).alias("c")).collect():
        assert all(abs(v - table[r["id"], d]) < 1e-12 for d, v in enumerate(r["c"]))


def test_streams_of_reports(spark, tmp_path):
    """Running bests, throughput and stop decisions of a folder that grows, each against a batch."""
    from studyloom.streaming import reports

    kind = "study_id long, trial_id long, step long, metric string, value double, seq long, at timestamp"
    rows = [(1 + k % 2, k % 5, k // 5, "v", float((7 * k) % 11) if k % 6 else float("nan"), k, f"2024-01-01 00:{k:02d}:00") for k in range(40)]
    df = spark.createDataFrame(rows, kind.replace("timestamp", "string")).withColumn("at", __import__("pyspark").sql.functions.to_timestamp("at"))
    for k in range(4):
        df.where(f"seq div 10 = {k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")

    def run(query, mode, name):
        q = query.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(map(tuple, spark.table(name).collect()))

    best = run(reports.running_best(stream(), "v", "minimize"), "complete", "best_now")
    assert best == sorted(map(tuple, reports.running_best(df, "v", "minimize").collect()))
    seen = run(reports.throughput(stream(), "at", "10 minutes", "1 hour"), "complete", "throughput_now")
    assert [(r[0], r[2]) for r in seen] == [(s, 5) for s in (1, 2) for _ in range(4)]
    peers = lambda: spark.createDataFrame([(1, k, 4.0, 3) for k in range(9)], "study_id long, step long, middle double, n long")
    sink = reports.stop_sink(f"{tmp_path}/stops", peers, "v", "minimize")
    q = stream().writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
    q.awaitTermination()
    stopped = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/stops").select("study_id", "trial_id").collect()}
    last = {}
    for s, t, step, _, v, seq, _ in rows:
        last.setdefault((seq // 10, s, t), []).append((step, v))
    assert stopped == {(s, t) for (_, s, t), own in last.items() if s == 1 and max(own)[1] > 4.0}


def test_lease_timers(spark, tmp_path):
    import time

    from studyloom.streaming import reports

    now = int(time.time() * 1000)
    df = spark.createDataFrame([(1, "a", now + 2500), (2, "b", now + 600_000)], "trial_id long, owner string, expiry_ms long")
    df.write.parquet(f"{tmp_path}/in")
    q = reports.lease_timers(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("timers").outputMode("append").option("checkpointLocation", f"{tmp_path}/at").start()
    try:
        for _ in range(120):
            time.sleep(0.5)
            got = {(r["trial_id"], r["state"]) for r in spark.table("timers").collect()}
            if (1, "Waiting") in got:
                break
    finally:
        q.stop()
    assert got == {(1, "Running"), (2, "Running"), (1, "Waiting")}


def test_distances_of_blocks():
    """One product for a block, and no digits lost where vectors are near or equal."""
    import numpy as np

    rng = np.random.default_rng(7)
    q = rng.normal(100, 1, (50, 8))
    rows = np.concatenate([q[:20], q[20:40] + 1e-9, rng.normal(100, 1, (30, 8))])
    wanted = np.sqrt(((rows[:, None] - q) ** 2).sum(2))
    np.testing.assert_allclose(vectors.distances(rows, q, (q * q).sum(1)), wanted, rtol=1e-7, atol=0)
    assert vectors.distances(rows[:0], q, (q * q).sum(1)).shape == (0, 50)
