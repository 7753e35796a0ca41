import pytest
from pyspark.sql import functions as F

from studyloom.sources.datasource import NAME, register
from studyloom.sources.store import Store


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    register(spark)
    root = str(tmp_path_factory.mktemp("source") / "store")
    store = Store(spark, root, clock=lambda: 1)
    for s in range(2):
        study = store.create_study(f"s{s}", [("v", "minimize")])
        for k in range(3):
            t = store.enqueue_trial(study, {"x": k})
            store.report(t, 1, {"v": 10.0 * s + k})
        store.flush()
    return root


def rows(df):
    return sorted(map(tuple, df.select("study_id", "trial_id", "step", "value").collect()))


def test_read_and_filters(spark, root):
    df = spark.read.format(NAME).option("table", "reports").load(root)
    assert rows(df) == rows(Store(spark, root).reports_frame()) and df.count() == 6
    one = df.where("study_id = 2 and value > 10.5")
    assert rows(one) == [(2, 5, 1, 11.0), (2, 6, 1, 12.0)]
    first = Store(spark, root).snapshot.version - 1
    assert spark.read.format(NAME).option("version", first).load(root).count() == 3
    trials = spark.read.format(NAME).option("table", "trials").load(root)
    assert trials.where("trial_id = 4").select("state", F.col("params")["x"]["i"].alias("x")).collect() == [("Waiting", 0)]
    with pytest.raises(Exception, match="no such table"):
        spark.read.format(NAME).option("table", "nothing").load(root).count()


def test_write_and_stream(spark, root, tmp_path):
    stream = lambda: spark.readStream.format(NAME).option("table", "reports").load(root).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start().awaitTermination()
    out = lambda: spark.read.parquet(f"{tmp_path}/out")
    stream()
    before = rows(out())
    assert before == rows(spark.read.format(NAME).load(root))
    more = spark.createDataFrame([(1, 1, s, "v", float(s), 100 + s) for s in range(2, 6)], "study_id long, trial_id long, step long, metric string, value double, seq long").repartition(3)
    more.write.format(NAME).option("table", "reports").mode("append").save(root)
    assert rows(spark.read.format(NAME).load(root)) == sorted(before + rows(more))
    stream()
    assert rows(out()) == sorted(before + rows(more))
    store = Store(spark, root)
    assert store.reports_frame().count() == 10
    store.compact()
    stream()  # a compaction brings nothing new
    assert out().count() == 10
    broken = more.withColumn("value", F.when(F.col("step") == 5, F.raise_error(F.lit("no")).cast("double")).otherwise(F.col("value")))
    with pytest.raises(Exception, match="no"):
        broken.write.format(NAME).option("table", "reports").mode("append").save(root)
    assert Store(spark, root).reports_frame().count() == 10 and Store(spark, root).snapshot.version == store.snapshot.version
