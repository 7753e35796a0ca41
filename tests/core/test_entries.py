import __spark_entry__ as entries


def test_registered():
    q, sql = entries.queries(), entries.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 50


def test_entry(spark):
    out = entries.entry(spark)
    assert out.columns == ["study_id", "trial_id", "value"] and out.count() == 5


def test_scratch_tables_can_be_cleared(spark):
    import os

    import pytest

    from studyloom.plans import scratch
    from studyloom.schema import StorageError

    scratch.clear(spark)
    for name in ("best_so_far", "robust_trimmed", "non_dominated_ranks"):
        entries.queries()[name](spark, "/root/testdata/sf0.001").collect()
    made = [p.removeprefix("file:") for p in scratch._MADE]
    assert len(made) > 5 and all(os.path.isdir(p) for p in made)
    assert scratch.clear(spark) == len(made) and not any(os.path.exists(p) for p in made) and scratch.clear(spark) == 0

    class Cluster:
        conf = {"spark.master": "spark://host:7077"}

    with pytest.raises(StorageError):
        scratch.root(Cluster)


def test_report_state_and_parts(spark, monkeypatch):
    """Reports come in parts of a bounded number of rows, and a stream's state stays on disk."""
    from studyloom import entries
    from studyloom.streaming import reports as stream

    lines = spark.range(90).withColumnRenamed("id", "k")
    assert entries.by_trial(lines, "k") is lines
    monkeypatch.setattr(entries, "TASK_ROWS", 10)
    assert entries.by_trial(lines, "k").rdd.getNumPartitions() == 9
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    with stream.state_on_disk(spark):
        assert "RocksDB" in spark.conf.get(key)
    assert spark.conf.get(key) == before


def test_report_stream_leaves_only_its_result(spark, monkeypatch):
    """Several micro-batches and passes give what the batch query gives; no source, state or checkpoint stays on disk."""
    import os

    from studyloom import entries as core
    from studyloom.plans import scratch

    monkeypatch.setattr(core, "TASK_ROWS", 300)
    monkeypatch.setattr(core, "PASS_ROWS", 2000, raising=False)
    scratch.clear(spark)
    got = entries.queries()["report_stream_upsert"](spark, "/root/testdata/sf0.001")
    left = [p for p in scratch._MADE if os.path.isdir(p.removeprefix("file:"))]
    assert len(left) == 1 and set(got.columns) == {"study_id", "trial_id", "step", "metric", "value"}
    key = ["study_id", "trial_id", "step", "value"]
    want = entries.queries()["reports_upsert"](spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, want.select(key).collect()))
    assert got.where("metric = 'price'").count() == got.count()
    scratch.clear(spark)
