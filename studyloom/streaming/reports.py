"""Reports as a stream: idempotent upserts, running bests, stop decisions and lease timeouts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import scratch
from ..schema import sign

LEASES = "trial_id long, owner string, state string, at_ms long"
KEY = ("study_id", "trial_id", "step", "metric")


#: The default store copies all of its map for each micro-batch; this one writes what has changed.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, so a micro-batch costs what it brings, not what is there."""
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def upserts(stream: DataFrame, *key: str) -> DataFrame:
    """One row per (study, trial, step, metric), or what key says: the report with the highest seq, however late or often it
    comes; of equal ones the highest value. For a stream in update or complete mode, or a batch."""
    key = key or KEY
    last = stream.groupBy(*key).agg(F.max(F.struct("seq", "value")).alias("last"))
    return last.select(*key, F.when(F.col("last.seq").isNotNull(), F.col("last.value")).alias("value"), "last.seq")


def bucket_of(trial: str, buckets: int) -> Column:
    """Not by hash(), by which Spark deals rows to tasks: the rows of a bucket would meet in few of them."""
    return F.pmod(F.xxhash64(trial), F.lit(buckets)).cast("int")


def upsert_writer(out: str, buckets: int) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the last report of each (trial, step, metric) of a micro-batch, in a folder of its own and there in buckets by trial.
    The folders are the state: a batch that is run again replaces its own, and upserts() over all of them has the last report of each key."""

    def write(batch: DataFrame, epoch: int) -> None:
        rows = batch.withColumn("bucket", bucket_of("trial_id", buckets)).repartitionById(buckets, "bucket")
        scratch.write(upserts(rows, "bucket", "trial_id", "step", "metric"), f"{out}/epoch={epoch}", "bucket")

    return write


def running_best(stream: DataFrame, objective: str, direction: str) -> DataFrame:
    best = F.min_by if sign(direction) > 0 else F.max_by
    own = stream.where((F.col("metric") == objective) & ~F.isnan("value"))
    return own.groupBy("study_id").agg(best("trial_id", "value").alias("trial_id"), (F.min if sign(direction) > 0 else F.max)("value").alias("best"))


def throughput(stream: DataFrame, at: str, width: str, late: str) -> DataFrame:
    """Reports per study and time window; what comes later than `late` behind the newest is dropped."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), "study_id").agg(F.count("*").alias("reports")).select("study_id", F.col("window.start").alias("start"), "reports")


def decide(batch: DataFrame, peers: DataFrame, objective: str, direction: str, warmup: int = 1) -> DataFrame:
    """(study_id, trial_id) to stop after a micro-batch of reports; peers: (study_id, step, middle, n)."""
    s = float(sign(direction))
    latest = batch.where(F.col("metric") == objective).groupBy("study_id", "trial_id").agg(F.max("step").alias("step"), F.max_by("value", "step").alias("value"))
    # A NaN is larger than any number to Spark, but stops nothing.
    worse = (s * F.col("value") > s * F.col("middle")) & ~F.isnan("value")
    hit = latest.join(peers, ["study_id", "step"]).where((F.col("step") >= warmup) & (F.col("n") > 0) & worse)
    return hit.select("study_id", "trial_id").distinct()


def stop_sink(path: str, peers: Callable[[], DataFrame], objective: str, direction: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch's stop decisions as a folder of its own, so that a batch that is run again
    replaces itself. Once a trial is there it stays stopped."""

    def write(batch: DataFrame, epoch: int) -> None:
        decide(batch, peers(), objective, direction).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def lease_timeouts(events: DataFrame, now_ms: int) -> DataFrame:
    """(trial_id, state) of running trials by their latest lease event (trial_id, owner, expiry_ms, seq): Waiting
    once the expiry has passed, else Running. In a stream, now_ms is the batch's time."""
    last = events.groupBy("trial_id").agg(F.max_by("expiry_ms", "seq").alias("expiry_ms"), F.max_by("owner", "seq").alias("owner"))
    return last.select("trial_id", "owner", F.when(F.col("expiry_ms") <= now_ms, "Waiting").otherwise("Running").alias("state"))


def lease_timers(stream: DataFrame) -> DataFrame:
    """(trial_id, owner, state, at_ms): Running at each heartbeat (trial_id, owner, expiry_ms), Waiting when a
    lease has run out without another; processing-time timers."""
    import pandas as pd

    def step(key, frames, state):
        if state.hasTimedOut:
            owner, expiry = state.get
            state.remove()
            yield pd.DataFrame({"trial_id": [key[0]], "owner": [owner], "state": ["Waiting"], "at_ms": [expiry]})
            return
        rows = pd.concat(list(frames))
        last = rows.loc[rows["expiry_ms"].idxmax()]
        old = state.get if state.exists else (None, 0)
        expiry = max(int(last["expiry_ms"]), old[1])
        state.update((last["owner"], expiry))
        state.setTimeoutDuration(max(1, expiry - state.getCurrentProcessingTimeMs()))
        yield pd.DataFrame({"trial_id": [key[0]], "owner": [last["owner"]], "state": ["Running"], "at_ms": [expiry]})

    return stream.groupBy("trial_id").applyInPandasWithState(step, LEASES, "owner string, expiry_ms long", "append", "ProcessingTimeTimeout")
