"""Stop decisions over a stream: what peers reported at each step, and each trial's first stop, which stays.

A stream of reports (study_id, trial_id, step, value, peer) is judged a micro-batch at a time. Both states are tables in epochs, a
folder for each micro-batch: peers' values (`peers` in the checkpoint) and stops (the output). A batch adds its peers, takes exact medians of all values
known at the steps it asks about, and writes the stops of trials that have none yet. So the peers of a step spread over tasks
however many there are. A batch that is run again replaces its folders; a later run with the same checkpoint goes on from them.
Peers of a micro-batch are taken in before its other reports are judged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.select import matched, medians
from ..plans import scratch
from ..schema import sign

PEERS = "study_id string, trial_id long, step long, value double"
VERDICTS = "study_id string, trial_id long, step long, value double, middle double"


def epochs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, epoch long").parquet(path)


def judged(peers: DataFrame, asked: DataFrame, direction: str, warmup: int, min_trials: int) -> DataFrame:
    """(study_id, trial_id, step, value, middle): the first report of each trial that is strictly worse than the median of at least
    min_trials peers at its step, from step warmup on. NaN values of peers count as peers but not in the median; a report that is NaN
    stops nothing."""
    at = ["study_id", "step"]
    known = matched(peers.groupBy(*at).agg(F.count("*").alias("_n")), medians(peers, at, "value", "middle").drop("n"), at)
    s = float(sign(direction))
    worse = matched(asked, known, at).where((F.col("step") >= warmup) & (F.col("_n") >= max(1, min_trials)) & (s * F.col("value") > s * F.col("middle")) & ~F.isnan("value"))
    first = worse.groupBy("study_id", "trial_id").agg(F.min(F.struct("step", "value", "middle")).alias("f"))
    return first.select("study_id", "trial_id", "f.*")


def stop_writer(spark: SparkSession, out: str, peers: str, direction: str, warmup: int = 1, min_trials: int = 1) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: stops as judged() has them, each trial's once, in folders of `out`; what peers have reported in folders of `peers`.
    Of several values of a peer at one step the last micro-batch's counts."""
    for path, schema in ((out, VERDICTS), (peers, PEERS)):
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/epoch=-1")

    def write(batch: DataFrame, epoch: int) -> None:
        session = batch.sparkSession
        own = batch.select(F.col("study_id").cast("string"), F.col("trial_id").cast("long"), F.col("step").cast("long"), F.col("value").cast("double"), F.col("peer").cast("boolean"))
        key = ["study_id", "step", "trial_id"]
        more = own.where("peer").groupBy(*key).agg(F.max("value").alias("value"))
        more.select("study_id", "trial_id", "step", "value").write.mode("overwrite").parquet(f"{peers}/epoch={epoch}")
        asked = own.where("not peer").drop("peer")
        known = epochs(session, peers, PEERS).where(F.col("epoch") <= epoch)
        steps = asked.select("study_id", "step").distinct()
        last = known.join(steps, ["study_id", "step"], "leftsemi").groupBy(*key).agg(F.max_by("value", "epoch").alias("value"))
        stopped = epochs(session, out, VERDICTS).where(F.col("epoch") < epoch).select("study_id", "trial_id")
        fresh = judged(last, asked, direction, warmup, min_trials).join(stopped, ["study_id", "trial_id"], "leftanti")
        fresh.select("study_id", "trial_id", "step", "value", "middle").write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return write


def run_to_end(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str, files_at_once: int = 1, **options) -> DataFrame:
    """Reads a folder of report files in the order of their names' arrival, writes stops to `out` (each once, also if the run is
    broken off and started again with the same checkpoint) and returns what stands there."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)
    write = stop_writer(spark, out, f"{checkpoint}/peers", **options)
    q = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return epochs(spark, out, VERDICTS).drop("epoch")


def replay(reports: DataFrame, direction: str, warmup: int = 1, min_trials: int = 1) -> DataFrame:
    """The same stops from a table in which all peers have reported before."""
    return judged(reports.where("peer"), reports.where("not peer"), direction, warmup, min_trials)


def scratch_folders(spark: SparkSession) -> tuple[str, str, str]:
    return tuple(scratch.path_for(spark, f"stops-{x}") for x in ("source", "out", "checkpoint"))
