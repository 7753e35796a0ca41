"""Tables in the shared folder (spark.checkpoint.dir), where iterations cut their lineage.

A result may still read such a table, so they stay until clear() deletes what this process has made.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..schema import StorageError

#: Used only where a session on one machine names no folder, as in tests.
LOCAL = "/tmp/checkpoints/studyloom"
_MADE: list[str] = []


def root(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.conf.get("spark.master", "local").startswith("local"):
        raise StorageError("spark.checkpoint.dir must name a folder that all machines share")
    return (found or LOCAL).rstrip("/")


def path_for(spark: SparkSession, label: str) -> str:
    _MADE.append(f"{root(spark)}/{label}-{uuid.uuid4().hex}")
    return _MADE[-1]


def stage(df: DataFrame, label: str) -> DataFrame:
    spark = df.sparkSession
    path = path_for(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Spark's own switch: shuffle files go when the execution that made them ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write(df: DataFrame, path: str, *partition_by: str) -> None:
    """Write df as the table `path`, in place of what stands there. What was shuffled on the way is deleted as soon as it stands."""
    spark = df.sparkSession
    writer = df.write.mode("overwrite").option("compression", "zstd")
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def slots(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    if path in _MADE:
        _MADE.remove(path)


def clear(spark: SparkSession) -> int:
    """Delete all tables made here so far, once no result reads them any more; how many there were."""
    paths = list(_MADE)
    for path in paths:
        delete(spark, path)
    return len(paths)
