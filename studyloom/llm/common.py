"""Helpers shared by the training-data operators: scratch storage, ids, ASCII folding."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Used only where a session on one machine names no shared folder, as in tests.
LOCAL_SCRATCH = "/tmp/checkpoints/studyloom"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir), or one of our own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return found or LOCAL_SCRATCH


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{scratch_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that no later step reads, through the file system that holds them."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Spark's own switch: shuffle files go when the execution that made them ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, label: str, *partition_by: str, compression: str = "zstd") -> tuple[DataFrame, str]:
    """Write df as a table in the shared folder and read it back: cuts the lineage, survives lost executors. What was
    shuffled on the way is deleted as soon as the table stands."""
    spark = df.sparkSession
    path = scratch(spark, label)
    writer = df.write.mode("overwrite").option("compression", compression)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


class Tables:
    """The scratch tables of one operator. finish() writes its result as a table and deletes all others."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def stage(self, df: DataFrame, label: str, *partition_by: str) -> DataFrame:
        out, path = stage(df, label, *partition_by)
        self.paths.append(path)
        return out

    def drop(self, path: str) -> None:
        """Delete one table now."""
        self.paths.remove(path)
        drop_path(self.spark, path)

    def finish(self, df: DataFrame, label: str) -> DataFrame:
        out, _ = stage(df, label)
        drop_path(self.spark, *self.paths)
        return out


_REMEMBERED: dict[str, dict] = {}


def memory(owner: str) -> dict:
    """What `owner` remembers in this worker process. A worker serves all stages of a pipeline in turn; the first use by
    another owner drops what the one before has gathered, so a worker holds the memory of one stage at most."""
    if owner not in _REMEMBERED:
        _REMEMBERED.clear()
        _REMEMBERED[owner] = {}
    return _REMEMBERED[owner]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only. lower() does the same where every character is one byte."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def doc_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with a null text as the empty one; other columns, whatever their names, are left behind."""
    return df.select(df[id_col].cast("long").alias("doc_id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"))


def crc32_of_id(col: Column) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(col.cast("string"), F.lit("")), "UTF-8"))


def slots(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
