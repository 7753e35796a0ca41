"""The corpus pipeline: toxic documents go, then exact and near copies, then documents that hold
benchmark passages; what stays is encoded.

Each stage takes (spark, docs, sf_dir) and returns the rows of docs that it keeps, with their
columns; the last returns token digests. Toxicity is decided row by row. In the other
decisions rows that share an id are one document and stay if one of them does (with
a benchmark passage, if none has one), except that of equal texts one row stays.
A null id is an id like any other here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studyloom.llm.byte_bpe import encode_digests
from studyloom.llm.common import ascii_lower, drop_path, stage
from studyloom.llm.decontaminate import contaminated
from studyloom.llm.exact_dedup import grace_dedup
from studyloom.llm.near_dedup import near_duplicates
from studyloom.llm.tokenizer_files import default_path
from studyloom.llm.toxicity import THRESHOLD, fold_held_out, score_of, train

#: SQL cannot state the toxicity model, the sketches or the encoder; tests hold the stages against brute force.
ORACLE_SQL = None


def keep(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of docs whose id is (left_semi) or is not (left_anti) among ids, null matching null."""
    ids = ids.select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["_kept_id"]), how)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scorer = train(docs, labels, fold_held_out())
    return docs.where(score_of(scorer, F.col("text")) < THRESHOLD)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = grace_dedup(docs)
    kept = found.where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    content = F.sha2(ascii_lower(F.coalesce("text", F.lit(""))), 256)
    marked = docs.withColumn("_sha_own", content)
    same = marked["doc_id"].eqNullSafe(F.col("_id")) & (F.col("_sha_own") == F.col("_sha"))
    stays = marked.join(kept, same, "left_semi")
    # Rows that share an id and a text with the one that stays; those are few.
    twice = found.groupBy("doc_id", "text_sha256").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    again = stays["doc_id"].eqNullSafe(F.col("_id")) & (F.col("_sha_own") == F.col("_sha"))
    single, several = stays.join(twice, again, "left_anti"), stays.join(twice, again, "left_semi").dropDuplicates(["doc_id", "_sha_own"])
    return single.unionByName(several).drop("_sha_own")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep(docs, near_duplicates(docs, width=5, num=80, den=100).where("kept").select("doc_id"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found, _ = stage(contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id"), "pipeline-leaks")
    return keep(docs, found, "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_digests(docs, default_path("byte_bpe_multi_50k.tiktoken"))


STAGES = [("toxicity", toxic), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", benchmark), ("byte_bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, function in STAGES[:-1]:
        docs, new = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
        if path:
            drop_path(spark, path)
        path = new
    return STAGES[-1][1](spark, docs, sf_dir)
