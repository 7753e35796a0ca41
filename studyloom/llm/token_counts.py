"""Token counts through a digest cache.

Counts are kept in a table keyed by (digest of the normalised content, digest of the
tokenizer's version). A call joins its documents with that table, encodes each distinct
content that is missing once, and appends the new counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, doc_text, documents, scratch
from .tokenizer_files import default_path, encoder, lower_and_space, version_digest

CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens long"
LIMIT = 2048


def normalised(text, path: str):
    """Content whose tokens are the same: ASCII case and runs of ASCII white space folded where the file
    folds them anyway and the text cannot hold a special string, else the text itself."""
    if path.endswith(".model"):
        return text
    import json

    with open(path, encoding="utf-8") as f:
        if not lower_and_space(json.load(f)):
            return text
    return F.when(F.contains(text, F.lit("<|")), text).otherwise(F.trim(F.regexp_replace(ascii_lower(text), "[\\x20\\x09-\\x0D]+", " ")))


def read_cache(spark: SparkSession, cache_path: str, tokenizer_digest: str) -> DataFrame:
    """Counts stored for this tokenizer version; an empty table where there is no cache yet."""
    p = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], CACHE_SCHEMA).drop("tokenizer_digest")
    rows = spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    # Two calls at once may both append a digest; the counts are equal.
    return rows.where(F.col("tokenizer_digest") == tokenizer_digest).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, cache_path: str, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, content_digest), one row per input row.

    A null text counts as empty: 0 bytes, 0 tokens. Rows that repeat an id each give a row, null ids
    too; an empty table gives no rows. Long texts are counted whole. Other columns are not read.
    """
    spark = docs.sparkSession
    version = version_digest(path)
    rows = doc_text(docs, id_col, text_col)
    digest = F.unhex(F.sha2(normalised(F.col("text"), path), 256)).alias("content_digest")
    cache = read_cache(spark, cache_path, version)
    keyed = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), digest, "text")
    missing = keyed.select("content_digest", "text").join(cache.select("content_digest"), "content_digest", "left_anti")
    # One text for each digest; copies meet before the shuffle, so a large group costs a row per task.
    distinct = missing.groupBy("content_digest").agg(F.first("text").alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for whole in batches:
            for k in range(0, whole.num_rows, 400):
                b = whole.slice(k, 400)
                n = [len(x) // enc.dtype.itemsize for x in enc.ids(b.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column("content_digest"), pa.array([version] * b.num_rows, pa.string()), pa.array(n, pa.int64())], ["content_digest", "tokenizer_digest", "n_tokens"])

    distinct.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").option("compression", "zstd").parquet(cache_path)
    counts = read_cache(spark, cache_path, version)
    return keyed.drop("text").join(counts, "content_digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "content_digest")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query starts with a cache of its own, so that every content of the table is encoded once."""
    out = count_tokens(documents(spark, sf_dir), scratch(spark, "token-cache"), default_path("word_bpe_49k.json"))
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit")
