"""Token sequences, hashed and by vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import hash_bucket, tokens


def token_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, token)"""
    return df.select(key, F.posexplode(tokens(F.col(text))).alias("pos", "token"))


def hashed_sequence(df: DataFrame, key: str, text: str, dim: int, length: int) -> DataFrame:
    """(key, pos, bucket) of the first `length` tokens: a one-hot matrix in sparse form, zero beyond its rows."""
    first = F.slice(tokens(F.col(text)), 1, length)
    rows = df.select(key, F.posexplode(first).alias("pos", "token"))
    return rows.select(key, "pos", hash_bucket(F.col("token"), dim).alias("bucket"))


def one_hot(buckets: Column, dim: int, length: int) -> Column:
    """The dense matrix, flat: `length` rows of `dim`, those beyond the tokens all 0."""
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda r: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda c: F.when(F.try_element_at(buckets, r + 1) == c, 1.0).otherwise(0.0))))


def vocabulary(df: DataFrame, text: str, most: int) -> DataFrame:
    """(token, n, id): the most - 1 most frequent tokens, ties by token, with ids from 1; 0 is left for padding."""
    counts = df.select(F.explode(tokens(F.col(text))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "token").limit(max(0, most - 1))
    return top.withColumn("id", F.row_number().over(W.orderBy(F.desc("n"), "token")))


def encode(df: DataFrame, key: str, text: str, vocab: DataFrame, length: int) -> DataFrame:
    """(key, ids): the first `length` tokens as ids, 0 for unknown ones and for padding."""
    rows = df.select(key, F.posexplode_outer(F.slice(tokens(F.col(text)), 1, length)).alias("pos", "token"))
    # The vocabulary's size is a parameter.
    with_id = rows.join(F.broadcast(vocab.select("token", "id")), "token", "left")
    ids = F.transform(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", F.coalesce("id", F.lit(0)).alias("id"))))), lambda s: s["id"])
    out = with_id.groupBy(key).agg(ids.alias("ids"))
    return out.select(key, F.slice(F.concat("ids", F.array_repeat(F.lit(0), length)), 1, length).alias("ids"))


def padded_targets(ids: Column, length: int) -> Column:
    """A target sequence after a 0 that begins it, cut or padded with 0 to `length`."""
    return F.slice(F.concat(F.array(F.lit(0)), ids, F.array_repeat(F.lit(0), length)), 1, length)


def token_accuracy(actual: Column, predicted: Column) -> Column:
    """Percent of places at which two sequences of one length agree."""
    same = F.aggregate(F.zip_with(actual, predicted, lambda a, b: F.when(a == b, 1.0).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(actual) > 0, same / F.size(actual) * 100).otherwise(0.0)
