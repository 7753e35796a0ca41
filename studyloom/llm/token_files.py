"""Token-id files: whole documents as ids in ascending order of id, coded by rans.py.

A file set is a folder of
  table/   one row: the frequency table all blocks share, and the ids' width
  blocks/  rows (part, block, start_in_part, doc_ids, lengths, payload); part p's rows lie in
           one file and parts follow each other in ascending doc_id order. payload is a
           block as described in rans.py and holds the ids of whole documents.
Both are written and read through Spark, so they can lie in any store that Spark reads.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import doc_text, documents, drop_path, scratch, slots, stage
from .tokenizer_files import default_path, encoder
from .words import pack, unpack

BLOCK_IDS = 1 << 16
STAGED = "doc_id long, n_tokens long, ids binary, counts binary"
BLOCKS = "part int, block int, start_in_part long, doc_ids array<long>, lengths array<long>, payload binary"


def tokenise(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """A row for each document, and one for each task with how often it met each id (counts, packed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        enc = encoder(path)
        end = np.asarray([end_id], enc.dtype).tobytes()
        total = np.zeros(max(enc.vocab, end_id + 1), np.int64)
        for whole in batches:
            for k in range(0, whole.num_rows, 400):
                b = whole.slice(k, 400)
                own = [x + end for x in enc.ids(b.column("text").to_pylist())]
                total += np.bincount(np.frombuffer(b"".join(own), enc.dtype), minlength=len(total))
                own = [np.frombuffer(x, enc.dtype) for x in own]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(map(len, own), pa.int64()), pa.array([pack(x) for x in own], pa.binary()), pa.nulls(b.num_rows, pa.binary())], ["doc_id", "n_tokens", "ids", "counts"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([pack(total)], pa.binary())], ["doc_id", "n_tokens", "ids", "counts"])

    return doc_text(docs, id_col, text_col).mapInArrow(run, STAGED)


def frequencies(staged: DataFrame) -> DataFrame:
    """(id, n) over all rows; a task sends each id once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        total = np.zeros(0, np.int64)
        for b in batches:
            for x in b.column("counts"):
                own = unpack(x.as_py())
                total = own + total if len(total) else own
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    return staged.where("counts is not null").select("counts").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_token_files(docs: DataFrame, out: str, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, append end_id, and write the file set `out`.

    A null text is empty and is written as end_id alone; a null id comes before all others; rows that
    repeat an id follow each other, in the order of their ids' bytes; a document, however long, stays in
    one block; an empty table gives a file set without blocks. Other columns are not read.
    """
    import numpy as np

    from . import rans

    spark = docs.sparkSession
    enc = encoder(path)
    width, vocab = enc.dtype.itemsize, max(enc.vocab, end_id + 1)
    staged, staged_path = stage(tokenise(docs, path, end_id, id_col, text_col), "token-ids", compression="none")
    counts = np.zeros(vocab, np.int64)
    for i, n in frequencies(staged).collect():  # as many rows as the vocabulary at most
        counts[i] = n
    table = rans.Table.scaled(counts).dump()
    spark.createDataFrame([(bytearray(table), width)], "freq binary, width int").coalesce(1).write.parquet(f"{out}/table")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from . import rans

        shared, part, start, number = rans.Table.load(table), None, 0, 0
        ids: list = []
        size, pending = 0, []

        def flush():
            nonlocal number, start, pending
            coded = rans.encode_blocks([np.concatenate([x for _, x in docs]) for docs in pending], shared)
            rows = []
            for docs, payload in zip(pending, coded, strict=True):
                lengths = [len(x) for _, x in docs]
                rows.append((part, number, start, [i for i, _ in docs], lengths, payload))
                number += 1
                start += sum(lengths)
            pending = []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["part", "block", "start_in_part", "doc_ids", "lengths", "payload"])

        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        for b in batches:
            for p, i, x in zip(b.column("part").to_pylist(), b.column("doc_id").to_pylist(), b.column("ids"), strict=True):
                part = p
                ids.append((i, unpack(x.as_py())))
                size += len(ids[-1][1])
                if size >= BLOCK_IDS:
                    pending.append(ids)
                    ids, size = [], 0
                    if len(pending) == 16:
                        yield flush()
        if ids:
            pending.append(ids)
        if pending:
            yield flush()

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("ids"), F.col("ids")]
    ordered = staged.where("ids is not null").select("doc_id", "ids").repartitionByRange(slots(spark), *order[:2]).sortWithinPartitions(*order)
    ordered.withColumn("part", F.spark_partition_id()).mapInArrow(run, BLOCKS).write.option("compression", "none").parquet(f"{out}/blocks")
    drop_path(spark, staged_path)


def read_token_files(spark: SparkSession, out: str, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) from a file set; blocks are decoded side by side.

    start counts the ids of all documents before, over all parts.
    """
    import numpy as np

    head = spark.read.parquet(f"{out}/table").first()
    table = bytes(head["freq"])
    blocks = spark.read.schema(BLOCKS).parquet(f"{out}/blocks")
    # As many rows as the file set has parts.
    totals = blocks.groupBy("part").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    base = totals.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from . import rans

        shared = rans.Table.load(table)
        for whole in batches:
            for k in range(0, whole.num_rows, 16):
                b = whole.slice(k, 16)
                rows = []
                decoded = rans.decode_blocks(b.column("payload").to_pylist(), shared)
                for part, start, doc_ids, lengths, x in zip(b.column("part").to_pylist(), b.column("start_in_part").to_pylist(), b.column("doc_ids").to_pylist(), b.column("lengths").to_pylist(), decoded, strict=True):
                    x, at = x.astype("<u4"), 0
                    for i, n in zip(doc_ids, lengths, strict=True):
                        own = x[at : at + n]
                        rows.append((part, i, start + at, n, zlib.crc32(own.tobytes()), own.astype(np.int32) if ids else None))
                        at += n
                cols = list(zip(*rows, strict=True))[: 6 if ids else 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=False)], names)

    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
    names = ["part", "doc_id", "at", "n_tokens", "ids_crc32", "ids"][: 6 if ids else 5]
    rows = blocks.select("part", "start_in_part", "doc_ids", "lengths", "payload").mapInArrow(run, "part int, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids)
    out_cols = ["doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"] + ["ids"] * ids
    return rows.join(F.broadcast(base), "part").select(*out_cols)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "token-files")
    write_token_files(documents(spark, sf_dir), out, default_path("word_bpe_49k.json"), 2)
    return read_token_files(spark, out, ids=False)
