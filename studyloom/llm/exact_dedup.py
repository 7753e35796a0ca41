"""Grace hash deduplication by complete content.

1. Each task folds the rows it reads: an open-addressing table finds equal contents, and a
   row with the content, the ids that share it and the largest of them is written for each
   group (`local groups`, in the shared folder). A large group of copies so costs a row for
   every GROUP_IDS ids.
2. The recursion is planned from counts before contents move: local groups are dealt to
   buckets by the leading digits of a 64-bit hash, and a bucket whose distinct contents
   exceed leaf_bytes is dealt again by the next digit, until each leaf fits.
3. One shuffle sends each local group to its leaf's spill file; a task opens one leaf at a
   time and puts it into an open-addressing table that compares complete contents.
4. Each local group's verdict is joined back to its ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, doc_text, documents, slots, Tables

DIGIT = 4
DEEPEST = 15
LEAF_BYTES = 16 << 20
#: A task's own table is emptied when its contents reach this size, a group when it has so many ids.
LOCAL_BYTES, GROUP_IDS = 16 << 20, 4096
#: What an entry takes besides its content.
ENTRY_BYTES = 200
LOCAL = "group_key long, hash long, content string, doc_ids array<long>, best_at int, best_id long, n long"
VERDICT = "group_key long, keep_id long, group_size long, wins boolean"


class OpenTable:
    """Open addressing with linear probing; an entry is found by hash and confirmed by its complete content."""

    def __init__(self) -> None:
        self.slots = [-1] * 1024
        self.hashes: list[int] = []
        self.contents: list = []
        self.values: list = []

    def place(self, h: int, content) -> tuple[int, bool]:
        """The entry of this content, and whether it is new."""
        mask = len(self.slots) - 1
        k = (h ^ (h >> 29)) & mask
        while (e := self.slots[k]) >= 0:
            if self.hashes[e] == h and self.contents[e] == content:
                return e, False
            k = (k + 1) & mask
        e = self.slots[k] = len(self.hashes)
        self.hashes.append(h)
        self.contents.append(content)
        self.values.append(None)
        if 2 * len(self.hashes) > len(self.slots):
            self._grow()
        return e, True

    def _grow(self) -> None:
        self.slots = [-1] * (4 * len(self.slots))
        mask = len(self.slots) - 1
        for e, h in enumerate(self.hashes):
            k = (h ^ (h >> 29)) & mask
            while self.slots[k] >= 0:
                k = (k + 1) & mask
            self.slots[k] = e


def fold_locally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    key = TaskContext.get().partitionId() << 40
    table, size = OpenTable(), 0
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.int64()]
    names = ["group_key", "hash", "content", "doc_ids", "best_at", "best_id", "n"]

    def rows(groups):
        nonlocal key
        out = []
        for h, content, ids in groups:
            best = max(range(len(ids)), key=lambda k: (ids[k] is not None, ids[k] or 0, -k))
            out.append((key, h, content, ids, best, ids[best], len(ids)))
            key += 1
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    for b in batches:
        full = []
        for i, h, content in zip(b.column("doc_id").to_pylist(), b.column("hash").to_pylist(), b.column("content").to_pylist(), strict=True):
            e, new = table.place(h, content)
            if new:
                table.values[e] = []
                size += len(content) + ENTRY_BYTES
            size += 8
            table.values[e].append(i)
            if len(table.values[e]) >= GROUP_IDS:
                full.append((h, content, table.values[e]))
                table.values[e] = []
        if full:
            yield rows(full)
        if size > LOCAL_BYTES:
            yield rows([g for g in zip(table.hashes, table.contents, table.values, strict=True) if g[2]])
            table, size = OpenTable(), 0
    left = [g for g in zip(table.hashes, table.contents, table.values, strict=True) if g[2]]
    if left:
        yield rows(left)


def judge_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Local groups in order of their leaf; one leaf's table at a time."""
    leaf, table = None, OpenTable()

    def verdicts():
        out = []
        for groups in table.values:
            _, _, winner, keep = min((k is None, -(k or 0), g, k) for g, k, _ in groups)
            size = sum(n for _, _, n in groups)
            out += [(g, keep, size, g == winner) for g, _, _ in groups]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64(), pa.int64(), pa.int64(), pa.bool_()], strict=True)], ["group_key", "keep_id", "group_size", "wins"])

    for b in batches:
        for at, g, h, content, keep, n in zip(*(b.column(c).to_pylist() for c in ("leaf", "group_key", "hash", "content", "best_id", "n")), strict=True):
            if at != leaf:
                if table.values:
                    yield verdicts()
                leaf, table = at, OpenTable()
            e, new = table.place(h, content)
            if new:
                table.values[e] = []
            table.values[e].append((g, keep, n))
    if table.values:
        yield verdicts()


def leaf_column(groups: DataFrame, leaf_bytes: int):
    """Each row's leaf: the hash's leading digits, as many as its bucket needs to fit."""
    digits = lambda d: F.shiftrightunsigned("hash", 64 - DIGIT * d)
    # Distinct contents only; equal ones take one entry. Hash and length stand for the content here.
    sizes = groups.groupBy("hash").agg((F.max(F.octet_length("content")).cast("long") + F.lit(ENTRY_BYTES) * F.count("*")).alias("bytes"))
    total = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    depth = 1
    while (1 << DIGIT * depth) * leaf_bytes < 2 * total and depth < DEEPEST:
        depth += 1
    label = lambda d: F.concat(F.lit(f"{d}:"), F.hex(digits(d)))
    leaf, open_rows = label(depth), sizes
    while depth < DEEPEST:
        too_big = [r[0] for r in open_rows.groupBy(digits(depth).alias("b")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")).where((F.col("bytes") > leaf_bytes) & (F.col("n") > 1)).select("b").collect()]
        if not too_big:
            break
        inside = digits(depth).isin(too_big)
        open_rows = open_rows.where(inside)
        depth += 1
        leaf = F.when(inside, label(depth)).otherwise(leaf)
    return leaf


def grace_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", leaf_bytes: int = LEAF_BYTES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per input row, dropped ones too.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty. Of equal texts
    the row with the largest id stays, a null id being smaller than any other; of rows that share that
    id one stays. Long texts are compared whole. An empty table gives no rows, other columns are not read.
    """
    spark = docs.sparkSession
    rows = doc_text(docs, id_col, text_col).select("doc_id", ascii_lower(F.col("text")).alias("content"))
    folded = rows.withColumn("hash", F.xxhash64("content")).mapInArrow(fold_locally, LOCAL)
    tables = Tables(spark)
    groups = tables.stage(folded.withColumn("text_sha256", F.sha2("content", 256)), "dedup-groups")
    leaves = groups.select(leaf_column(groups, leaf_bytes).alias("leaf"), "group_key", "hash", "content", "best_id", "n")
    verdicts = leaves.repartition(slots(spark), "leaf").sortWithinPartitions("leaf", "group_key").mapInArrow(judge_leaves, VERDICT)
    found = groups.select("group_key", "doc_ids", "best_at", "text_sha256").join(verdicts, "group_key")
    each = found.select(F.posexplode("doc_ids").alias("at", "doc_id"), "keep_id", "group_size", "wins", "best_at", "text_sha256")
    return tables.finish(each.select("doc_id", "keep_id", "group_size", (F.col("wins") & (F.col("at") == F.col("best_at"))).alias("kept"), "text_sha256"), "dedup-verdicts")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grace_dedup(documents(spark, sf_dir))


OP4_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS content
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(content) AS text_sha256
FROM d WINDOW g AS (PARTITION BY content)
"""
