"""Ranked lexical search with block-max pruning.

build_index() cuts the documents, as they are read, into blocks of a bounded number of documents and
entries. A block is a row of a table: its distinct terms (64-bit hashes), how many of its documents hold each, for each
term the maxima, and a forward index (the terms and counts of each document). A term's maxima are the
pairs of count and length that no other document of the block beats in both, so the largest
score that the term can add in the block is exact for any corpus statistics.

search() adds up the statistics, then takes two looks at the maxima. The first finds for each item the
blocks with the largest bounds; their documents are scored, and the k-th best score is the item's first
threshold. In the second each task takes some blocks at a time in order of their
bounds, scores the forward index of a block for those items whose bound is not below the threshold,
and raises thresholds as it goes; a forward index that no item needs is not unpacked. Each task sends the k best documents
of an item.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LOWER, UPPER, Tables, doc_text, documents, memory
from .words import pack, unpack

#: A block is full with so many documents or entries (a term of a document), whichever comes first.
BLOCK_DOCS, BLOCK_ENTRIES = 64, 50_000
#: Blocks that a task puts in order together.
CHUNK = 32
SEEDS = 2
PASS_BYTES = 8 << 20
CACHE_TERMS = 300_000
INDEX = "block long, n_docs long, n_terms long, doc_ids array<long>, lengths array<long>, terms binary, holders binary, head_terms binary, head_tfs binary, head_lengths binary, entries binary, entry_terms binary, entry_tfs binary"
#: Runs of ASCII letters, digits and characters beyond ASCII are terms; what else there is becomes a blank.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: str) -> list[bytes]:
    return text.encode("utf-8").translate(_FOLD).split()


def term_hashes(terms: list[bytes]) -> np.ndarray:
    import xxhash

    known = memory("terms")
    if len(known) > CACHE_TERMS:
        known.clear()
    for t in set(terms).difference(known):
        known[t] = xxhash.xxh3_64_intdigest(t)
    return np.fromiter(map(known.__getitem__, terms), np.uint64, len(terms))


def block_row(block: int, held: list[tuple]) -> tuple:
    """A row of the index for (doc_id, length, term hashes, counts) of some documents."""
    lengths = np.asarray([x[1] for x in held], np.int64)
    sizes = np.asarray([len(x[2]) for x in held], np.int64)
    terms, at, holders = np.unique(np.concatenate([x[2] for x in held]), return_inverse=True, return_counts=True)
    tfs, n = np.concatenate([x[3] for x in held]), np.repeat(lengths, sizes)
    order = np.lexsort((-tfs, n, at))
    # Shorter documents first; one stays if it holds its term more often than all before it.
    best = np.maximum.accumulate((at[order].astype(np.int64) << 40) + tfs[order])
    heads = order[np.concatenate([[True], best[1:] > best[:-1]]) if len(best) else np.zeros(0, bool)]
    small = np.uint16 if len(terms) < 65536 else np.uint32
    return (
        block, len(held), int(lengths.sum()), [x[0] for x in held], lengths.tolist(), pack(terms, ascending=True), pack(holders.astype(np.int32)), pack(at[heads].astype(small)), pack(tfs[heads].astype(np.int32)),
        pack(n[heads]), pack(sizes.astype(np.int32)), pack(at.astype(small)), pack(tfs.astype(np.int32)),
    )


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of the documents that have a term, in the order in which they are read; columns as in INDEX.

    Null, empty and term-free texts are left out. Ids are carried, null and repeated ones too. Texts are indexed whole; a text
    with more entries than a block takes is a block. Other columns are not read. Write the table before it is searched:
    the numbers of its blocks depend on how the documents are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 2 + [pa.binary()] * 8
        names = [x.split()[0] for x in INDEX.split(", ")]
        held: list[tuple] = []
        entries = 0
        for b in batches:
            rows = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                hashes = term_hashes(terms_of(text.as_py()))
                if len(hashes):
                    own, tfs = np.unique(hashes, return_counts=True)
                    held.append((doc, len(hashes), own, tfs))
                    entries += len(own)
                if len(held) >= BLOCK_DOCS or entries >= BLOCK_ENTRIES:
                    rows.append(block_row(block, held))
                    held, entries, block = [], 0, block + 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(block_row(block, held), strict=True), kinds, strict=True)], names)

    return doc_text(docs, id_col, text_col).mapInArrow(run, INDEX)


def per_document(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Queries:
    """Items of one pass: their terms in order of hash, and which items hold each."""

    def __init__(self, items: list[list[bytes]]) -> None:
        every = sorted({t for terms in items for t in terms})
        hashes = term_hashes(every)
        self.n = len(items)
        self.terms, first = np.unique(hashes, return_index=True)
        place = {t: int(k) for t, k in zip(every, np.searchsorted(self.terms, hashes), strict=True)}
        pairs = sorted({(place[t], k) for k, terms in enumerate(items) for t in terms})
        self.owners = np.asarray([k for _, k in pairs], np.int64)
        self.starts = np.searchsorted(np.asarray([t for t, _ in pairs], np.int64), np.arange(len(self.terms) + 1))

    def found(self, block_terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the terms here that a block holds, their numbers in the block)."""
        at = np.searchsorted(block_terms, self.terms)
        at[at == len(block_terms)] = 0
        own = np.flatnonzero(block_terms[at] == self.terms) if len(block_terms) else np.zeros(0, np.int64)
        return own, at[own]

    def spread(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For terms (with repeats): (which of them, an item that holds it), a row for each such item."""
        sizes = self.starts[numbers + 1] - self.starts[numbers]
        which = np.repeat(np.arange(len(numbers)), sizes)
        inside = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return which, self.owners[self.starts[numbers][which] + inside]


class Scorer:
    """Bounds and scores of one pass's items in a block, for the statistics of the corpus."""

    def __init__(self, queries: Queries, weights: np.ndarray, n_docs: int, n_terms: int) -> None:
        self.q, self.weights, self.n_docs, self.n_terms = queries, weights, n_docs, n_terms

    def factors(self, lengths: np.ndarray) -> np.ndarray:
        # Python's integers: the product can pass 64 bits where the quotient does not.
        each = {n: 10 + 90 * n * self.n_docs // self.n_terms for n in set(lengths.tolist())}
        return np.fromiter(map(each.__getitem__, lengths.tolist()), np.int64, len(lengths))

    def bounds(self, row: dict) -> np.ndarray:
        """For each item the sum of what its terms can add at most in this block."""
        out = np.zeros(self.q.n, np.int64)
        terms, numbers = self.q.found(unpack(row["terms"], ascending=True))
        if not len(terms):
            return out
        head_terms = unpack(row["head_terms"])
        low, high = np.searchsorted(head_terms, numbers), np.searchsorted(head_terms, numbers, side="right")
        sizes = high - low
        at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low, sizes)
        most = per_document(unpack(row["head_tfs"])[at].astype(np.int64), self.factors(unpack(row["head_lengths"])[at]))
        largest = np.maximum.reduceat(most, np.cumsum(sizes) - sizes) * self.weights[terms]
        which, items = self.q.spread(terms)
        np.add.at(out, items, largest[which])
        return out

    def scores(self, row: dict, alive: np.ndarray) -> np.ndarray:
        """(documents, items) scores from the forward index; items that are not alive get 0."""
        sizes, n = unpack(row["entries"]), len(row["doc_ids"])
        terms, numbers = self.q.found(unpack(row["terms"], ascending=True))
        entry_terms = unpack(row["entry_terms"])
        place = np.full(int(entry_terms.max()) + 1, -1, np.int64)
        place[numbers] = terms
        asked = np.flatnonzero(place[entry_terms] >= 0)
        doc, term = np.repeat(np.arange(n), sizes)[asked], place[entry_terms[asked]]
        m = self.factors(np.asarray(row["lengths"], np.int64))[doc]
        each = per_document(unpack(row["entry_tfs"])[asked].astype(np.int64), m) * self.weights[term]
        which, items = self.q.spread(term)
        live = alive[items]
        out = np.zeros((n, self.q.n), np.int64)
        np.add.at(out, (doc[which[live]], items[live]), each[which[live]])
        return out


class Best:
    """The k best (score, document) of each item; a null id comes after all others."""

    def __init__(self, n: int, k: int, thresholds: np.ndarray) -> None:
        self.k, self.thresholds = k, thresholds.copy()
        self.rows: list[list[tuple]] = [[] for _ in range(n)]

    def add(self, ids: list, scores: np.ndarray) -> None:
        for doc, item in zip(*np.nonzero((scores > 0) & (scores >= self.thresholds)), strict=True):
            i = ids[doc]
            self.rows[item].append((-int(scores[doc, item]), i is None, i or 0, i))
            if len(self.rows[item]) >= 4 * self.k:
                self.cut(int(item))
        # A short list counts too once it is full.
        for item in np.flatnonzero([len(r) >= self.k for r in self.rows]):
            self.cut(int(item))

    def cut(self, item: int) -> None:
        own = self.rows[item]
        own.sort()
        del own[self.k :]
        if len(own) == self.k:
            self.thresholds[item] = max(self.thresholds[item], -own[-1][0])

    def batch(self) -> pa.RecordBatch:
        flat = [(item, r[3], -r[0]) for item, own in enumerate(self.rows) for r in own]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in flat], pa.int64()) for k in range(3)], ["item", "doc_id", "score"])


def in_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    held: list[dict] = []
    for b in batches:
        for k in range(b.num_rows):
            held += b.slice(k, 1).to_pylist()
            if len(held) == CHUNK:
                yield held
                held = []
    if held:
        yield held


def best_documents(index: DataFrame, scorer: Scorer, k: int, thresholds: np.ndarray) -> DataFrame:
    """(item, doc_id, score): each task's k best documents of each item, of those that reach its threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(scorer.q.n, k, thresholds)
        for rows in in_chunks(batches):
            bounds = np.stack([scorer.bounds(r) for r in rows])
            for b in np.argsort(-bounds.max(1), kind="stable").tolist():
                alive = (bounds[b] > 0) & (bounds[b] >= best.thresholds)
                if alive.any():
                    best.add(rows[b]["doc_ids"], scorer.scores(rows[b], alive))
        yield best.batch()

    return index.mapInArrow(run, "item long, doc_id long, score long")


def top(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def first_thresholds(index: DataFrame, scorer: Scorer, k: int) -> np.ndarray:
    """For each item the k-th best score within the SEEDS blocks of the largest bounds, 0 where they have fewer documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = np.zeros((SEEDS, scorer.q.n), np.int64)
        where = np.full((SEEDS, scorer.q.n), -1, np.int64)
        for rows in in_chunks(batches):
            own = np.concatenate([most, np.stack([scorer.bounds(r) for r in rows])])
            blocks = np.concatenate([where, np.broadcast_to(np.asarray([r["block"] for r in rows])[:, None], (len(rows), scorer.q.n))])
            order = np.argsort(-own, axis=0, kind="stable")[:SEEDS]
            most, where = np.take_along_axis(own, order, 0), np.take_along_axis(blocks, order, 0)
        at, item = np.nonzero(most > 0)
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(where[at, item]), pa.array(most[at, item])], ["item", "block", "bound"])

    each = index.select("block", "terms", "head_terms", "head_tfs", "head_lengths").mapInArrow(run, "item long, block long, bound long")
    place = F.row_number().over(W.partitionBy("item").orderBy(F.desc("bound"), "block"))
    blocks = [r["block"] for r in each.withColumn("place", place).where(F.col("place") <= SEEDS).select("block").distinct().collect()]
    out = np.zeros(scorer.q.n, np.int64)
    if blocks:
        seeds = best_documents(index.where(F.col("block").isin(blocks)), scorer, k, out)
        for r in top(seeds, k).where(F.col("rank") == k).collect():
            out[r["item"]] = r["score"]
    return out


def search(index: DataFrame, items: DataFrame, k: int = 10, item_col: str = "item_id", text_col: str = "text", pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents of an index that is a written table.

    The score of a document adds w * (10**9 * tf div (1000 * tf + 8 * m)) over the item's distinct terms, where w is floor(1000 * ln((2N + 2) / (2df + 1))) and
    m is 10 + 90 * length * N div L; N documents have L terms. Only scores above 0 count; equal ones go by ascending id, a null
    id last; rows of the index that repeat an id are documents of their own. Rows of items that share an id (null is an id,
    too) are one item with the terms of all. Items without terms, or an index without rows, give no rows. Items travel to the
    tasks in passes of pass_bytes of text."""
    spark = index.sparkSession
    rows = doc_text(items, item_col, text_col).distinct()
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    total = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    passes, out = max(1, -(-size // pass_bytes)), None
    for p in range(passes):
        own: dict = {}
        for r in rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(passes)) == p).collect():
            own.setdefault(r["doc_id"], []).extend(terms_of(r["text"]))
        own = {i: t for i, t in own.items() if t}
        ids = spark.createDataFrame(list(enumerate(own)), "item long, item_id long")
        if own and total[0]:
            queries = Queries(list(own.values()))
            weights = np.zeros(len(queries.terms), np.int64)
            for r in holders(index, queries).collect():  # as many as the pass has terms
                weights[r["term"]] = math.floor(1000 * math.log((2 * total[0] + 2) / (2 * r["df"] + 1)))
            scorer = Scorer(queries, weights, *total)
            found = top(best_documents(index, scorer, k, first_thresholds(index, scorer, k)), k)
        else:
            found = spark.createDataFrame([], "item long, doc_id long, score long, rank int")
        found = found.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionAll(found)
    return out


def holders(index: DataFrame, queries: Queries) -> DataFrame:
    """(term, df): how many documents hold each term of the queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(queries.terms), np.int64)
        for b in batches:
            for terms, counts in zip(b.column("terms"), b.column("holders"), strict=True):
                own, at = queries.found(unpack(terms.as_py(), ascending=True))
                df[own] += unpack(counts.as_py())[at]
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["term", "df"])

    return index.select("terms", "holders").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """search() over an index that is built for it and deleted afterwards."""
    tables = Tables(docs.sparkSession)
    index = tables.stage(build_index(docs), "search-index")
    return tables.finish(search(index, items, k), "search-results")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13_SQL = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS t FROM documents),
s AS (SELECT count(*) AS n, CAST(sum(len(t)) AS BIGINT) AS l FROM d WHERE len(t) > 0),
f AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) GROUP BY ALL),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s WHERE term IN (SELECT term FROM q) GROUP BY term, n),
m AS (SELECT doc_id, 100 - 90 + (90 * len(t) * n) // l AS m FROM d, s WHERE len(t) > 0),
r AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN f USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0 QUALIFY rank <= 10
"""
