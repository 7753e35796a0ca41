"""Katz backoff scoring with a bigram model.

P2(w|v) = d(c) c(v,w) / c(v) where the pair was seen, else alpha(v) P1(w); P1 likewise takes
Good-Turing discounts from unigram counts and leaves the rest to the class of unknown words.
alpha(v) = (1 - sum of P2 over seen w) / (1 - sum of P1 over the same w), so each context's
probabilities, the unknown class included, sum to 1.

The corpus is cut into batches of about BATCH tokens. A batch sends each of its distinct
words and pairs once to the bucket that owns it, with its training counts; the bucket adds
the counts of all batches, keeps them as its part of the model's table, and answers. Pairs
go by their context, those of very frequent contexts by the whole pair: such a context is
split over all buckets, and its sums are added up afterwards. There are fewer than 4 * buckets of those.

  tokens    (batch, ids, lengths, words as places in the batch's sorted distinct hashes)
  unigrams  a row for each bucket: hashes and counts
  bigrams   a row for each bucket: pairs of word numbers and counts
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_of_id, doc_text, documents, drop_path, slots, Tables
from .words import mixed, pack, unpack, word_hashes

BATCH = 1_000_000
#: Counts up to this are discounted.
K = 5
END = np.uint64(0)
NOBODY = np.uint64((1 << 32) - 1)
ROWS = "kind int, batch long, bucket int, a binary, b binary, c binary, d binary"
_COLUMNS = ["kind", "batch", "bucket", "a", "b", "c", "d"]
_KINDS = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4]
TOKENS, ASK, ANSWER, TABLE, SUMS, HOT = range(6)
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def record(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*[(*r, *[None] * (7 - len(r))) for r in rows], strict=True), _KINDS, strict=True)], _COLUMNS)


def grouped(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[list[tuple]]:
    """Rows of a sorted stream, one list for each value of the key column."""
    held: list[tuple] = []
    for b in batches:
        for k in range(b.num_rows):
            row = tuple(b.column(c)[k].as_py() for c in range(7))
            if held and row[key] != held[0][key]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def by(df: DataFrame, *columns: str) -> DataFrame:
    return df.repartition(slots(df.sparkSession), columns[0]).sortWithinPartitions(*columns)


@dataclass(frozen=True)
class Discounts:
    """Good-Turing ratios d[r] for r from 0 to K; 1 beyond."""

    ratio: tuple[float, ...] = (1.0,) * (K + 1)

    @classmethod
    def of(cls, n: list[int]) -> Discounts:
        """n[r]: how many have count r. The largest k up to K is taken whose ratios all lie between 0 and 1;
        where there is none, as in tiny corpora, half a count is taken off each."""
        for k in range(K, 0, -1):
            if any(n[r] <= 0 for r in range(1, k + 2)):
                continue
            common = (k + 1) * n[k + 1] / n[1]
            if common >= 1:
                continue
            d = [((r + 1) * n[r + 1] / n[r] / r - common) / (1 - common) for r in range(1, k + 1)]
            if all(0 < x < 1 for x in d):
                return cls((1.0, *d, *[1.0] * (K - k)))
        return cls((1.0, *[(r - 0.5) / r for r in range(1, K + 1)]))

    def __call__(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > K, 1.0, np.asarray(self.ratio)[np.minimum(count, K).astype(np.int64)])


@dataclass(frozen=True)
class Unigrams:
    """P1 from counts: total, number of different words, discounts, and what is left for unknown words."""

    total: int
    distinct: int
    discounts: Discounts
    unknown: float
    plus: int = 0  # 1 where no count is small enough to be discounted: the unknown class then counts as one token

    @classmethod
    def of(cls, sizes: dict[int, int]) -> Unigrams:
        """sizes: how many words have each count."""
        total, distinct = sum(c * n for c, n in sizes.items()), sum(sizes.values())
        if not total:
            return cls(0, 0, Discounts(), 1.0)
        d = Discounts.of([sizes.get(r, 0) for r in range(K + 2)])
        left = sum((1 - d.ratio[r]) * r * sizes.get(r, 0) for r in range(1, K + 1)) / total
        return cls(total, distinct, d, left) if left > 0 else cls(total, distinct, d, 1 / (total + 1), 1)

    def p(self, count: np.ndarray) -> np.ndarray:
        seen = self.discounts(count) * count / max(1, self.total + self.plus)
        return np.where(count > 0, seen, self.unknown)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.5) / (self.total + 0.5 * (self.distinct + 1)))


@dataclass
class Sums:
    """For contexts: how many successors have counts 1 to K, the sum of larger counts, the sum of successors' P1."""

    small: np.ndarray
    large: np.ndarray
    lower: np.ndarray

    def weights(self, d: Discounts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(alpha, denominator, whether discounts apply) of each context. Where nothing is left by discounting,
        the rest counts as one token."""
        r = np.arange(1, K + 1)
        seen = (self.small * r).sum(1) + self.large
        kept = (self.small * r * np.asarray(d.ratio[1:])).sum(1) + self.large
        able = kept < seen
        left = np.where(able, (seen - kept) / np.maximum(seen, 1), 1 / (seen + 1))
        return left / np.maximum(1 - self.lower, 1e-300), np.where(able, seen, seen + 1), able

    def dump(self) -> tuple[bytes, bytes, bytes]:
        return pack(self.small.astype(np.uint32).ravel()), pack(self.large.astype(np.uint64)), pack(self.lower.astype(np.float64))

    @classmethod
    def load(cls, a: bytes, b: bytes, c: bytes) -> Sums:
        return cls(unpack(a).reshape(-1, K).astype(np.int64), unpack(b).astype(np.int64), unpack(c))

    @classmethod
    def zeros(cls, n: int) -> Sums:
        return cls(np.zeros((n, K), np.int64), np.zeros(n, np.int64), np.zeros(n))

    def put(self, at: np.ndarray, other: Sums) -> None:
        self.small[at], self.large[at], self.lower[at] = other.small, other.large, other.lower


def tokens_and_asks(rows: DataFrame, buckets: int, size: int = BATCH) -> DataFrame:
    """Batches of tokenised documents (TOKENS), and each batch's distinct words for their buckets (ASK)."""

    def flush(batch: int, docs: list) -> Iterator[pa.RecordBatch]:
        lengths = np.asarray([len(h) + 1 for _, _, h in docs], np.int64)
        flat = np.concatenate([x for _, _, h in docs for x in (h, [END])]).astype(np.uint64)
        held = np.asarray([h for _, h, _ in docs], np.uint8)
        uniq, place = np.unique(flat, return_inverse=True)
        train = np.bincount(place, weights=np.repeat(1 - held, lengths), minlength=len(uniq)).astype(np.uint32)
        null = np.asarray([i is None for i, _, _ in docs], np.uint8)
        ids = np.asarray([i or 0 for i, _, _ in docs], np.int64)
        yield record([(TOKENS, batch, -1, pack(ids), pack(np.concatenate([held, null])), pack(lengths), pack(place.astype(np.uint32)))])
        owner = owner_of_word(uniq, buckets)
        cuts = np.searchsorted(owner, np.arange(buckets + 1))
        out = [(ASK, batch, k, pack(uniq[cuts[k] : cuts[k + 1]], True), pack(train[cuts[k] : cuts[k + 1]])) for k in range(buckets) if cuts[k] < cuts[k + 1]]
        yield record(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        batch, docs, n = TaskContext.get().partitionId() << 32, [], 0
        for b in batches:
            for i, h, t in zip(b.column("doc_id").to_pylist(), b.column("held_out").to_pylist(), b.column("text"), strict=True):
                docs.append((i, h, word_hashes(t.as_py())))
                n += len(docs[-1][2]) + 1
                if n >= size:
                    yield from flush(batch, docs)
                    batch, docs, n = batch + 1, [], 0
        if docs:
            yield from flush(batch, docs)

    return rows.mapInArrow(run, ROWS)


def owner_of_word(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each hash: ranges of hashes, so sorted hashes fall into buckets in turn."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def owner_of_pair(keys: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    return (np.where(hot, mixed(keys), mixed(keys >> np.uint64(32))) % np.uint64(buckets)).astype(np.int64)


def add_up_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's words: the table, how many have each count, and the answers (place in the table, count)."""
    for rows in grouped(batches, 2):
        bucket = rows[0][2]
        own = [(unpack(r[3], True), unpack(r[4])) for r in rows]
        uniq, inverse = np.unique(np.concatenate([h for h, _ in own]), return_inverse=True)
        count = np.bincount(inverse, weights=np.concatenate([c for _, c in own]), minlength=len(uniq)).astype(np.uint64)
        seen = count > 0
        place = np.where(seen, np.cumsum(seen) - 1, NOBODY).astype(np.uint32)
        values, sizes = np.unique(count[seen], return_counts=True)
        yield record([(TABLE, -1, bucket, pack(uniq[seen], True), pack(count[seen])), (SUMS, -1, bucket, pack(values), pack(sizes.astype(np.uint64)))])
        at = 0
        for r, (h, _) in zip(rows, own, strict=True):
            k = inverse[at : at + len(h)]
            at += len(h)
            yield record([(ANSWER, r[1], bucket, pack(place[k]), pack(count[k]))])


@dataclass
class Batch:
    """A batch's tokens with what the unigram buckets answered."""

    ids: list
    held: np.ndarray
    lengths: np.ndarray
    count: np.ndarray  # of each token
    word: np.ndarray  # number of each token, NOBODY if unknown
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # distinct pairs, sorted
    inverse: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # of each token's pair
    context: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # of each token
    context_count: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @classmethod
    def of(cls, rows: list[tuple], first: np.ndarray, words: int, docs: int) -> Batch:
        """first: the number of each bucket's first word; words: how many there are, which is the number of the
        context before the first token; docs: how often that context occurs."""
        tokens = next(r for r in rows if r[0] == TOKENS)
        answers = sorted((r for r in rows if r[0] == ANSWER), key=lambda r: r[2])
        place, count = (np.concatenate([unpack(r[k]) for r in answers]) for k in (3, 4))
        base = np.concatenate([np.full(len(unpack(r[3])), first[r[2]], np.uint64) for r in answers])
        number = np.where(place == NOBODY, NOBODY, base + place).astype(np.uint64)
        at, flags, lengths = unpack(tokens[6]), unpack(tokens[4]), unpack(tokens[5])
        held, null = flags[: len(lengths)].astype(bool), flags[len(lengths) :].astype(bool)
        ids = [None if n else i for i, n in zip(unpack(tokens[3]).tolist(), null, strict=True)]
        b = cls(ids, held, lengths, count[at].astype(np.int64), number[at])
        starts = np.cumsum(lengths) - lengths
        b.context = np.concatenate([[np.uint64(words)], b.word[:-1]]).astype(np.uint64)
        b.context[starts] = words
        b.context_count = np.concatenate([[docs], b.count[:-1]])
        b.context_count[starts] = docs
        pairs = (np.where(b.context == NOBODY, NOBODY, b.context) << np.uint64(32)) | b.word
        b.keys, b.inverse = np.unique(pairs, return_inverse=True)
        return b

    def asked(self) -> np.ndarray:
        """Which of the distinct pairs have a known context."""
        return (self.keys >> np.uint64(32)) != NOBODY

    def first_token(self) -> np.ndarray:
        """A token of each distinct pair."""
        out = np.zeros(len(self.keys), np.int64)
        out[self.inverse] = np.arange(len(self.inverse))
        return out


def pair_asks(rows: DataFrame, first: np.ndarray, words: int, docs: int, hot: int, buckets: int) -> DataFrame:
    """Each batch's distinct pairs for their buckets: pairs, training counts, the second words' counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in grouped(batches, 1):
            b = Batch.of(own, first, words, docs)
            train = np.bincount(b.inverse, weights=np.repeat(~b.held, b.lengths), minlength=len(b.keys)).astype(np.uint32)
            at = b.first_token()
            asked = np.flatnonzero(b.asked())
            owner = owner_of_pair(b.keys[asked], b.context_count[at[asked]] > hot, buckets)
            order = np.argsort(owner, kind="stable")
            cuts = np.searchsorted(owner[order], np.arange(buckets + 1))
            out = []
            for k in range(buckets):
                own_k = asked[order[cuts[k] : cuts[k + 1]]]
                if len(own_k):
                    out.append((ASK, own[0][1], k, pack(b.keys[own_k], True), pack(train[own_k]), pack(b.count[at[own_k]].astype(np.uint32)), pack((b.context_count[at[own_k]] > hot).astype(np.uint8))))
            if out:
                yield record(out)

    return by(rows, "batch", "kind", "bucket").mapInArrow(run, ROWS)


def add_up_pairs(unigrams: Unigrams) -> Callable:
    """A bucket's pairs: the table, how many have each count, sums of its part of very frequent contexts (HOT),
    and the answers (counts, then the sums of each distinct context that is not so frequent)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, 2):
            bucket = rows[0][2]
            asks = [unpack(r[3], True) for r in rows]
            keys, where, inverse = np.unique(np.concatenate(asks), return_index=True, return_inverse=True)
            count = np.bincount(inverse, weights=np.concatenate([unpack(r[4]) for r in rows]), minlength=len(keys)).astype(np.int64)
            lower = unigrams.p(np.concatenate([unpack(r[5]) for r in rows])[where].astype(np.int64))
            frequent = np.concatenate([unpack(r[6]) for r in rows])[where].astype(bool)
            contexts, of = np.unique(keys >> np.uint64(32), return_inverse=True)
            seen = count > 0
            sums = Sums.zeros(len(contexts))
            for r in range(1, K + 1):
                sums.small[:, r - 1] = np.bincount(of[count == r], minlength=len(contexts))
            sums.large[:] = np.bincount(of[count > K], weights=count[count > K], minlength=len(contexts)).astype(np.int64)
            sums.lower[:] = np.bincount(of[seen], weights=lower[seen], minlength=len(contexts))
            hot = np.zeros(len(contexts), bool)
            hot[of[frequent]] = True
            sizes = np.asarray([(count == r).sum() for r in range(K + 2)], np.uint64)
            yield record([(TABLE, -1, bucket, pack(keys[seen], True), pack(count[seen])), (SUMS, -1, bucket, pack(sizes))])
            if hot.any():
                part = Sums(sums.small[hot], sums.large[hot], sums.lower[hot])
                yield record([(HOT, -1, bucket, pack(contexts[hot], True), *part.dump())])
            at = 0
            for r, k in zip(rows, asks, strict=True):
                own = inverse[at : at + len(k)]
                at += len(k)
                mine = np.unique(of[own])
                mine = mine[~hot[mine]]
                part = Sums(sums.small[mine], sums.large[mine], sums.lower[mine])
                a, b, c = part.dump()
                yield record([(ANSWER, r[1], bucket + (1 << 20), pack(count[own].astype(np.uint32)), a, b, c)])

    return run


def sums_of_hot(rows: DataFrame) -> tuple[np.ndarray, Sums]:
    """The very frequent contexts, fewer than 4 * buckets, and their sums over all buckets."""
    small = [f"r{r}" for r in range(1, K + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                context, part = unpack(b.column("a")[k].as_py(), True), Sums.load(*(b.column(c)[k].as_py() for c in "bcd"))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (context.astype(np.int64), *part.small.T, part.large, part.lower)], ["context", *small, "large", "lower"])

    each = rows.select("a", "b", "c", "d").mapInArrow(run, f"context long, {', '.join(f'{r} long' for r in small)}, large long, lower double")
    got = sorted(each.groupBy("context").agg(*[F.sum(c).alias(c) for c in (*small, "large", "lower")]).collect())
    column = lambda c, kind: np.asarray([r[c] for r in got], kind)
    return column("context", np.uint64), Sums(np.stack([column(c, np.int64) for c in small], 1), column("large", np.int64), column("lower", np.float64))


def scores(rows: DataFrame, first: np.ndarray, unigrams: Unigrams, docs: int, hot: int, hot_sums: tuple[np.ndarray, Sums], discounts: Discounts, buckets: int) -> DataFrame:
    """Each token's log10 probability by backing off from its pair to its word, added up by document."""
    words = unigrams.distinct

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in grouped(batches, 1):
            answers = {r[2] - (1 << 20): r for r in own if r[0] == ANSWER and r[2] >= 1 << 20}
            b = Batch.of([r for r in own if r[2] < 1 << 20], first, words, docs)
            at, asked = b.first_token(), np.flatnonzero(b.asked())
            is_hot = b.context_count[at[asked]] > hot
            owner = owner_of_pair(b.keys[asked], is_hot, buckets)
            count = np.zeros(len(b.keys), np.int64)
            context = b.keys >> np.uint64(32)
            contexts, of = np.unique(context, return_inverse=True)
            sums = Sums.zeros(len(contexts))
            for k, r in answers.items():
                mine = asked[owner == k]
                count[mine] = unpack(r[3])
                sums.put(np.unique(of[mine[~is_hot[owner == k]]]), Sums.load(r[4], r[5], r[6]))
            hot_contexts, hot_part = hot_sums
            if len(hot_contexts):
                found = np.searchsorted(hot_contexts, contexts)
                found = np.minimum(found, len(hot_contexts) - 1)
                have = hot_contexts[found] == contexts
                sums.put(np.flatnonzero(have), Sums(hot_part.small[found[have]], hot_part.large[found[have]], hot_part.lower[found[have]]))
            alpha, whole, able = sums.weights(discounts)
            p1 = unigrams.p(b.count)
            n, c = count[b.inverse], of[b.inverse]
            seen = np.where(able[c], discounts(n), 1.0) * n / np.maximum(whole[c], 1)
            known = b.context != NOBODY
            p = np.where(known & (n > 0), seen, np.where(known, alpha[c], 1.0) * p1)
            starts = (np.cumsum(b.lengths) - b.lengths).astype(np.int64)
            add = lambda x: np.add.reduceat(x, starts)
            yield pa.RecordBatch.from_arrays([pa.array(b.ids, pa.int64()), pa.array(b.held), pa.array(b.lengths), pa.array(add((b.count > 0).astype(np.int64))), pa.array(add(unigrams.base(b.count))), pa.array(add(np.log10(p)))], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return by(rows, "batch", "kind", "bucket").mapInArrow(run, SCORES)


def katz_scores(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", batch: int = BATCH, hot: int | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per input row.

    held_out is a condition on doc_id; the model learns from the other rows. A null or empty text is the end
    token alone. Null and repeated ids each give their row, an empty table gives none. Without any training row
    every token is unknown and has probability 1. Texts of any length are scored whole, other columns are not read.
    hot: a context that occurs more often is split over all buckets; by default a quarter of a bucket's share.
    """
    spark = docs.sparkSession
    buckets = slots(spark)
    rows = doc_text(docs, id_col, text_col).select("doc_id", held_out.alias("held_out"), "text")
    tables = Tables(spark)
    tokens = tables.stage(tokens_and_asks(rows, buckets, batch), "katz-tokens", "kind").select(*_COLUMNS)
    unigrams = tables.stage(by(tokens.where(F.col("kind") == ASK), "bucket", "batch").mapInArrow(add_up_words, ROWS), "katz-unigrams", "kind").select(*_COLUMNS)
    drop_path(spark, f"{tables.paths[0]}/kind={ASK}")
    # A row for each bucket, each with its different counts: small beside the corpus, and needed by every task.
    sizes: dict[int, int] = {}
    in_bucket = np.zeros(buckets + 1, np.int64)
    for r in unigrams.where(F.col("kind") == SUMS).collect():
        values, n = unpack(bytes(r["a"])), unpack(bytes(r["b"]))
        in_bucket[r["bucket"] + 1] = int(n.sum())
        for c, k in zip(values.tolist(), n.tolist(), strict=True):
            sizes[c] = sizes.get(c, 0) + k
    first, lower = np.cumsum(in_bucket)[:-1], Unigrams.of(sizes)
    if lower.distinct >= int(NOBODY) - 1:
        raise ValueError("more than 2**32 - 2 different words")
    n_docs = rows.where(~F.col("held_out")).count()
    hot = max(1, lower.total // (4 * buckets)) if hot is None else hot
    both = tokens.where(F.col("kind") == TOKENS).unionAll(unigrams.where(F.col("kind") == ANSWER))
    asks = pair_asks(both, first, lower.distinct, n_docs, hot, buckets)
    bigrams = tables.stage(by(asks, "bucket", "batch").mapInArrow(add_up_pairs(lower), ROWS), "katz-bigrams", "kind").select(*_COLUMNS)
    pairs = [0] * (K + 2)
    for r in bigrams.where(F.col("kind") == SUMS).collect():
        pairs = [x + int(y) for x, y in zip(pairs, unpack(bytes(r["a"])), strict=True)]
    hot_sums = sums_of_hot(bigrams.where(F.col("kind") == HOT))
    scored = scores(both.unionAll(bigrams.where(F.col("kind") == ANSWER)), first, lower, n_docs, hot, hot_sums, Discounts.of(pairs), buckets)
    return tables.finish(scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(lower.total).cast("long").alias("train_tokens"), "base_score", "score"), "katz-scores")


def fold_held_out() -> Column:
    return crc32_of_id(F.col("doc_id")) % 5 == 1


def op5_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(documents(spark, sf_dir), fold_held_out())
