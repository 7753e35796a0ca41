"""Toxicity by weak supervision.

1. A bounded sample of labelled training rows (`labelled`, a parameter) is drawn. Marks are counted in it: words and
   word beginnings, each with how often it stands in a text (LEVELS).
2. Voters: lexicon entries, which are marks at a level whose documents are nearly all toxic, and patterns of
   spelling. A voter votes or abstains.
3. A generative label model is fitted by expectation maximisation over the votes of all training rows, with a label
   or without: for the hidden label and each voter P(votes | label, whether its parent votes), where parents form
   the tree of the largest mutual informations given the label, so voters that echo each other count once. Labels are
   one more voter, whose errors are estimated as well. Rows with equal votes are one row with a count; each
   round is a Spark aggregation over those, and its sums are integers, so that they do not depend on their order.
4. A logistic regression on marks at levels, many more than the voters are, is trained on the sample's posterior
   labels. It alone scores documents; labels, language, source and id are never inputs of a score.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_of_id, doc_text, documents, drop_path, memory, stage

THRESHOLD = 0.3
#: The labelled sample's expected size: the bound of what marks and weights are learnt from.
LABELLED = 30_000
#: How often a mark stands in a text, at least.
LEVELS = (1, 2, 3, 5)
#: Evidence is documents times the divergence (in nats) of a mark's share of toxic labels from the share of all, so
#: that chance finds hardly any among many marks. A voter needs more of it than a feature, and purity.
FEATURE_EVIDENCE, VOTER_EVIDENCE, PURITY = 10.0, 15.0, 0.9
WORD = re.compile(r"[^\W\d_]+")
STEMS = (4, 5, 6)
ASCII_UPPER, ASCII_LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
BEYOND_ASCII = re.compile(r"[^\x00-\x7f]+")
#: Pieces of text (of at most so many characters) that a worker remembers at most as holding no mark of the last table.
BLANKS, BLANK_LENGTH = 200_000, 60
#: Labels are first taken to be right so often, as firmly as if so many labels had shown it.
GOLD, GOLD_ROWS = 0.95, 20.0
#: The share of its information that a voter has in common with its parent at least.
KIN = 0.1
#: Posteriors are counted in these parts of one.
UNIT = 1 << 20
#: Seed lexicon of fixed words: votes even where the sample holds too few of them.
SEED_WORDS = ("idiot", "idiots", "moron", "scum", "stupid", "loser", "pathetic", "disgusting", "worthless", "trash", "dumb", "filthy")
ADDRESSES = ("you are", "you're", "tu es", "du bist", "eres")
ADDRESS = re.compile(rf"\b({'|'.join(ADDRESSES)})\b")
PATTERNS = ("seed", "shouting", "exclaims", "symbols", "names the reader")
Table = dict[str, tuple[tuple[int, int], ...]]


def marks(word: str) -> list[str]:
    """What a lexicon entry can be: 'w:' and a word, 's:' and the beginning of a longer word."""
    return ["w:" + word, *("s:" + word[:n] for n in STEMS if len(word) > n)]


def counted(text: str) -> dict[str, int]:
    """How often each mark stands in the text."""
    out: dict[str, int] = {}
    for w, n in Counter(WORD.findall(text.lower())).items():
        for m in marks(w):
            out[m] = out.get(m, 0) + n
    return out


def cases(text: str) -> tuple[int, int]:
    """How many characters are upper case, and how many lower case."""
    data = text.encode("ascii", "ignore")
    upper, lower = len(data) - len(data.translate(None, ASCII_UPPER)), len(data) - len(data.translate(None, ASCII_LOWER))
    other = "" if text.isascii() else "".join(BEYOND_ASCII.findall(text))
    return upper + sum(map(str.isupper, other)), lower + sum(map(str.islower, other))


def blanks(table: Table) -> set[str]:
    key, known = hash(tuple(table)), memory("blanks")
    if key not in known:
        known.clear()
        known[key] = set()
    return known[key]


def hits(text: str, table: Table, blank: set[str] | None = None) -> list[int]:
    """The patterns (from 0) and, from len(PATTERNS) on, the table's marks at their levels that the text has.
    blank: what is known to hold no mark and no seed word between white space; it is added to."""
    lower = text.lower()
    pieces = lower.split()
    told = set(pieces) if blank is None else set(pieces).difference(blank)
    times = Counter(pieces) if told else {}
    found: dict[str, int] = {}
    seed = False
    for piece in told:
        empty = True
        for w in WORD.findall(piece):
            if w in SEED_WORDS:
                seed, empty = True, False
            for m in marks(w):
                if m in table:
                    found[m], empty = found.get(m, 0) + times[piece], False
        if empty and blank is not None and len(piece) <= BLANK_LENGTH and len(blank) < BLANKS:
            blank.add(piece)
    upper, small = cases(text)
    letters, size = upper + small, max(1, len(text))
    given = (
        seed,
        letters > 20 and upper > 0.6 * letters,
        text.count("!") > 0.02 * size,
        sum(text.count(c) for c in "#$%&*") > 0.05 * size,
        any(x in lower for x in ADDRESSES) and bool(ADDRESS.search(lower)),
    )
    return [k for k, yes in enumerate(given) if yes] + sorted(i for m, n in found.items() for level, i in table[m] if n >= level)


@dataclass
class Sparse:
    """0 and 1 by row and column, as the places of the ones."""

    rows: np.ndarray
    columns: np.ndarray
    shape: tuple[int, int]

    @classmethod
    def of(cls, lists: list[list[int]], width: int) -> Sparse:
        lengths = [len(x) for x in lists]
        flat = np.fromiter((c for x in lists for c in x), np.int64, sum(lengths))
        return cls(np.repeat(np.arange(len(lists)), lengths), flat, (len(lists), width))

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, weights=weights[self.columns], minlength=self.shape[0])

    def sums(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, weights=weights[self.rows], minlength=self.shape[1])


def logit(p: np.ndarray) -> np.ndarray:
    return np.log(p) - np.log1p(-p)


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class LabelModel:
    """P(toxic), P(label given | hidden) and, for each voter, P(votes | hidden label, whether its parent votes).

    The last voter votes where none of the others does. Fitting weighs every abstention, as accuracies are not
    determined without labels otherwise. Judging a row does not, as a long text has more chances to be hit and one in
    another language hardly any: there only the last voter tells of abstentions.
    """

    parent: np.ndarray  # of each voter, -1 for none
    lexicon: np.ndarray | None = None  # the voters from which the first posterior of rows without a label comes, None for all but the last
    prior: float = 0.1
    gold: np.ndarray | None = None  # (hidden, given)
    votes: np.ndarray | None = None  # (hidden, parent votes, voter)
    accuracies: np.ndarray | None = None  # of each voter's votes, how many are right

    def posterior(self, x: Sparse, given: np.ndarray, abstentions: bool = False) -> np.ndarray:
        """P(toxic) of rows of votes; given: 1 or 0, or -1 where there is no label. abstentions: whether each is weighed."""
        if self.votes is None:
            first = np.arange(x.shape[1] - 1) if self.lexicon is None else self.lexicon
            p = np.where(np.bincount(x.rows[np.isin(x.columns, first)], minlength=x.shape[0]) > 0, 0.8, 0.05)
            return np.where(given < 0, p, np.where(given > 0, GOLD, 1 - GOLD))
        width = x.shape[1]
        parent = self.parent[x.columns]
        beside = np.isin(x.rows * width + parent, x.rows * width + x.columns) & (parent >= 0)
        told, z = np.log(self.votes[1]) - np.log(self.votes[0]), logit(np.asarray(self.prior))
        if abstentions:
            # As if all abstained beside abstaining parents; then what parents that vote change; then the votes.
            silent = np.log1p(-self.votes[1]) - np.log1p(-self.votes[0])
            silent[:, -1] = told[:, -1] = 0
            told, z = told - silent, z + silent[0].sum()
            children = self.parent >= 0
            told = told + np.bincount(self.parent[children], weights=(silent[1] - silent[0])[children], minlength=width)
        z = z + np.bincount(x.rows, weights=told[beside.astype(np.int64), x.columns], minlength=x.shape[0])
        ratio = np.log(self.gold[1]) - np.log(self.gold[0])
        return logistic(z + np.where(given < 0, 0, ratio[np.maximum(given, 0)]))

    def sums(self, patterns: DataFrame, pairs: bool) -> dict[int, tuple[int, int]]:
        """Rows by hidden label, in UNITs (toxic, clean), for each of: -1 all; -2 and -3 labels 0 and 1; v, voter v; and for
        voters v and p together width * (v + 1) + p: all pairs, or those of voters and their parents."""
        width, model = len(self.parent), self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = Sparse.of(b.column("votes").to_pylist(), width)
                given, n = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("given", "n"))
                toxic = np.rint(model.posterior(x, given, True) * UNIT).astype(np.int64) * n
                clean = n * UNIT - toxic
                # The rows that each key counts.
                at, keys = [np.arange(len(n)), np.flatnonzero(given >= 0), x.rows], [np.full(len(n), -1), -2 - given[given >= 0], x.columns]
                if pairs:
                    starts, lengths = np.searchsorted(x.rows, x.rows), np.bincount(x.rows, minlength=len(n))[x.rows]
                    mine = np.repeat(np.arange(len(x.rows)), lengths)
                    other = np.arange(len(mine)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts, lengths)
                    at.append(x.rows[mine])
                    keys.append(width * (x.columns[mine] + 1) + x.columns[other])
                else:
                    parent = model.parent[x.columns]
                    both = np.isin(x.rows * width + parent, x.rows * width + x.columns) & (parent >= 0)
                    at.append(x.rows[both])
                    keys.append(width * (x.columns[both] + 1) + parent[both])
                at, keys = np.concatenate(at), np.concatenate(keys)
                seen, of = np.unique(keys, return_inverse=True)
                out = np.zeros((2, len(seen)), np.int64)
                np.add.at(out[0], of, toxic[at])
                np.add.at(out[1], of, clean[at])
                yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(out[0]), pa.array(out[1])], ["key", "toxic", "clean"])

        # As many rows as there are voters, or pairs of voters, at most.
        rows = patterns.mapInArrow(run, "key long, toxic long, clean long").groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).collect()
        return {r["key"]: (r["toxic"], r["clean"]) for r in rows}

    def fit(self, patterns: DataFrame, rounds: int = 12, trees: tuple[int, ...] = (0, 2, 5, 8, 14, 20)) -> LabelModel:
        """patterns: (votes, given, n), rows with equal votes and label as one. In the rounds `trees` parents are chosen anew."""
        width = len(self.parent)
        for k in range(rounds):
            got = self.sums(patterns, k in trees)
            one = np.asarray([got.get(v, (0, 0)) for v in range(width)]).reshape(-1, 2).T / UNIT
            whole = np.asarray(got.get(-1, (0, 0))) / UNIT
            if not whole.sum():
                break
            if k in trees:
                self.parent = tree(got, one, whole)
            both = np.asarray([got.get(width * (v + 1) + p, (0, 0)) if p >= 0 else (0, 0) for v, p in enumerate(self.parent)]).reshape(-1, 2).T / UNIT
            beside = np.where(self.parent >= 0, one[:, self.parent], 0)
            share = np.stack([(one - both + 0.5) / (whole[:, None] - beside + 1), (both + 0.5) / (beside + 1)], 1)[::-1]
            self.votes = np.clip(share, 1e-9, 1 - 1e-9)
            self.prior = float((whole[0] + 1) / (whole.sum() + 2))
            labels = np.asarray([got.get(-2 - g, (0, 0)) for g in (0, 1)]) / UNIT  # (given, hidden toxic or clean)
            first = np.asarray([[GOLD, 1 - GOLD], [1 - GOLD, GOLD]]) * GOLD_ROWS
            self.gold = (labels[:, ::-1].T + first) / (labels[:, ::-1].T + first).sum(1, keepdims=True)
            self.accuracies = one[0] / np.maximum(one.sum(0), 1 / UNIT)
            self.accuracies[-1] = 1 - self.accuracies[-1]
        return self


def tree(got: dict[int, tuple[int, int]], one: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Each voter's parent in the maximum spanning tree of mutual information given the label; -1 for the root, for
    one that shares less than KIN of its information (or of the parent's) with the parent, and for the last voter, which follows
    from the others."""
    width = one.shape[1]
    v = width - 1
    if v < 2:
        return np.full(width, -1)
    info, own = np.zeros((v, v)), np.zeros(v)
    for label in (0, 1):
        n = whole[label] + 4e-3
        joint = np.zeros((v, v))
        for key, told in got.items():
            a, b = divmod(key, width)
            if 0 < a <= v and b < v and key >= width:
                joint[a - 1, b] = told[label] / UNIT
        a = one[label, :v]
        yes_yes, yes_no = joint, np.maximum(a[:, None] - joint, 0)
        no_yes, no_no = np.maximum(a[None, :] - joint, 0), np.maximum(whole[label] - a[:, None] - a[None, :] + joint, 0)
        cells = np.stack([yes_yes, yes_no, no_yes, no_no]) + 1e-3
        p = cells / cells.sum(0)
        rows, columns = np.stack([p[0] + p[1], p[0] + p[1], p[2] + p[3], p[2] + p[3]]), np.stack([p[0] + p[2], p[1] + p[3], p[0] + p[2], p[1] + p[3]])
        info += n * (p * np.log(p / (rows * columns))).sum(0)
        alone = (a + 2e-3) / n
        own -= n * (alone * np.log(alone) + (1 - alone) * np.log1p(-alone))
    parent, best, joined = np.full(width, -1), info[0].copy(), np.zeros(v, bool)
    joined[0] = True
    near = np.zeros(v, np.int64)
    for _ in range(v - 1):
        x = int(np.where(joined, -np.inf, best).argmax())
        joined[x] = True
        if best[x] >= KIN * min(own[x], own[near[x]]):
            parent[x] = near[x]
        closer = info[x] > best
        best, near = np.where(closer, info[x], best), np.where(closer, x, near)
    return parent


@dataclass
class Scorer:
    """The linear classifier: weights of patterns and marks at levels, and a bias."""

    table: Table
    weights: np.ndarray
    bias: float

    def score(self, text: str, blank: set[str] | None = None) -> float:
        return float(logistic(self.weights[hits(text, self.table, blank)].sum() + self.bias))


def regression(x: Sparse, q: np.ndarray, ridge: float = 0.5, rounds: int = 20) -> tuple[np.ndarray, float]:
    """Ridge-penalised logistic regression on soft labels: Newton's steps, each solved by conjugate gradients. The
    bias is not penalised."""
    w = np.zeros(x.shape[1] + 1)
    penalty = np.append(np.full(x.shape[1], ridge), 1e-6)
    forth = lambda a: x.dot(a[:-1]) + a[-1]
    back = lambda r: np.append(x.sums(r), r.sum())
    for _ in range(rounds):
        p = logistic(forth(w))
        g, curve = back(p - q) + penalty * w, p * (1 - p) + 1e-9
        scale = 1 / (back(curve) + penalty)
        step, r = np.zeros_like(w), -g
        y = scale * r
        d, rho = y.copy(), r @ y
        for _ in range(200):
            h = back(curve * forth(d)) + penalty * d
            a = rho / max(d @ h, 1e-300)
            step, r = step + a * d, r - a * h
            y = scale * r
            old, rho = rho, r @ y
            if np.abs(r).max() < 1e-8:
                break
            d = y + rho / max(old, 1e-300) * d
        w = w + step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-300))
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def digest(text: str) -> bytes:
    """The same for copies that differ in white space at most; case and marks are evidence and make others."""
    return hashlib.blake2b(" ".join(text.split()).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def sampled(rows: DataFrame, known: DataFrame, labelled: int) -> DataFrame:
    """(text, label) of the bounded sample of labelled rows; known: (doc_id, label)."""
    share = min(1.0, labelled / max(1, known.count()))
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) < F.lit(int((1 << 30) * share))
    # Bounded by `labelled`, hence fit to be sent to every task.
    drawn = rows.join(F.broadcast(known.where(draw)), "doc_id").select("text", "label")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([digest(t.as_py()) for t in b.column("text")], pa.binary())], ["text", "label", "sign"])

    # A text that was copied a thousand times teaches as much as one copy: the least of them, in any run.
    return drawn.mapInArrow(sign, "text string, label int, sign binary").groupBy("sign", "label").agg(F.min("text").alias("text")).select("text", "label")


def mined(sample: DataFrame) -> tuple[Table, list[int]]:
    """The table of marks at levels that tell of toxic labels, numbered from len(PATTERNS), and the numbers of those
    that are lexicon entries. A mark with the counts of a shorter one of its word adds nothing and is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                b = whole.slice(k, 500)
                out: dict[tuple[str, int], list[int]] = {}
                for t, y in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
                    for m, n in counted(t).items():
                        for level in LEVELS:
                            if n < level:
                                break
                            out.setdefault((m, level), [0, 0])[y] += 1
                columns = [[m for m, _ in out], [level for _, level in out], [x[1] for x in out.values()], [x[0] for x in out.values()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["mark", "level", "toxic", "clean"])

    counts = sample.mapInArrow(run, "mark string, level int, toxic long, clean long").groupBy("mark", "level").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    base = min(0.9, max(1e-6, sample.agg(F.coalesce(F.avg("label"), F.lit(0.0))).first()[0]))
    n = F.col("toxic") + F.col("clean")
    share = F.col("toxic") / n
    evidence = F.col("toxic") * F.log(share / base) + F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - share) / (1 - base))).otherwise(0.0)
    rows = counts.where((F.col("toxic") > 0) & (share > base)).withColumn("evidence", evidence).where(F.col("evidence") >= FEATURE_EVIDENCE).collect()  # a part of the sample's marks
    rows.sort(key=lambda r: (len(r["mark"]), r["mark"], r["level"]))
    met, table, best = set(), {}, {}
    number = len(PATTERNS)
    for r in rows:
        m = r["mark"]
        same = (m[2:6], r["level"], r["toxic"], r["clean"])
        if same in met:
            continue
        met.add(same)
        table.setdefault(m, []).append((r["level"], number))
        if r["evidence"] >= VOTER_EVIDENCE and r["toxic"] >= PURITY * (r["toxic"] + r["clean"]) and r["evidence"] > best.get(m, (0.0, 0))[0]:
            best[m] = r["evidence"], number
        number += 1
    shorter = lambda m: [best[s][0] for s in ("s:" + m[2 : 2 + n] for n in STEMS) if s in best and len(s) < len(m)]
    return {m: tuple(x) for m, x in table.items()}, sorted(k for m, (e, k) in best.items() if not any(e <= x for x in shorter(m)))


def vote_patterns(rows: DataFrame, known: DataFrame, table: Table, entries: list[int]) -> tuple[DataFrame, list[str]]:
    """(votes, given, n): the votes of all rows, copies of a text once, and their label or -1; and the scratch paths.
    Voters are the patterns, the entries, and at last that none of these votes."""
    voter = {k: k for k in range(len(PATTERNS))} | {e: len(PATTERNS) + k for k, e in enumerate(entries)}
    last, chosen = len(voter), set(entries)
    small = {m: x for m, x in ((m, tuple(y for y in x if y[1] in chosen)) for m, x in table.items()) if x}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blank = blanks(small)
        for b in batches:
            votes, signs = [], []
            for t in b.column("text"):
                t = t.as_py()
                votes.append([voter[k] for k in hits(t, small, blank)] or [last])
                signs.append(digest(t))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(votes, pa.list_(pa.int32())), pa.array(signs, pa.binary())], ["doc_id", "votes", "sign"])

    voted, path = stage(rows.mapInArrow(run, "doc_id long, votes array<int>, sign binary"), "toxicity-votes")
    # Null ids have no label; apart, they do not meet in one task of the join.
    given = voted.where("doc_id is not null").join(known, "doc_id", "left").select("votes", "sign", F.coalesce("label", F.lit(-1)).alias("given"))
    none = voted.where("doc_id is null").select("votes", "sign", F.lit(-1).alias("given"))
    once = given.unionAll(none).distinct()
    patterns, out = stage(once.groupBy("votes", "given").agg(F.count("*").alias("n")), "toxicity-patterns")
    return patterns, [path, out]


def fit(sample: DataFrame, rows: DataFrame, known: DataFrame) -> tuple[Scorer, LabelModel]:
    """Scorer and label model. Without labels of both kinds in the sample the seed lexicon decides alone."""
    table, entries = mined(sample)
    number = {x[1] for t in table.values() for x in t}
    width = len(PATTERNS) + len(number)
    voters = [*range(len(PATTERNS)), *entries]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blank = blanks(table)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([hits(t.as_py(), table, blank) for t in b.column("text")], pa.list_(pa.int32())), b.column("label")], ["hits", "label"])

    found = sample.mapInArrow(run, "hits array<int>, label int").collect()  # as many as the sample's bound
    found.sort(key=lambda r: (r["label"], r["hits"]))  # sums must not depend on the order of arrival
    labels = np.asarray([r["label"] for r in found], np.int64)
    model = LabelModel(np.full(len(voters) + 1, -1), np.asarray([0, *range(len(PATTERNS), len(voters))]))
    if not (labels == 1).any() or not (labels == 0).any():
        weights = np.zeros(width)
        weights[0] = 6.0
        return Scorer(table, weights, -4.0), model
    patterns, paths = vote_patterns(rows, known, table, entries)
    model.fit(patterns)
    drop_path(sample.sparkSession, *paths)
    place = np.full(width, -1)
    place[voters] = np.arange(len(voters))
    votes = Sparse.of([[place[h] for h in r["hits"] if place[h] >= 0] or [len(voters)] for r in found], len(voters) + 1)
    weights, bias = regression(Sparse.of([r["hits"] for r in found], width), model.posterior(votes, labels))
    return Scorer(table, weights, bias), model


def learn(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "toxic", labelled: int = LABELLED) -> tuple[Scorer, LabelModel]:
    """A scorer and label model learnt from rows that are not held out; held_out is a condition on doc_id. Labels that
    contradict each other for an id count by their majority (a tie as toxic), null ones not at all."""
    rows = doc_text(docs, id_col, text_col).where(~held_out)
    marked = labels.select(labels[label_id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("label"))
    known = marked.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out).groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    known, known_path = stage(known, "toxicity-labels")
    sample, path = stage(sampled(rows, known, labelled), "toxicity-sample")
    learnt = fit(sample, rows, known)
    drop_path(docs.sparkSession, path, known_path)
    return learnt


def train(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", **learning) -> Scorer:
    """What learn() gives, without the label model."""
    return learn(docs, labels, held_out, id_col, text_col, **learning)[0]


def score_of(scorer: Scorer, text: Column) -> Column:
    """The score of each text as a column; a null text counts as empty."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        blank = blanks(scorer.table)
        return pd.Series([scorer.score(t, blank) for t in texts], dtype="float64")

    return score(F.coalesce(text.cast("string"), F.lit("")))


def toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", **learning) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row.

    A null or empty text gets the score of a text without any hit. Null and repeated ids each give their
    row, an empty table gives none, texts of any length are scored whole. Other columns are not read.
    """
    scorer = train(docs, labels, held_out, id_col, text_col, **learning)
    scored = doc_text(docs, id_col, text_col).withColumn("score", score_of(scorer, F.col("text")))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def fold_held_out() -> Column:
    return crc32_of_id(F.col("doc_id")) % 4 == 2


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), fold_held_out())
