import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from common import awkward, frame, sentence

from studyloom.llm import lexical_search as S

A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute(docs, items, k=10):
    own = [(i, Counter(TERM.findall((t or "").translate(A_Z)))) for i, t in docs]
    own = [(i, c) for i, c in own if c]
    n, total = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(TERM.findall((t or "").translate(A_Z)))
    out = []
    for item, terms in wanted.items():
        scored = []
        for i, c in own:
            m = 100 - 90 + (90 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def zipf(rng, n):
    return " ".join(f"w{int(rng.paretovariate(0.6))}" for _ in range(n))


def tables(spark, docs, items):
    return frame(spark, docs), spark.createDataFrame(items, "item_id long, text string").selectExpr("item_id", "text", "'x' AS doc_id", "1 AS rank", "2 AS score")


@pytest.mark.parametrize("block", [1, 7, 64])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK_DOCS", block)
    rng = random.Random(block)
    docs = awkward() + [(100 + k, zipf(rng, rng.choice((3, 40, 300)))) for k in range(300)] + [(None, zipf(rng, 30))]
    docs += [(1000 + k, docs[30][1]) for k in range(25)]  # ties
    items = [(k, zipf(rng, rng.choice((1, 6, 40)))) for k in range(12)] + [(20, None), (21, "!?"), (22, docs[30][1]), (22, "w1 w2"), (None, "w3 É é"), (23, "nowhereatall"), (24, "w4 " * 50)]
    df, bench = tables(spark, docs, items)
    assert sorted(map(tuple, S.ranked(df, bench).select("item_id", "rank", "doc_id", "score").collect()), key=str) == brute(docs, items)


def test_pruning_reads_fewer_blocks_and_loses_nothing():
    rng = random.Random(3)
    held = [(k, zipf(rng, 60)) for k in range(2000)]
    passages = {k: held[k][1] for k in (5, 700, 1500)}
    for k in range(45):  # each in 15 documents more
        at = 40 * k + 11
        held[at] = (at, f"{held[at][1]} {list(passages.values())[k % 3]}")
    rows = []
    for b in range(0, len(held), 20):
        parts = []
        for i, t in held[b : b + 20]:
            h = S.term_hashes(S.terms_of(t))
            parts.append((i, len(h), *np.unique(h, return_counts=True)))
        names = [x.split()[0] for x in S.INDEX.split(", ")]
        rows.append(dict(zip(names, S.block_row(b, parts), strict=True)))
    items = [S.terms_of(t) for t in passages.values()]
    q = S.Queries(items)
    n, total = len(held), sum(len(S.terms_of(t)) for _, t in held)
    df = np.zeros(len(q.terms), np.int64)
    for r in rows:
        own, at = q.found(S.unpack(r["terms"], ascending=True))
        df[own] += S.unpack(r["holders"])[at]
    w = np.asarray([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df])
    scorer = S.Scorer(q, w, n, total)
    every = np.ones(3, bool)
    full = [scorer.scores(r, every) for r in rows]
    bounds = np.stack([scorer.bounds(r) for r in rows])
    assert all((b >= s.max(0)).all() for b, s in zip(bounds, full, strict=True))
    # One document a block: the bound is its score.
    h = S.term_hashes(S.terms_of(held[0][1]))
    one = dict(zip([x.split()[0] for x in S.INDEX.split(", ")], S.block_row(0, [(0, len(h), *np.unique(h, return_counts=True))]), strict=True))
    assert (scorer.bounds(one) == scorer.scores(one, every)[0]).all()
    kth = np.sort(np.concatenate(full), axis=0)[-10]
    assert (bounds >= kth).mean() < 0.5


def test_passes_and_nothing(spark):
    docs, items = [(k, f"alpha b{k % 3} c{k}") for k in range(30)], [(k, f"b{k} c{k} alpha") for k in range(9)]
    df, bench = tables(spark, docs, items)
    index = S.build_index(df)
    path = S.Tables(spark)
    index = path.stage(index, "test-index")
    assert sorted(map(tuple, S.search(index, bench, 3, pass_bytes=30).collect()), key=str) == brute(docs, items, 3)
    assert S.search(index, bench.limit(0)).count() == 0
    assert S.ranked(frame(spark, []), bench).count() == 0
    path.finish(index.limit(0), "test-index")


def test_lengths_beyond_64_bits():
    scorer = S.Scorer(S.Queries([[b"a"]]), np.ones(1, np.int64), 50_000_000_000, 10_000_000_000_000)
    n = 10_000_000
    assert scorer.factors(np.asarray([n, 3]))[0] == 10 + 90 * n * 50_000_000_000 // 10_000_000_000_000
