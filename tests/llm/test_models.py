import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from common import awkward, frame, sentence
from pyspark.sql import functions as F

from studyloom.llm import katz, toxicity
from studyloom.llm.katz import Discounts, K, Unigrams


def brute_katz(rows):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    words = lambda t: [*(t or "").encode().lower().split(), None]
    uni, pair, n_docs = Counter(), Counter(), 0
    for i, t in rows:
        if not held(i):
            w = words(t)
            uni.update(w)
            pair.update(zip(["<"] + w, w, strict=False))
            n_docs += 1
    total, sizes = sum(uni.values()), Counter(uni.values())
    low = Unigrams.of(dict(sizes))
    d2 = Discounts.of([Counter(pair.values()).get(r, 0) for r in range(K + 2)])
    p1 = lambda w: float(low.p(np.asarray([uni[w]]))[0])
    after = defaultdict(dict)
    for (v, w), c in pair.items():
        after[v][w] = c
    context = {}
    for v, own in after.items():
        seen = sum(own.values())
        kept = sum(float(d2(np.asarray([c]))[0]) * c for c in own.values())
        able = kept < seen - 1e-12
        left = (seen - kept) / seen if able else 1 / (seen + 1)
        context[v] = left / (1 - sum(map(p1, own))), seen if able else seen + 1, able

    def p2(v, w):
        if v not in after:
            return p1(w)
        alpha, whole, able = context[v]
        c = after[v].get(w, 0)
        return (float(d2(np.asarray([c]))[0]) if able else 1) * c / whole if c else alpha * p1(w)

    for v in list(after)[:8]:  # a context's probabilities sum to 1, the unknown class included
        assert abs(sum(p2(v, w) for w in uni) + context[v][0] * low.unknown - 1) < 1e-9
    out = []
    for i, t in rows:
        w = words(t)
        base = sum(math.log10((uni[x] + 0.5) / (total + 0.5 * (len(uni) + 1))) for x in w)
        out.append((i, held(i), len(w), sum(x in uni for x in w), total, base, sum(math.log10(p2(v, x)) for v, x in zip(["<"] + w, w, strict=False))))
    return out


def rounded(rows):
    return Counter((*r[:5], round(r[5], 6), round(r[6], 6)) for r in rows)


def corpus(seed=1):
    rng = random.Random(seed)
    vocab = [sentence(rng, 1) for _ in range(60)]
    return awkward(seed) + [(100 + k, " ".join(rng.choice(vocab[: rng.randint(2, 60)]) for _ in range(rng.randint(1, 80)))) for k in range(150)]


@pytest.mark.parametrize(("batch", "hot"), [(katz.BATCH, None), (500, 20)])
def test_katz(spark, batch, hot):
    rows = corpus()
    got = katz.katz_scores(frame(spark, rows), katz.fold_held_out(), batch=batch, hot=hot).collect()
    assert rounded(got) == rounded(brute_katz(rows))


def test_katz_without_training(spark):
    assert katz.katz_scores(frame(spark, []), katz.fold_held_out()).count() == 0
    got = katz.katz_scores(frame(spark, [(1, "a b"), (2, None)]), F.lit(True)).collect()
    assert {tuple(r) for r in got} == {(1, True, 3, 0, 0, 0.0, 0.0), (2, True, 1, 0, 0, 0.0, 0.0)}


def test_discounts():
    d = Discounts.of([0, 1000, 400, 200, 120, 80, 60])
    assert all(0 < x < 1 for x in d.ratio[1:])
    assert Discounts.of([0, 3, 0, 0, 0, 0, 0]).ratio[1] == 0.5


BAD = ("snurk", "blorft", "vexor")


def labelled(seed, n=900):
    rng = random.Random(seed)
    common = [sentence(rng, 1) for _ in range(300)]
    docs, labels = [], []
    for k in range(n):
        w = [rng.choice(common) for _ in range(rng.randint(5, 60))]
        bad = rng.random() < 0.2
        if bad:
            stem = rng.choice(BAD)
            w.insert(rng.randrange(len(w)), rng.choice((stem, stem + "ing", stem.upper())))
        docs.append((k, " ".join(w)))
        if rng.random() < 0.7:
            labels.append((k, 1, int(bad)))
        docs[-1] += (bad,)
    return docs, labels


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled(7)
    lab = spark.createDataFrame(labels + [(5000, 1, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(frame(spark, [d[:2] for d in docs]), lab, toxicity.fold_held_out()).collect()}
    held = [d for d in docs if got[d[0]]["held_out"]]
    assert {d[0] for d in held} == {d[0] for d in docs if zlib.crc32(str(d[0]).encode()) % 4 == 2}
    right = sum(got[i]["predicted"] == bad for i, _, bad in held)
    assert right >= 0.95 * len(held)
    assert all(got[i]["predicted"] == 0 for i, _, bad in docs if not bad) or sum(got[i]["predicted"] for i, _, bad in docs if not bad) < 0.02 * len(docs)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())


def test_toxicity_awkward(spark):
    docs, labels = labelled(8, 200)
    rows = awkward() + [(10_000 + i, t) for i, t, _ in docs]
    lab = spark.createDataFrame([(10_000 + i, q, t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(frame(spark, rows), lab, toxicity.fold_held_out()).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    empty = [r["score"] for r in got if r["doc_id"] in (13, 14, 15)]
    assert len(set(empty)) == 1 and empty[0] < 0.3
    none = lab.limit(0)
    seed = toxicity.toxicity(frame(spark, [(1, "you idiot"), (2, "a kind word")]), none, toxicity.fold_held_out()).collect()
    assert {r["doc_id"]: r["predicted"] for r in seed} == {1: 1, 2: 0}
    assert toxicity.toxicity(frame(spark, []), none, toxicity.fold_held_out()).count() == 0


def test_sample_folds_copies_alone(spark):
    rng = random.Random(9)
    passage = "a passage that many documents share word for word " * 2
    texts = [f"{sentence(rng, 30)} {passage}{sentence(rng, 30)}" for _ in range(60)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(100 + k, t) for k, t in enumerate(texts[:20])] + [(200 + k, f" {texts[k]}".replace(" ", "\n ")) for k in range(20)]
    lab = spark.createDataFrame([(i, i % 100 % 2) for i, _ in rows], "doc_id long, label int")
    got = toxicity.sampled(spark.createDataFrame(rows, "doc_id long, text string"), lab, 30_000).collect()
    assert Counter(" ".join(r["text"].split()) for r in got) == Counter(" ".join(t.split()) for t in texts)


def test_hits_are_the_same_with_remembered_words_and_case_counts_are_exact():
    texts = ["", "You ARE scum_trash!! 123 idiot's", "ÉÀß Ǆǅ ΑΒΓαβγ 你好 İ", "eres tonto", "plain words plain words", "scummy idiotic"]
    table = {"w:trash": ((1, 5),), "s:idiot": ((1, 6), (2, 7)), "w:tonto": ((1, 8),), "s:plai": ((2, 9), (3, 10))}
    blank: set[str] = set()
    for t in texts * 2:
        assert toxicity.hits(t, table, blank) == toxicity.hits(t, table)
        assert toxicity.cases(t) == (sum(c.isupper() for c in t), sum(c.islower() for c in t))
        brute = toxicity.counted(t)
        assert [k for k in toxicity.hits(t, table) if k >= 5] == sorted(k for m, x in table.items() for level, k in x if brute.get(m, 0) >= level)
    assert "words" in blank and "plain" not in blank and not any(w in blank for w in ("scum_trash!!", "idiot's"))


def test_toxicity_by_repetition(spark):
    """A mark that clean texts hold once, and toxic ones several times, tells them apart."""
    rng = random.Random(3)
    common = [sentence(rng, 1) for _ in range(200)]
    docs, labels = [], []
    for k in range(1200):
        bad = k % 6 == 0
        w = [rng.choice(common) for _ in range(40)] + ["vexorium"] * (3 if bad else rng.random() < 0.4)
        rng.shuffle(w)
        docs.append((k, " ".join(w)))
        labels.append((k, 1, int(bad)))
    got = toxicity.toxicity(frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), toxicity.fold_held_out()).collect()
    assert all(r["predicted"] == (r["doc_id"] % 6 == 0) for r in got)


def synthetic_votes(seed, n=12_000):
    """Rows of votes with their truth: a strong voter, two fair ones, a weak one and two that copy it."""
    rng = np.random.default_rng(seed)
    truth = rng.random(n) < 0.3
    rate = [(0.70, 0.01), (0.60, 0.05), (0.55, 0.05), (0.45, 0.15)]
    cast = [rng.random(n) < np.where(truth, a, b) for a, b in rate]
    columns = [*cast, cast[3] ^ (rng.random(n) < 0.01), cast[3] ^ (rng.random(n) < 0.01)]
    return truth, [[v for v in range(6) if columns[v][k]] or [6] for k in range(n)]


def patterns_of(spark, votes, given):
    counts = Counter((tuple(v), g) for v, g in zip(votes, given, strict=True))
    return spark.createDataFrame([(list(v), g, n) for (v, g), n in sorted(counts.items())], "votes array<int>, given int, n long")


def test_label_model_finds_accuracies_and_copies_without_labels(spark):
    truth, votes = synthetic_votes(4)
    model = toxicity.LabelModel(np.full(7, -1)).fit(patterns_of(spark, votes, [-1] * len(votes)), rounds=40)
    true = [np.mean([truth[k] for k, v in enumerate(votes) if x in v]) for x in range(6)]
    assert np.abs(model.accuracies[:6] - true).max() < 0.06, (model.accuracies, true)
    assert abs(model.prior - truth.mean()) < 0.05
    edges = {frozenset((v, int(p))) for v, p in enumerate(model.parent) if p >= 0}
    assert len(edges & {frozenset(x) for x in ((3, 4), (3, 5), (4, 5))}) == 2  # copies are each other's kin
    # Three copies say hardly more than one of them.
    one, three = (model.posterior(toxicity.Sparse.of([x], 7), np.asarray([-1]))[0] for x in ([3], [3, 4, 5]))
    strong = model.posterior(toxicity.Sparse.of([[0]], 7), np.asarray([-1]))[0]
    assert strong > 0.9 and three < 0.75, (one, three, strong)


def test_label_model_finds_wrong_labels(spark):
    truth, votes = synthetic_votes(5)
    rng = np.random.default_rng(6)
    given = np.where(rng.random(len(truth)) < 0.1, ~truth, truth).astype(int)
    given[rng.random(len(truth)) < 0.5] = -1
    model = toxicity.LabelModel(np.full(7, -1)).fit(patterns_of(spark, votes, given.tolist()))
    assert np.abs(model.gold - [[0.9, 0.1], [0.1, 0.9]]).max() < 0.03
    q = model.posterior(toxicity.Sparse.of(votes, 7), given)
    told = given >= 0
    assert np.mean((q > 0.5)[told] == truth[told]) > np.mean(given[told] == truth[told])


def test_label_model_sums_against_brute_force(spark):
    _, votes = synthetic_votes(7, 300)
    given = [k % 3 - 1 for k in range(300)]
    model = toxicity.LabelModel(np.asarray([-1, 0, 0, 0, 3, 4, -1]))
    got = model.sums(patterns_of(spark, votes, given), True)
    q = np.rint(model.posterior(toxicity.Sparse.of(votes, 7), np.asarray(given)) * toxicity.UNIT).astype(int)
    for a in range(7):
        rows = [k for k in range(300) if a in votes[k]]
        assert got.get(a, (0, 0)) == (sum(q[rows]), len(rows) * toxicity.UNIT - sum(q[rows]))
        for b in range(7):
            both = [k for k in rows if b in votes[k]]
            assert got.get(7 * (a + 1) + b, (0, 0)) == (sum(q[both]), len(both) * toxicity.UNIT - sum(q[both]))


def test_regression_against_dense_newton():
    rng = np.random.default_rng(1)
    lists = [sorted(set(rng.integers(0, 12, rng.integers(0, 5)).tolist())) for _ in range(300)]
    q = rng.random(300)
    x = np.zeros((300, 13))
    x[:, -1] = 1
    for k, own in enumerate(lists):
        x[k, own] = 1
    w, penalty = np.zeros(13), np.asarray([0.5] * 12 + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - q) + penalty * w)
    got, bias = toxicity.regression(toxicity.Sparse.of(lists, 12), q)
    assert np.allclose([*got, bias], w, atol=1e-5)
