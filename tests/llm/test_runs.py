import hashlib
import random
import zlib

import numpy as np
from common import awkward, frame, sentence

from studyloom.llm import periodic_runs as R


def brute_runs(words):
    """Every maximal stretch of each period, those of no smaller period, by definition."""
    n, out = len(words), []
    for s in range(n):
        for p in range(1, n - s):
            if s and s - 1 + p < n and words[s - 1] == words[s - 1 + p]:
                continue
            e = s
            while e + p < n and words[e] == words[e + p]:
                e += 1
            length = e - s + p
            if length >= max(6, 4 * p) and not any(all(words[k] == words[k + q] for k in range(s, s + length - q)) for q in range(1, p)):
                out.append((s, length, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(words, doc_id):
    h, n = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def brute_row(doc_id, text, runs_of=brute_runs):
    words = planted((text or "").encode().split(), doc_id)
    runs = runs_of(words)
    stay = [w for k, w in enumerate(words) if not any(s + p <= k < s + n for s, n, p in runs)]
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], sha(lines.encode()), sha(b" ".join(stay)))


def repetitive(rng):
    words = []
    while len(words) < rng.randint(0, 120):
        piece = [rng.choice("abc") if rng.random() < 0.7 else sentence(rng, 1) for _ in range(rng.randint(1, 9))]
        words += piece * rng.randint(1, 9) + piece[: rng.randint(0, len(piece))]
    return words


def test_runs_equal_brute_force():
    rng = random.Random(1)
    seen = 0
    for k in range(1500):
        words = repetitive(rng) if k % 3 else [rng.choice("ab") for _ in range(rng.randint(0, 60))]
        words = [w.encode() for w in words]
        runs = brute_runs(words)
        assert R.find_runs(R.word_numbers(words)) == runs
        seen += len(runs)
    assert seen > 1500


def test_long_runs_are_cheap():
    for piece in ([0], list(range(7)), [0, 0, 0, 1]):
        w = np.tile(np.asarray(piece, np.int32), 40_000 // len(piece))
        assert (0, len(w), len(piece)) in R.find_runs(w)
    fib = [0], [0, 1]
    while len(fib[1]) < 3000:
        fib = fib[1], fib[1] + fib[0]
    assert R.find_runs(np.asarray(fib[1], np.int32)) == []  # exponents stay below four


def test_operator(spark):
    rows = [(1, "x a b a b a b a b y"), (2, "q q q q q q"), (3, "q q q q q"), (4, "A a A a A a A a"), (5, "\x0bz\x0cz\x1fz z z z z z z")]
    got = {r["doc_id"]: r for r in R.periodic_runs(frame(spark, rows)).collect()}
    assert [tuple(x) for x in got[1]["runs"]] == [(1, 8, 2)] and got[1]["collapsed"] == "x a b y"
    assert [tuple(x) for x in got[2]["runs"]] == [(0, 6, 1)] and got[2]["collapsed"] == "q"
    assert got[3]["runs"] == [] and got[3]["collapsed"] == "q q q q q"
    assert [tuple(x) for x in got[4]["runs"]] == [(0, 8, 2)] and got[4]["n_words"] == 8
    assert got[5]["runs"] == []  # the unit separator and the no-break space do not part words
    assert R.periodic_runs(frame(spark, [])).count() == 0


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(2)
    rows = [r for r in awkward() if len(r[1] or "") < 10_000] + [(100 + k, " ".join(repetitive(rng))) for k in range(60)] + [(k, sentence(rng, rng.randint(1, 120))) for k in range(200, 400)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, R.op12_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((brute_row(*r) for r in rows), key=str)
    assert sum(1 for r in got if r[1] > 0) > 40


def test_long_text(spark):
    rows = [r for r in awkward() if len(r[1] or "") > 10_000]
    got = R.digests(R.periodic_runs(R.with_loops(frame(spark, rows)))).collect()
    assert [tuple(r) for r in got] == [brute_row(*rows[0], runs_of=lambda w: R.find_runs(R.word_numbers(w)))]
