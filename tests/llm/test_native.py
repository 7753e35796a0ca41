import hashlib
import math
import random
import re
import zlib
from collections import Counter

from common import awkward, frame, sentence
from pyspark.sql import functions as F

from studyloom.llm import curve_shards, pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    digits = [int(c) for c in reversed(d)]
    return (sum(digits[::2]) + sum(2 * x - 9 * (x > 4) for x in digits[1::2])) % 10 == 0


def holds(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and luhn(d)
    return kind == "email" or 10 <= len(d) <= 15


def brute(text):
    found = sorted((m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if holds(kind, m[0]))
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in found)


def test_base_spans(spark):
    rng = random.Random(1)
    parts = ["1234567890", "a.@-_%+", "0.1.255.9", "+1 ()-. ", "é\n x🙂", "411111111111111 -", "@x.y", "١٢"]
    rows = awkward() + [(1000 + k, "".join(rng.choice(rng.choice(parts)) for _ in range(rng.randint(0, 60)))) for k in range(1500)]
    rows += [(5000, "x 4111 1111 1111 1111, a.b@c.de 10.0.0.256 10.0.0.25 +1 (555) 123-4567 +49 1 2"), (5001, "1" * 30_000), (5002, "a" * 60_000), (5003, "a@b" + ".c" * 20_000)]
    got = pii.personal_data(frame(spark, rows)).select("doc_id", pii.written(F.col("base")).alias("s")).collect()
    assert Counter(map(tuple, got)) == Counter((i, brute(t)) for i, t in rows)
    assert pii.personal_data(frame(spark, [])).count() == 0


def test_bootstrapping_finds_unseen(spark):
    rng = random.Random(2)
    rows = []
    for k in range(40):
        who = f"user{k}@mail.example.com" if k % 4 else f"account-{k}-99312{k}"
        rows.append((k, f"{sentence(rng, 5)} please contact {who} for {sentence(rng, 4)}"))
        rows.append((100 + k, f"{sentence(rng, 5)} in version {k}2345{k}9 of {sentence(rng, 3)}"))
    got = {r["doc_id"]: r for r in pii.personal_data(frame(spark, rows)).collect()}
    for i, t in rows:
        spans = [t[s["start"] : s["stop"]] for s in got[i]["added"]]
        assert spans == (re.findall(r"account-\S+", t) if i < 100 and i % 4 == 0 else [])


def test_seeds_with_spaces_make_patterns(spark):
    rng = random.Random(3)
    phones = [f"+1 (017) 555-{7000 + k}" for k in range(12)]
    cards = [c for c in (f"4111 1111 11{k:02d} {k:02d}1{d}" + " 11" for k in range(100) for d in range(10)) if luhn(c.replace(" ", ""))][:12]
    assert len(cards) == 12
    rows = []
    for n, (seed, unseen, lead, tail) in enumerate([(phones, "ext-44{}7731", "please call", "before"), (cards, "acc{}-889912", "charge my", "today")]):
        for k in range(12):
            rows.append((100 * n + k, f"{sentence(rng, 5)} {lead} {seed[k]} {tail} {sentence(rng, 4)}"))
            # Glued marks are not words, and an identifier may follow another one.
            rows.append((1000 + 100 * n + k, f"{sentence(rng, 5)} 99{k}88177 {lead} ({unseen.format(k)}), {tail} {sentence(rng, 4)}"))
    got = {r["doc_id"]: r for r in pii.personal_data(frame(spark, rows)).collect()}
    for i, t in rows:
        spans = [t[s["start"] : s["stop"]] for s in got[i]["added"]]
        assert spans == (re.findall(r"ext-\d+|acc\d+-\d+", t) if i >= 1000 else [])
        assert len(got[i]["base"]) == (i < 1000)


def test_key_like_tokens_are_seeds_and_found_where_several_stand(spark):
    rng = random.Random(5)
    key = lambda n=40: "".join(rng.choice("0123456789abcdef") for _ in range(n - 8)) + "12ab34cd"
    rows = [(k, f'{sentence(rng, 6)} api secret: "{key()}", {sentence(rng, 3)}') for k in range(6)]
    rows += [(50, f"{sentence(rng, 6)} API secret: pin-4417-22 {sentence(rng, 3)}")]  # unseen, in the learnt context
    rows += [(60 + k, f"{sentence(rng, 6)} {key(70 * (k + 1))} {sentence(rng, 3)}") for k in range(3)]  # keys in no common context
    rows += [(70, f"| 4 | {key()} | 5 |"), (71, f"| 4 | {key()} | 5 |"), (72, f"| 4 | {key()} | 5 |")]  # no words around
    got = {r["doc_id"]: r for r in pii.personal_data(frame(spark, rows)).collect()}
    for i, t in rows:
        found = [t[s["start"] : s["stop"]] for s in got[i]["added"]]
        assert found == (re.findall(r"[0-9a-f]{40}", t) if i < 50 else ["pin-4417-22"] if i == 50 else [])


def test_graph_scores_against_brute_force(spark):
    rng = random.Random(6)
    rule = pii.Bootstrap(rounds=4, seeds=2, confidence=0.4, accept=2.0)  # no token joins the seeds
    seeds = set(range(12))
    edges = [(rng.randrange(15), rng.randrange(40)) for _ in range(160)]
    edges += edges[:30]
    pairs = set(edges)
    able = {p for p in range(15) if sum(t in seeds for q, t in pairs if q == p) >= rule.seeds}
    score = {e: float(e[1] in seeds) for e in pairs if e[0] in able}
    for k in range(rule.rounds):
        confidence = {p: sum(x for (q, _), x in score.items() if q == p) / (sum(q == p for q, _ in score) + rule.doubt) for p in able}
        if k + 1 < rule.rounds:
            likely = {t: 1 - math.prod(max(1e-9, 1 - confidence[q]) for q, u in score if u == t) for _, t in score}
            score = {(q, t): 1.0 if t in seeds else likely[t] for q, t in score}
    df = spark.createDataFrame([(p, t, t in seeds) for p, t in edges], "pattern long, token long, seed boolean")
    got = {r["pattern"]: r["confidence"] for r in pii.trusted(df, rule).collect()}
    want = {p: x for p, x in confidence.items() if x >= rule.confidence}
    assert 0 < len(want) < 15 and set(got) == set(want) and all(abs(got[p] - x) < 1e-9 for p, x in want.items())


def test_instances_join_the_seeds(spark):
    rng = random.Random(7)
    rule = pii.Bootstrap(rounds=5, seeds=2, confidence=0.5, accept=0.7)
    seeds = set(range(10))
    pairs = {(rng.randrange(25), rng.randrange(60)) for _ in range(170)} | {(p, t) for p in (30, 31) for t in (*range(6), 70, 71)} | {(40, t) for t in (70, 71, 72)}
    told, score = set(seeds), {t: float(t in seeds) for _, t in pairs}
    for k in range(rule.rounds):
        own = {p: [t for q, t in pairs if q == p] for p, _ in pairs}
        confidence = {p: sum(score[t] for t in ts) / (len(ts) + rule.doubt) for p, ts in own.items() if sum(t in told for t in ts) >= rule.seeds}
        if k + 1 < rule.rounds:
            likely = {t: 1 - math.prod(max(1e-9, 1 - confidence[q]) for q, u in pairs if u == t and q in confidence) for _, t in pairs}
            told = seeds | {t for t, x in likely.items() if x >= rule.accept}
            score = {t: 1.0 if t in told else likely[t] for t in likely}
    got = {r["pattern"]: r["confidence"] for r in pii.trusted(spark.createDataFrame([(p, t, t in seeds) for p, t in pairs], "pattern long, token long, seed boolean"), rule).collect()}
    want = {p: x for p, x in confidence.items() if x >= rule.confidence}
    assert set(got) == set(want) and all(abs(got[p] - x) < 1e-9 for p, x in want.items())
    # A pattern without any first seed: its tokens joined in a round before.
    assert 40 in want and not any(t in seeds for q, t in pairs if q == 40)


def test_held_back_identifiers_are_found_by_context(spark):
    rng = random.Random(8)
    key = lambda n=24: "".join(rng.choice("abcdefgh12345678") for _ in range(n - 8)) + "a1b2c3d4"
    words = lambda n: " ".join(rng.choice(["lorem", "ipsum", "dolor", "amet", "sit", "elit"]) for _ in range(n))
    rows, keys = [], []
    for k in range(40):
        keys.append(key())
        rows.append((k, f"{words(5)} api secret {keys[-1]} rotated {words(5)}"))
    rows += [(100 + k, f"{words(4)} badge number {k}7{k}8-{k:03d}99x {words(4)}") for k in range(20)]  # like a token, in no seed's context
    rows += [(200, f"{words(3)} api secret no-1234-key rotated {words(3)}"), (201, f"seen {key()} alone"), (202, None)]
    got = {r["doc_id"]: r for r in pii.personal_data(frame(spark, rows), rule=pii.Bootstrap(held_back=0.5)).collect()}
    flags = spark.createDataFrame([(k,) for k in keys], "t string").select(pii.first_seed(F.col("t"), pii.Bootstrap(held_back=0.5)).alias("s")).collect()
    assert 8 < sum(r["s"] for r in flags) < 32
    text = dict(rows)
    found = {i: [text[i][s["start"] : s["stop"]] for s in r["added"]] for i, r in got.items()}
    assert all(found[k] == [keys[k]] for k in range(40))
    assert found[200] == ["no-1234-key"]  # like no first seed at all
    assert not any(found[i] for i in (*range(100, 120), 201, 202))


def test_overlapping_base_spans_are_one_seed(spark):
    rows = [(k, f"aa bb {who} cc") for k, who in enumerate(("10.0.0.1@x.yz", "10.0.0.2@x.yz", "id-123456"))]
    assert not any(r["added"] for r in pii.personal_data(frame(spark, rows)).collect())


def test_op9_digest(spark, tmp_path):
    rows = [(1, "mail a@b.cd now"), (2, None)]
    frame(spark, rows, extra=False).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in pii.op9_pii(spark, str(tmp_path)).collect()}
    assert got[1]["spans"] == "email:5:11" and got[1]["n_email"] == 1
    assert got[2]["base_sha256"] == hashlib.sha256(b"").hexdigest() and got[2]["spans"] == ""


def test_shards(spark):
    rows = awkward() + [(100 + k, "t" * (k % 50)) for k in range(300)]
    got = curve_shards.cut(curve_shards.along_curve(frame(spark, rows)), 8).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted(r["rank"] for r in got) == list(range(len(rows)))
    counts = Counter(r["shard"] for r in got)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))
    ordered = sorted(got, key=lambda r: r["rank"])
    assert [r["curve"] for r in ordered] == sorted(r["curve"] for r in got)
    assert [r["shard"] for r in ordered] == sorted(r["shard"] for r in got)
    assert curve_shards.cut(curve_shards.along_curve(frame(spark, []))).count() == 0
    few = curve_shards.cut(curve_shards.along_curve(frame(spark, rows[:3]))).collect()
    assert len({r["shard"] for r in few}) == 3


def test_curve_steps_to_a_neighbour(spark):
    for n, bits in ((2, 3), (3, 2), (4, 2)):
        df = spark.range(1 << n * bits)
        cells = [F.shiftright("id", k * bits).bitwiseAND(F.lit((1 << bits) - 1)).cast("int") for k in range(n)]
        rows = df.select(curve_shards.curve_index(cells, bits).alias("at"), F.array(*cells).alias("p")).orderBy("at").collect()
        assert [r["at"] for r in rows] == list(range(1 << n * bits))
        assert all(sum(abs(x - y) for x, y in zip(a["p"], b["p"], strict=True)) == 1 for a, b in zip(rows, rows[1:], strict=False))


def test_write_shards(spark, tmp_path):
    rows = [(k, "x" * k) for k in range(60)]
    stats = curve_shards.write_shards(frame(spark, rows, extra=False), str(tmp_path / "out"), 4).collect()
    assert sum(r["rows"] for r in stats) == 60 and all(r["min_doc_id"] <= r["max_doc_id"] for r in stats)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 60
