import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from common import awkward, frame, sentence
from pyspark.sql import functions as F

from studyloom.llm import exact_dedup, links, near_dedup, setsketch
from studyloom.llm.common import Tables
from studyloom.llm.decontaminate import Items, contaminated, overlap, shingles_of, words_of

A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_exact_dedup(spark):
    rows = awkward() + [(k, "hot text") for k in range(1000, 1300)]
    for leaf in (exact_dedup.LEAF_BYTES, 50):  # small leaves: deeper recursion, the same result
        got = exact_dedup.grace_dedup(frame(spark, rows), leaf_bytes=leaf).collect()
        groups = {}
        for i, t in rows:
            groups.setdefault((t or "").translate(A_Z), []).append(i)
        wanted = Counter()
        for ids in groups.values():
            keep = max(ids, key=lambda i: (i is not None, i or 0))
            wanted.update((i, keep, len(ids)) for i in ids)
        assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == wanted
        kept = Counter(r["text_sha256"] for r in got if r["kept"])
        assert set(kept.values()) == {1} and len(kept) == len(groups)
        assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    assert exact_dedup.grace_dedup(frame(spark, [])).count() == 0


def test_open_table_compares_contents():
    table = exact_dedup.OpenTable()
    places = {c: table.place(7, c)[0] for c in map(str, range(3000))}  # one hash for all
    assert len(set(places.values())) == 3000
    assert all(table.place(7, c) == (e, False) for c, e in list(places.items())[::97])


def test_group_flush(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "GROUP_IDS", 4)
    batch = spark.createDataFrame([(k, "t", 1) for k in range(10)], "doc_id long, content string, hash long").toArrow().to_batches()

    class Context:
        @staticmethod
        def get():
            return type("C", (), {"partitionId": staticmethod(lambda: 3)})

    import pyspark

    monkeypatch.setattr(pyspark, "TaskContext", Context)
    out = [r for b in exact_dedup.fold_locally(iter(batch)) for r in b.to_pylist()]
    assert sorted(i for r in out for i in r["doc_ids"]) == list(range(10))
    assert all(r["doc_ids"][r["best_at"]] == r["best_id"] == max(r["doc_ids"]) for r in out)


def brute_near(rows, width, num, den):
    def shingles(t):
        w = (t or "").encode().lower().split()
        if not w:
            return frozenset()
        q = min(width, len(w))
        return frozenset(tuple(w[k : k + q]) for k in range(len(w) - q + 1))

    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b]:
            c = len(sets[a] & sets[b])
            if den * c >= num * (len(sets[a]) + len(sets[b]) - c):
                parent[find(a)] = find(b)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(rows[k][0])
    least = {r: min((i for i in ids if i is not None), default=None) for r, ids in groups.items()}
    return Counter((rows[k][0], len(sets[k]), least[find(k)], rows[k][0] == least[find(k)]) for k in range(len(rows)))


def near_rows(seed):
    rng = random.Random(seed)
    rows = awkward(seed)
    for g in range(6):
        words = sentence(rng, rng.choice((20, 80, 200))).split()
        for k in range(25):  # a chain: each differs from the one before
            rows.append((1000 + 100 * g + k, " ".join(words)))
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = sentence(rng, 1)
    shared = sentence(rng, 50)
    rows += [(3000 + k, shared + " " + sentence(rng, 10 + k)) for k in range(30)]
    rng.shuffle(rows)
    return rows


def test_near_duplicates(spark):
    rows = near_rows(5)
    for width, num, den in ((3, 85, 100), (5, 80, 100)):
        got = near_dedup.near_duplicates(frame(spark, rows), width, num, den).collect()
        assert Counter(map(tuple, got)) == brute_near(rows, width, num, den)


def test_near_duplicates_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(links, "BLOCK", 4)
    monkeypatch.setattr(links, "FAN", 3)
    rows = near_rows(6)
    got = near_dedup.near_duplicates(frame(spark, rows), 3, 85, 100).collect()
    assert Counter(map(tuple, got)) == brute_near(rows, 3, 85, 100)


def test_near_duplicates_without_ids(spark):
    rng = random.Random(8)
    rows = [(None, sentence(rng, 40)) for _ in range(60)]
    rows += [(None, t + " tail") for _, t in rows[:30]] + [(7, t) for _, t in rows[30:40]] + [(7, rows[30][1])] * 20
    got = near_dedup.near_duplicates(frame(spark, rows), 3, 85, 100).collect()
    assert Counter(map(tuple, got)) == brute_near(rows, 3, 85, 100)
    # One text for each class, however many rows share its id.
    plain = frame(spark, rows).select("doc_id", "text")
    own = near_dedup.sketched(links.with_key(plain), 3)
    tables = Tables(spark)
    classes = tables.stage(links.classes_of(own), "test-classes")
    assert links.texts_of(classes, classes, plain).count() == classes.count() == 90
    tables.finish(classes.limit(0), "test-classes")


def test_near_duplicates_of_nothing(spark):
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0
    only = near_dedup.near_duplicates(frame(spark, [(1, None), (2, ""), (None, "a b")])).collect()
    assert Counter(map(tuple, only)) == Counter([(1, 0, 1, True), (2, 0, 2, True), (None, 1, None, True)])


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 900).astype(np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 2**63, 100).astype(np.uint64)])
    sa, sb = setsketch.sketch(a), setsketch.sketch(b)
    assert (setsketch.merge(sa, sb) == setsketch.sketch(np.union1d(a, b))).all()
    j = setsketch.likeliest_jaccard(np.asarray([(sa > sb).sum()]), np.asarray([(sa < sb).sum()]), np.asarray([900]), np.asarray([900]))[0]
    assert abs(j - 0.8) < 0.15
    assert setsketch.sketch(a[:0]).sum() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)]
    got = {r["node"]: r["root"] for r in links.components(spark.createDataFrame(edges, "a long, b long"), Tables(spark)).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert got == {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}


def planted(seed=3):
    rng = random.Random(seed)
    items = [(k, sentence(rng, rng.choice((8, 20, 37, 55)))) for k in range(12)] + [(50, None), (51, ""), (52, "one two"), (0, None)]
    docs = []
    for k in range(40):
        t = sentence(rng, 100).split()
        if k % 3 == 0:
            own = items[k % 12][1].split()
            if k % 2:
                own[0] = "changed"
            t[50:50] = [w.upper() + "!" * (k % 2) for w in own]
        docs.append((k, " ".join(t)))
    return docs + [(100, items[3][1]), (101, items[3][1][:-3]), (102, None), (103, ""), (None, items[4][1]), (104, "x one two y")], items


def brute_leaks(docs, items):
    out = set()
    for i, t in docs:
        w = words_of(t or "")
        for item, text in items:
            own = words_of(text or "")
            size = min(len(own), len(w))
            if own and w and max(overlap(Counter(shingles_of(w[s : s + size])), Counter(shingles_of(own))) for s in range(len(w) - size + 1)) >= 0.8:
                out.add((i, item))
    return out


def test_decontamination(spark):
    docs, items = planted()
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("item_id", "text", "'x' AS size", "'y' AS doc_id")
    for limit in (8 << 20, 300):  # several passes, the same result
        got = contaminated(frame(spark, docs), bench, pass_bytes=limit).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == brute_leaks(docs, items)
        assert all(r["distance"] <= 40 and r["similarity"] >= 0.8 for r in got)
    assert contaminated(frame(spark, []), bench).count() == 0
    assert contaminated(frame(spark, docs), bench.limit(0)).count() == 0


def test_short_items_that_occur_twice():
    for text in ("one", "one two", "one two three four", "one two three four five"):
        found = Items([(1, text)]).matches(f"x {text} y {text} z", 0.8)
        assert found == [(1, 1.0, 1, len(text.split()), 0)]


def test_repeated_shingles_on_either_side():
    rng = random.Random(4)
    for shared, tail in ((53, 10), (90, 14), (260, 30)):
        for k in range(5):
            own = [sentence(rng, shared), sentence(rng, tail), " ".join(["blah"] * tail)]
            plain, masked, after = f"{own[0]} {own[1]}", f"{own[0]} {own[2]}", sentence(rng, 30)
            for item, passage in ((plain, masked), (masked, plain), (masked, masked)):
                items, docs = [(1, item), (2, sentence(rng, shared + tail))], [(k, f"{after} {passage} {after}")]
                found = {(k, x[0]) for x in Items(items).matches(docs[0][1], 0.8)}
                assert found == brute_leaks(docs, items)
    assert found == {(4, 1)}


def test_best_windows_equal_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        words = ["a", "b", "c"] if rng.random() < 0.5 else sentence(rng, 20).split()
        text = [rng.choice(words) for _ in range(rng.randint(1, 40))]
        items = [(k, " ".join(text[s : s + rng.randint(1, 30)] + [rng.choice(words)] * rng.randint(0, 2))) for k in range(4) for s in [rng.randrange(len(text))]]
        got = {x[0]: x[1:4] for x in Items(items).matches(" ".join(text), 0.8)}
        for k, item in items:
            own = item.split()
            size = min(len(own), len(text))
            best = min((-overlap(Counter(shingles_of(text[s : s + size])), Counter(shingles_of(own))), s) for s in range(len(text) - size + 1))
            if any(n > 1 for n in Counter(shingles_of(own)).values()) or len(own) <= 5 or best[0] == -1 or k in got:
                assert got.get(k) == ((-best[0], best[1], size) if -best[0] >= 0.8 else None)


def test_blocks_find_all_within_radius():
    from studyloom.llm import decontaminate as d

    rng = np.random.default_rng(1)
    item = rng.integers(0, 256, 16).astype(np.uint8)
    index = Items([(1, "a b c d e f g")])
    m = next(iter(index.by_size))
    near = np.stack([d.NEAR[:, item[k : k + 1]] for k in range(d.BLOCKS)])
    for _ in range(300):
        bits = np.unpackbits(item)
        bits[rng.choice(128, d.RADIUS, replace=False)] ^= 1
        print_ = np.packbits(bits)
        assert any(near[k][print_[k], 0] for k in range(d.BLOCKS))
    assert m == 7


def test_largest_component_meets_only_others(spark, monkeypatch):
    """A row for each class and block of those outside: in proportion to the component, not with its square."""
    tables, counts = Tables(spark), []
    for size in (2000, 4000):
        shared = spark.range(size + 3).select(F.lit(7).alias("band"), F.col("id").alias("node"), F.lit(100).cast("long").alias("n"), F.lit(size + 3).cast("long").alias("members"))
        roots = spark.range(size).select(F.col("id").alias("node"), F.lit(0).cast("long").alias("root"))
        counts.append(links.dealt_to_tiles(shared, roots, 80, 100, tables).count())
        assert counts[-1] <= size + 3 * (2 + size // links.BLOCK)
    assert counts[1] <= 2 * counts[0]
    monkeypatch.setattr(links, "BLOCK", 4)
    monkeypatch.setattr(links, "LARGE", 8)
    shared = spark.range(60).select(F.col("id").alias("node"), F.expr("100 + 13 * (id % 5)").alias("n"), F.lit(7).alias("band"), F.lit(60).cast("long").alias("members"))
    roots = spark.range(40).select(F.col("id").alias("node"), F.lit(0).cast("long").alias("root"))
    met, rows = Counter(), links.dealt_to_tiles(shared, roots, 80, 100, tables).collect()
    for tile in {tuple(r[c] for c in links.TILE) for r in rows}:
        held = [r.asDict() for r in rows if tuple(r[c] for c in links.TILE) == tile]
        met.update(frozenset((held[i]["node"], held[j]["node"])) for i, others in links.open_pairs(held, lambda _: All()) for j in others.tolist())
    n = {r["node"]: r["n"] for r in rows}
    wanted = [p for p in itertools.combinations(range(60), 2) if p[1] >= 40 and min(n[p[0]], n[p[1]]) * 100 >= 80 * max(n[p[0]], n[p[1]])]
    assert all(met[frozenset(p)] == 1 for p in wanted) and set(met.values()) == {1}


class All:
    def partners(self, i, others):
        return others


def test_rows_that_meet(spark):
    rng = random.Random(5)
    for bounds in (False, True):
        rows = [(b, 100 * b + k, rng.randint(8, 14), rng.randint(7, 16)) for b in range(200) for k in range(rng.choice((1, 2, 2, 3, 5)))]
        df = spark.createDataFrame(rows, "band long, node long, n long, most long")
        got = {r["node"]: r["members"] for r in links.meeting(df if bounds else df.drop("most"), 80, 100).collect()}
        fits = lambda x, y: x[0] == y[0] and x[1] != y[1] and min(x[2], y[2]) * 100 >= 80 * max(x[2], y[2]) and (not bounds or x[2] <= y[3] and y[2] <= x[3])
        sizes = Counter(r[0] for r in rows)
        partners = {x[1] for x in rows if any(fits(x, y) for y in rows)}
        assert partners <= set(got) and all(got[x[1]] == sizes[x[0]] for x in rows if x[1] in got)
        assert {x[1] for x in rows if sizes[x[0]] <= 2 and x[1] in got} == {x[1] for x in rows if sizes[x[0]] == 2 and x[1] in partners}


def test_tiles_of_two(spark):
    """The pairs of a batch at once, as the filter finds them one by one; tiles cut by batches are put together."""
    rng, held = np.random.default_rng(3), []
    for band in range(300):
        base = rng.integers(0, 2**63, 120).astype(np.uint64)
        sets = [np.unique(np.concatenate([base[: rng.integers(70, 121)], rng.integers(0, 2**63, 9).astype(np.uint64)])) for _ in range(rng.choice((1, 2, 2, 2, 4)))]
        sketches = np.stack([setsketch.sketch(s) for s in sets])
        keys = setsketch.band_keys(sketches)
        sides = [(2, 2), (0, 1), (1, 0), (0, 0), (1, 1)][rng.integers(5)]
        for k, s in enumerate(sets):
            held.append({"band": held[-1]["band"] if k else int(keys[0, rng.integers(32)]), "size_a": 1, "block_a": band, "size_b": 1, "block_b": band, "node": len(held), "root": len(held) if rng.random() < 0.8 else -1, "n": len(s), "side": sides[k % 2], "most": int(rng.integers(80, 200)), "sketch": sketches[k].tobytes()})
    # Only tiles whose classes share the bucket.
    held = [r for r in held if all(r["band"] in setsketch.band_keys(np.frombuffer(x["sketch"], np.uint16)[None])[0] for x in held if x["block_a"] == r["block_a"])]
    table = pa.Table.from_pylist(held)
    whole, found = [], []
    for b, starts in links.whole_tiles(iter(table.to_batches(max_chunksize=7))):
        sizes = np.diff(np.append(starts, b.num_rows))
        whole += [b.slice(a, m).column("node").to_pylist() for a, m in zip(starts.tolist(), sizes.tolist(), strict=True)]
        found += [b.column("node")[k].as_py() for k in links.open_twos(b, starts[sizes == 2], lambda x, y: near_dedup.similar(x, y, 0.8)).tolist()]
    tiles = [list(g) for _, g in itertools.groupby(held, lambda r: r["block_a"])]
    assert whole == [[r["node"] for r in t] for t in tiles]
    assert found == [t[0]["node"] for t in tiles if len(t) == 2 and list(links.open_pairs(t, lambda h: near_dedup.SketchFilter(h, 0.8)))]
    assert 0 < len(found) < sum(len(t) == 2 for t in tiles)


def test_near_groups_with_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(links, "BLOCK", 4)
    monkeypatch.setattr(links, "LARGE", 3)
    monkeypatch.setattr(near_dedup, "estimated", lambda pairs, *_: pairs.where("a % 3 = 0"))
    rows = near_rows(21)
    got = near_dedup.near_duplicates(frame(spark, rows)).collect()
    assert Counter(map(tuple, got)) == brute_near(rows, 5, 80, 100)
