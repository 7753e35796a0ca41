import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from common import awkward, frame, sentence
from test_dedup import brute_near, near_rows

from studyloom.llm import links, ngram_join


def without_kept(counted):
    out = Counter()
    for (i, n, c, _), k in counted.items():
        out[i, n, c] += k
    return out


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, monkeypatch, small):
    if small:  # small tiles and stars, an order by sampled counts
        monkeypatch.setattr(links, "BLOCK", 4)
        monkeypatch.setattr(links, "FAN", 3)
        monkeypatch.setattr(ngram_join, "SAMPLE", 2)
        monkeypatch.setattr(ngram_join, "COMMON_AT", 2)
    rows = near_rows(11 + small)
    for width, num, den in ((5, 80, 100), (2, 60, 100)):
        got = ngram_join.ngram_join(frame(spark, rows), width, num, den).collect()
        assert Counter(map(tuple, got)) == without_kept(brute_near(rows, width, num, den))


def test_without_stars(spark, monkeypatch):
    """All links come from tiles: what the star finds is left out."""
    monkeypatch.setattr(ngram_join, "bounded", lambda pairs, *_: pairs.limit(0))
    monkeypatch.setattr(links, "BLOCK", 8)
    rows = near_rows(13)
    got = ngram_join.ngram_join(frame(spark, rows)).collect()
    assert Counter(map(tuple, got)) == without_kept(brute_near(rows, 5, 80, 100))


def test_sizes_at_the_edge(spark):
    rng = random.Random(4)
    rows = []
    for g, n in enumerate((4, 5, 8, 20, 44, 64, 100, 400)):  # n of n / 0.8 shingles, exactly and one fewer
        words = sentence(rng, 2 * n + 10).split()
        for k, size in enumerate((n, n * 5 // 4, n * 5 // 4 + 1)):
            rows.append((100 * g + k, " ".join(words[: size + 4])))
    got = ngram_join.ngram_join(frame(spark, rows)).collect()
    assert Counter(map(tuple, got)) == without_kept(brute_near(rows, 5, 80, 100))
    assert len({r["component_id"] for r in got}) < len(rows)


def test_bitmaps_bound_overlaps():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n, m = rng.integers(1, 900, 2)
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: rng.integers(0, len(a) + 1)], rng.integers(0, 2**63, m).astype(np.uint64)]))
        x, y = ngram_join.bitmap(a), ngram_join.bitmap(b)
        words = min(len(x), len(y))
        x, y = ngram_join.folded(x, words), ngram_join.folded(y, words)
        common = len(np.intersect1d(a, b))
        assert np.bitwise_count(x & ~y).sum() <= len(a) - common
        assert np.bitwise_count(y & ~x).sum() <= len(b) - common


def test_prefixes_of_linked_sets_meet():
    rng = np.random.default_rng(3)
    universe = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
    common = (universe[::3], rng.integers(4, 50, len(universe[::3])))
    met = 0
    for _ in range(2000):
        a = np.sort(rng.choice(universe, rng.integers(1, 60), replace=False))
        b = np.union1d(np.delete(a, rng.integers(0, len(a), rng.integers(0, 6))), rng.choice(universe, rng.integers(0, 6)))
        if links.linked(a, b, 80, 100):
            met += 1
            assert len(np.intersect1d(ngram_join.prefix(a, common, 80, 100), ngram_join.prefix(b, common, 80, 100)))
    assert met > 200


def test_awkward_rows(spark):
    rows = awkward(3) + [(None, None), (50, "\x0b\x0c"), (51, "A b C d"), (52, "a B c D"), (53, "a b c e")]
    got = ngram_join.ngram_join(frame(spark, rows)).collect()
    assert Counter(map(tuple, got)) == without_kept(brute_near(rows, 5, 80, 100))
    assert ngram_join.ngram_join(frame(spark, [])).count() == 0
    assert [tuple(r) for r in ngram_join.ngram_join(frame(spark, [(3, None)])).collect()] == [(3, 0, 3)]


def test_pairs_at_once_equal_filters(spark):
    """What the filters say about tiles of two, one by one, is said of a batch of pairs."""
    rng, tiles = np.random.default_rng(8), []
    universe = np.unique(rng.integers(0, 2**63, 500).astype(np.uint64))
    common = (universe[::3], rng.integers(4, 50, len(universe[::3])))
    while len(tiles) < 400:
        a = np.sort(rng.choice(universe, rng.integers(5, 300), replace=False))
        b = np.union1d(np.delete(a, rng.integers(0, len(a), len(a) // 10)), rng.integers(0, 2**63, rng.integers(0, len(a) // 5 + 1)).astype(np.uint64))
        prefixes = [ngram_join.prefix(x, common, 80, 100) for x in (a, b)]
        both = np.intersect1d(*prefixes)
        if len(both):
            band = int(rng.choice(both).view(np.int64))
            tiles.append([{"band": band, "n": len(x), "bits": ngram_join.bitmap(x).tobytes(), "prefix": ngram_join.pack(p)} for x, p in zip((a, b), prefixes, strict=True)])
    x, y = (pa.RecordBatch.from_pylist([t[k] for t in tiles]) for k in (0, 1))
    for kind, at_once in ((ngram_join.BitmapFilter, ngram_join.bits_meet), (ngram_join.FirstMeeting, ngram_join.first_meet)):
        wanted = [bool(len(kind(t, 80, 100).partners(0, np.asarray([1])))) for t in tiles]
        assert at_once(x, y, 80, 100).tolist() == wanted
        assert 0 < sum(wanted) < len(tiles)


@pytest.mark.parametrize("star", [False, True])
def test_large_buckets(spark, monkeypatch, star):
    if not star:
        monkeypatch.setattr(ngram_join, "bounded", lambda pairs, *_: pairs.where("a % 3 = 0"))
    monkeypatch.setattr(links, "BLOCK", 4)
    monkeypatch.setattr(links, "LARGE", 3)
    rows = near_rows(17)
    got = ngram_join.ngram_join(frame(spark, rows)).collect()
    assert Counter(map(tuple, got)) == without_kept(brute_near(rows, 5, 80, 100))
