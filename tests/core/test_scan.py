import random

import pytest

from studyloom.operators import scan as S


def brute(rows, measures):
    groups = {}
    for g, t, v in rows:
        groups.setdefault(g, []).append((t, v))
    out = {}
    for g, own in groups.items():
        own.sort()
        for k, (t, _) in enumerate(own):
            seen = [v for _, v in own[: k + 1] if v is not None]
            at = lambda j, own=own: own[j][1] if 0 <= j < len(own) else None
            out[g, t] = (
                k + 1, len(own), sum(seen) if seen else None, len(seen), min(seen, default=None), max(seen, default=None), sum(seen) / len(seen) if seen else None,
                at(k - 1), at(k - 3), at(k + 1), at(k + 2), [v for _, v in own[max(0, k - 3) : k]],
            )
    return out


MEASURES = {"place": S.place(), "size": S.size(), **{how: S.running(how, "v") for how in ("sum", "count", "min", "max", "mean")}, "lag1": S.lag("v"), "lag3": S.lag("v", 3), "lead1": S.lead("v"), "lead2": S.lead("v", 2), "last3": S.last("v", 3)}


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_scan_equals_brute_force(spark, parts):
    rng = random.Random(parts)
    # One group holds most rows, so it is spread over all parts; some have a row, one has a null key.
    rows = [("big", t, rng.choice([None, rng.randint(-9, 9)])) for t in rng.sample(range(10_000), 400)]
    rows += [(g, t, rng.randint(0, 5)) for g in ("a", "b", None) for t in range(rng.randint(1, 9))] + [("one", 5, 7), ("none", 1, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, t long, v long").withColumnRenamed("v", "v").selectExpr("*", "'x' AS other")
    got = S.scan(df, ["g"], ["t"], MEASURES, parts=parts)
    assert got.columns == ["g", "t", "v", "other", *MEASURES]
    assert {(r["g"], r["t"]): tuple(r[m] for m in MEASURES) for r in got.collect()} == brute(rows, MEASURES)


def test_one_group_is_spread(spark):
    df = spark.range(6400).selectExpr("1 AS g", "id AS t", "id AS v")
    parts = S.cut(df, ["g"], ["t"], parts=64).groupBy("_part").count().collect()
    assert len(parts) > 48 and max(r["count"] for r in parts) < 400
    assert S.scan(df, ["g"], ["t"], {"s": S.running("sum", "v"), "b": S.lag("t")}, parts=64).where("s <> t * (t + 1) / 2 OR b <> t - 1 OR (b IS NULL AND t > 0)").count() == 0


def test_no_keys_descending_and_empty(spark):
    from pyspark.sql import functions as F

    df = spark.range(50).selectExpr("id", "id % 5 AS v")
    got = S.scan(df, [], [F.desc("v"), "id"], {"p": S.place(), "n": S.size(), "next": S.lead("id")}, parts=8).orderBy("p").collect()
    wanted = sorted(range(50), key=lambda i: (-(i % 5), i))
    assert [r["id"] for r in got] == wanted and {r["n"] for r in got} == {50}
    assert [r["next"] for r in got] == [*wanted[1:], None]
    assert S.scan(df.limit(0), [], ["id"], {"p": S.place(), "b": S.lag("v")}).count() == 0
    with pytest.raises(ValueError):
        S.running("mode", "v")
