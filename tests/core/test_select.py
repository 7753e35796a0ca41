import math
import random
import statistics
import struct

import pytest
from pyspark.sql import functions as F

from studyloom.operators import select as S

HARD = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.2250738585072009e-308, 1.7976931348623157e308, math.inf, -math.inf, 1.0, math.nextafter(1.0, 0), math.nextafter(1.0, 2), 2.0**52, 2.0**53 - 1, 0.1, 1e22, 3.0, math.nextafter(8.0, 0), 8.0]


def test_order_key(spark):
    rng = random.Random(1)
    values = HARD + [-x for x in HARD] + [rng.uniform(-5, 5) * 10.0 ** rng.randint(-300, 300) for _ in range(3000)] + [2.0**k for k in range(-1074, 1024, 7)] + [math.nextafter(2.0**k, 0) for k in range(-1073, 1024, 7)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for r in df.select("v", S.order_key(F.col("v")).alias("k")).collect():
        bits = struct.unpack(">q", struct.pack(">d", abs(r["v"])))[0]
        assert r["k"] == (-bits if r["v"] < 0 else bits)


def wanted(rows, ranks):
    groups = {}
    for g, v in rows:
        if v is not None and not math.isnan(v):
            groups.setdefault(g, []).append(v)
    return {g: (len(own), *[sorted(own)[r(len(own))] if 0 <= r(len(own)) < len(own) else None for r in ranks]) for g, own in groups.items()}


@pytest.mark.parametrize("cell", [3, 8192])
def test_ranks_equal_sorting(spark, monkeypatch, cell):
    monkeypatch.setattr(S, "CELL", cell)
    rng = random.Random(cell)
    rows = [("wide", rng.choice([-1, 1]) * 10.0 ** rng.uniform(-200, 200)) for _ in range(300)]
    rows += [("close", 1.0 + rng.randint(0, 50) * 2.0**-52) for _ in range(200)] + [("ties", float(rng.randint(0, 2))) for _ in range(200)] + [("one", 7.0), (None, 3.0), (None, 1.0)]
    rows += [("some", v) for v in (None, math.nan, -1.0, -2.0)] + [("none", None), ("none", math.nan)] + [("hard", v) for v in HARD]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double")
    n = F.col("n")
    got = S.at_ranks(df, ["g"], "v", {"low": F.lit(0), "mid": F.floor(n / 2), "third": F.lit(2), "top": n - 1})
    assert got.columns == ["g", "n", "low", "mid", "third", "top"]
    assert {r["g"]: tuple(r)[1:] for r in got.collect()} == wanted(rows, [lambda n: 0, lambda n: n // 2, lambda n: 2, lambda n: n - 1])
    if cell == 3:
        found = {r["g"]: r["median"] for r in S.medians(df.where("g <> 'hard'"), ["g"], "v").collect()}
        assert found == {g: statistics.median([v for h, v in rows if h == g and v is not None and not math.isnan(v)]) for g in ("wide", "close", "ties", "one", "some")}


def test_one_group_is_the_table(spark, monkeypatch):
    monkeypatch.setattr(S, "CELL", 10)
    df = spark.range(20_000).select((F.pmod(F.xxhash64("id"), F.lit(100_003)) / 7).alias("v")).repartition(64)
    own = sorted(r["v"] for r in df.collect())
    got = S.at_ranks(df, [], "v", {"a": F.lit(1234), "b": F.col("n") - 5}).collect()
    assert [tuple(r) for r in got] == [(20_000, own[1234], own[-5])]
    assert S.at_ranks(df.limit(0), [], "v", {"a": F.lit(0)}).collect()[0]["a"] is None
    assert S.at_ranks(df.limit(0).withColumn("g", F.lit(1)), ["g"], "v", {"a": F.lit(0)}).count() == 0
