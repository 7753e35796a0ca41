import random

import pytest
from pyspark.sql import functions as F

from studyloom.plans import lowered
from studyloom.plans.samplers import GridSampler, HaltonSampler, History
from studyloom.plans.space import Distribution as D
from studyloom.plans.space import SearchSpace
from studyloom.schema import InvalidSpace


def mixed():
    s = SearchSpace()
    s.add("model", D.categorical(["mlp", "tree", "net"]))
    s.add("lr", D.log_float(1e-5, 0.3))
    s.add("drop", D.stepped_float(0.0, 0.5, 0.125), when=("model", ["mlp", "net"]))
    s.add("depth", D.int(2, 11, 3), when=("model", ["tree"]))
    s.add("wide", D.boolean(), when=("model", ["net"]))
    s.add("units", D.log_int(4, 900), when=("wide", [True]))
    s.add("rate", D.float(-1.0, 2.0), when=("depth", [2, 8]))
    return s


def params_of(row, space):
    return {p.name: row[p.name] for p in space.params if row[p.name] is not None}


def test_samples_equal_the_driver(spark):
    space, rng = mixed(), random.Random(1)
    rows = [[k, *[rng.choice([rng.random(), 0.0, 1 - 2.0**-53, 0.5]) for _ in space.params]] for k in range(600)]
    names = [f"u{d}" for d in range(len(space.params))]
    df = spark.createDataFrame(rows, ["id", *names])
    got = lowered.sampled(df, space, lambda d, _: F.col(f"u{d}")).collect()
    for r in got:
        out = {}
        for d, p in enumerate(space.params):
            if space.active(p, out):
                out[p.name] = p.distribution.from_unit(r[f"u{d}"])
        mine = params_of(r, space)
        assert set(mine) == set(out) and space.valid(mine)
        assert all(v == pytest.approx(out[n], rel=1e-12) if isinstance(v, float) else v == out[n] for n, v in mine.items())
    assert sum(r["rate"] is not None for r in got) > 20 and sum(r["units"] is not None for r in got) > 20


def test_random_points_are_valid_and_repeatable(spark):
    space, df = mixed(), spark.range(1500)
    a = lowered.random_points(df, space, "id", 3).collect()
    assert all(space.valid(params_of(r, space)) for r in a)
    assert sorted(a) == sorted(lowered.random_points(df.repartition(7), space, "id", 3).collect())
    assert a != lowered.random_points(df, space, "id", 4).collect()


def test_halton_points_equal_the_sampler(spark):
    space, h = mixed(), HaltonSampler()
    for r in lowered.halton_points(spark.range(200), space, "id").collect():
        mine, theirs = params_of(r, space), h.suggest(space, History(), r["id"])
        assert set(mine) == set(theirs)
        assert all(v == pytest.approx(theirs[n], rel=1e-9) if isinstance(v, float) else v == theirs[n] for n, v in mine.items())


@pytest.mark.parametrize("points", [1, 3])
def test_unranked_grid_is_the_grid(spark, points):
    space = mixed()
    space.params[5] = type(space.params[5])("units", D.int(4, 9, 2), space.params[5].condition)
    grid = space.grid(points)
    program = lowered.GridProgram(space, points)
    assert program.total == len(grid)
    df = spark.range(2 * len(grid) + 3)
    for r in program.unranked(df, "id").collect():
        mine = params_of(r, space)
        assert set(mine) == set(grid[r["id"] % len(grid)])
        assert all(v == pytest.approx(grid[r["id"] % len(grid)][n]) if isinstance(v, float) else v == grid[r["id"] % len(grid)][n] for n, v in mine.items())
    sampler = GridSampler(points)
    assert [sampler.suggest(space, History(), 0) for _ in range(3)] == grid[:3]


def test_large_grids_are_not_listed(spark):
    space = SearchSpace()
    for k in range(9):
        space.add(f"x{k}", D.int(0, 99))
    space.add("last", D.categorical(["a", "b"]))
    program = lowered.GridProgram(space)
    assert program.total == 2 * 100**9
    at = 123_456_789_012_345_678
    r = program.unranked(spark.createDataFrame([(at,)], "id long"), "id").first()
    assert int("".join(f"{r[f'x{k}']:02d}" for k in range(9))) * 2 + "ab".index(r["last"]) == at


def test_nothing_and_faults(spark):
    assert lowered.random_points(spark.range(0), mixed(), "id", 1).count() == 0
    with pytest.raises(InvalidSpace):
        lowered.sampled(spark.range(1), SearchSpace().add("a", D.boolean(), when=("b", [True])), lambda d, n: F.lit(0.5))


def test_ready_spaces(spark):
    from studyloom.plans import ready

    for space in (ready.tabular_space(), ready.digits_space(), ready.gan_space(12), ready.gan_space(12, [4, 8]), ready.transformer_space()):
        assert all(space.valid(params_of(r, space)) for r in lowered.random_points(spark.range(60), space, "id", 2).collect())
    assert ready.gan_space(0).params[0].distribution.choices == ("1",) and ready.gan_space(3, [4, 8]).params[0].distribution.choices == ("4", "8")
    rows = ready.transformer_points(spark.range(80), "id", 1).collect()
    assert all(r["d_model"] % int(r["n_heads"]) == 0 and r["ff_dim"] == r["d_model"] * r["ff_ratio"] for r in rows)


def test_evaluations(spark):
    from studyloom.operators import folds
    from studyloom.schema import StudyError

    df = spark.range(40).selectExpr("id", "id % 2 AS y")
    got = {how: sorted((r["id"], r["fold"]) for r in folds.evaluation(df, how, 4, 1, label).collect()) for how, label in (("holdout", None), ("kfold", None), ("stratified", "y"))}
    assert sum(f == 0 for _, f in got["holdout"]) == 8
    assert got["kfold"] == sorted((r["id"], r["fold"]) for r in folds.evaluation(df, "stratified", 4, 1).collect())
    assert {(i % 2, f): 0 for i, f in got["stratified"]}.keys() == {(y, f) for y in (0, 1) for f in range(4)}
    with pytest.raises(StudyError):
        folds.evaluation(df, "leave-one-out")
