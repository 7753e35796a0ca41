"""Search spaces as column programs: the parameters of many trials at once, from their ids.

`sampled` lowers a conditional space to a column per parameter: a guard that looks at the columns of its
parent, and the inverse of its cumulative distribution. `unranked` lowers the space's grid: the number of grid
points below each choice is a mixed radix, known for each context of choices that later parameters depend on, so point r comes
from divisions and short searches and no product is ever made.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import hash_uniform, radical_inverse
from .samplers import primes
from .space import Distribution, Param, SearchSpace

TYPES = {"float": "double", "int": "bigint", "categorical": "string", "bool": "boolean"}


def inverse(d: Distribution, u: Column) -> Column:
    """The value at u in [0, 1), as Distribution.from_unit gives it."""
    if d.kind == "bool":
        return u >= 0.5
    if d.kind == "categorical":
        at = F.least(F.floor(u * len(d.choices)), F.lit(len(d.choices) - 1)).cast("int")
        return F.element_at(F.array(*[F.lit(c) for c in d.choices]), at + 1)
    low, high = F.lit(float(d.low)), F.lit(float(d.high))
    if d.log:
        x = F.exp(F.lit(math.log(d.low)) + u * (math.log(d.high) - math.log(d.low)))
        x = F.floor(x + 0.5).cast("double") if d.kind == "int" else x
        return F.least(F.greatest(x, low), high).cast(TYPES[d.kind])
    if d.kind == "int":
        n = int((d.high - d.low) // d.step) + 1
        return F.lit(int(d.low)) + F.least(F.floor(u * n), F.lit(n - 1)).cast("bigint") * int(d.step)
    x = low + u * (float(d.high) - float(d.low))
    return F.least(F.greatest(low + F.floor((x - low) / d.step + 0.5) * d.step, low), high) if d.step else x


def guard(p: Param, made: dict[str, Column]) -> Column:
    """Whether the parameter is active; a parent that is not there is null and switches it off."""
    if p.condition is None:
        return F.lit(True)
    parent = made[p.condition.parent]
    return reduce(lambda x, y: x | y, [F.coalesce(parent == F.lit(v), F.lit(False)) for v in p.condition.equals], F.lit(False))


def sampled(df: DataFrame, space: SearchSpace, unit: Callable[[int, str], Column], prefix: str = "") -> DataFrame:
    """df with a column per parameter, null where it is not active. unit(d, name) is the uniform number of the d-th parameter."""
    space.validate()
    out, made = df, {}
    for d, p in enumerate(space.params):
        out = out.withColumn(prefix + p.name, F.when(guard(p, made), inverse(p.distribution, unit(d, p.name))).cast(TYPES[p.distribution.kind]))
        made[p.name] = F.col(prefix + p.name)
    return out


def random_points(df: DataFrame, space: SearchSpace, trial: str, seed: int, prefix: str = "") -> DataFrame:
    """Independent points: each number depends on the seed, the trial and the parameter's name alone."""
    return sampled(df, space, lambda _, name: hash_uniform(seed, F.col(trial), F.lit(name)), prefix)


def halton_points(df: DataFrame, space: SearchSpace, trial: str, skip: int = 5, prefix: str = "") -> DataFrame:
    """Halton points, as HaltonSampler proposes them at these positions."""
    base = primes(64)
    return sampled(df, space, lambda d, _: radical_inverse(F.col(trial) + skip + 1, base[d % 64]), prefix)


class GridProgram:
    """The conditional grid of a space, numbered as SearchSpace.grid lists it."""

    def __init__(self, space: SearchSpace, float_points: int = 5) -> None:
        self.params = space.validate().params
        self.values = [p.distribution.grid(float_points) for p in self.params]
        parents = {p.name: k for k, p in enumerate(self.params)}
        self.parent = [parents[p.condition.parent] if p.condition else None for p in self.params]
        #: For each place, the earlier parameters that a later one (or this one) depends on.
        self.context = [sorted({q for q in self.parent[k:] if q is not None and q < k}) for k in range(len(self.params) + 1)]
        self.sizes: list[dict[tuple, int]] = [{} for _ in range(len(self.params) + 1)]
        self.total = self.size(0, {})

    def active(self, k: int, chosen: dict[int, int]) -> bool:
        q = self.parent[k]
        if q is None:
            return True
        at = chosen[q]
        return at >= 0 and any(type(v) is type(self.values[q][at]) and v == self.values[q][at] for v in self.params[k].condition.equals)

    def size(self, k: int, chosen: dict[int, int]) -> int:
        """Grid points over the parameters from k on; only the context's choices matter, so each is worked out once."""
        key = tuple(chosen[q] for q in self.context[k])
        if k == len(self.params):
            return 1
        if key not in self.sizes[k]:
            if not self.active(k, chosen):
                self.sizes[k][key] = self.size(k + 1, chosen | {k: -1})
            elif k in self.context[k + 1]:
                self.sizes[k][key] = sum(self.size(k + 1, chosen | {k: v}) for v in range(len(self.values[k])))
            else:
                self.sizes[k][key] = len(self.values[k]) * self.size(k + 1, chosen | {k: 0})
        return self.sizes[k][key]

    def contexts(self, k: int) -> Iterable[tuple[tuple, dict[int, int]]]:
        return [(key, dict(zip(self.context[k], key, strict=True))) for key in self.sizes[k]]

    def unranked(self, df: DataFrame, trial: str, prefix: str = "") -> DataFrame:
        """df with a column per parameter: point `trial` modulo the grid's size, null where a parameter is not active."""
        out = df.withColumn("_rest", F.pmod(F.col(trial).cast("long"), F.lit(self.total)))
        for k, p in enumerate(self.params):
            own = self.context[k]
            key = F.concat_ws(",", *[F.col(f"_at{q}").cast("string") for q in own]) if own else F.lit("")
            label = lambda t: ",".join(map(str, t))
            table = lambda rows: F.create_map(*[x for name, value in rows for x in (F.lit(name), value)])
            on = [(label(t), c) for t, c in self.contexts(k) if self.active(k, c)]
            off = [label(t) for t, c in self.contexts(k) if not self.active(k, c)]
            is_on = ~key.isin(off) if off else F.lit(True)
            if not on:
                at, rest = F.lit(-1), F.col("_rest")
            elif k in self.context[k + 1]:
                starts = []
                for name, c in on:
                    low, edges = 0, []
                    for v in range(len(self.values[k])):
                        edges.append(low)
                        low += self.size(k + 1, c | {k: v})
                    starts.append((name, F.array(*[F.lit(e).cast("long") for e in edges])))
                edge = F.element_at(table(starts), key)
                found = F.size(F.filter(edge, lambda e: e <= F.col("_rest"))) - 1
                at, rest = F.when(is_on, found).otherwise(-1), F.when(is_on, F.col("_rest") - F.element_at(edge, found + 1)).otherwise(F.col("_rest"))
            else:
                tail = F.element_at(table([(name, F.lit(self.size(k + 1, c | {k: 0})).cast("long")) for name, c in on]), key)
                at = F.when(is_on, F.call_function("div", F.col("_rest"), tail)).otherwise(-1)
                rest = F.when(is_on, F.col("_rest") % tail).otherwise(F.col("_rest"))
            out = out.withColumn(f"_at{k}", at.cast("int")).withColumn("_rest", rest)
            value = F.element_at(F.array(*[F.lit(v) for v in self.values[k]]), F.col(f"_at{k}") + 1)
            out = out.withColumn(prefix + p.name, F.when(F.col(f"_at{k}") >= 0, value).cast(TYPES[p.distribution.kind]))
        return out.drop("_rest", *[f"_at{k}" for k in range(len(self.params))])
