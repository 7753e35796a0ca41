"""Segmented scans: places, running aggregates and neighbours in groups of any size.

A window function sends a group to one task. Here rows are cut into ranges of (keys, order), so a large group spreads
over many parts, and the table of parts is written, since the cuts come from a sample. Each part
and group then has a few numbers: how many rows, their sum, least and largest value, first and last values. Those are
summed up over the parts before (or after) within the group, which takes a row per part and group, and each part
adds what comes from outside to windows of its own.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans import scratch


@dataclass(frozen=True)
class Measure:
    """What is asked for of each row, from the rows of its group in their order."""

    kind: str
    column: str | None = None
    k: int = 1


def place() -> Measure:
    """1 for the group's first row, and so on."""
    return Measure("place")


def size() -> Measure:
    """The number of rows of the group."""
    return Measure("size")


def running(how: str, column: str) -> Measure:
    """sum, count, min, max or mean of the rows up to this one; nulls are passed over."""
    if how not in ("sum", "count", "min", "max", "mean"):
        raise ValueError(f"no such aggregate: {how}")
    return Measure(how, column)


def lag(column: str, k: int = 1) -> Measure:
    """The value k rows before, null where there is none."""
    return Measure("lag", column, k)


def lead(column: str, k: int = 1) -> Measure:
    return Measure("lead", column, k)


def last(column: str, k: int) -> Measure:
    """The values of the k rows before, oldest first; fewer where there are fewer. Nulls stay."""
    return Measure("last", column, k)


def cut(df: DataFrame, keys: list[str], order: list[Column | str], parts: int | None = None) -> DataFrame:
    """df with `_part`: its range of (keys, order), written in the scratch folder. Rows that are equal in
    keys and order share a part, so the order should tell rows apart."""
    n = parts or scratch.slots(df.sparkSession)
    return scratch.stage(df.repartitionByRange(n, *keys, *order).withColumn("_part", F.spark_partition_id()), "scan")


def same(keys: list[str], other: dict[str, Column], rows: DataFrame) -> Column:
    return reduce(lambda x, y: x & y, [rows[k].eqNullSafe(c) for k, c in other.items()])


def scan(df: DataFrame, keys: list[str], order: list[Column | str], measures: dict[str, Measure], parts: int | None = None) -> DataFrame:
    """df with a column for each measure, within groups of equal keys (null is a key like any other; no keys: one group) and in the
    given order. Ties in the order come in any order. An empty table stays empty."""
    rows = cut(df, keys, order, parts)
    groups = ["_part", *keys]
    local = W.partitionBy(*groups).orderBy(*order)
    above = local.rowsBetween(W.unboundedPreceding, 0)
    aggs = {"_n": F.count("*")}
    for m in measures.values():
        if m.kind in ("sum", "mean"):
            aggs[f"_sum_{m.column}"] = F.sum(m.column)
        if m.kind in ("count", "mean"):
            aggs[f"_count_{m.column}"] = F.count(m.column)
        if m.kind in ("min", "max"):
            aggs[f"_{m.kind}_{m.column}"] = getattr(F, m.kind)(m.column)
    parts_of = rows.groupBy(*groups).agg(*[a.alias(c) for c, a in aggs.items()])
    for kind, kinds, direction in (("_tail", ("lag", "last"), True), ("_head", ("lead",), False)):
        wanted = [m for m in measures.values() if m.kind in kinds]
        if wanted:
            k, columns = max(m.k for m in wanted), sorted({m.column for m in wanted})
            back = [F.col(c) if isinstance(c, str) else c for c in order]
            ends = edges(rows, groups, back, columns, k, kind, direction)
            renamed = {c: ends[c] for c in groups}
            parts_of = parts_of.join(ends.select(*[ends[c].alias(f"_e{c}") for c in groups], kind), same(groups, {c: F.col(f"_e{c}") for c in groups}, parts_of)).drop(*[f"_e{c}" for c in renamed])
    ordered = W.partitionBy(*keys).orderBy("_part")
    before, after, every = ordered.rowsBetween(W.unboundedPreceding, -1), ordered.rowsBetween(1, W.unboundedFollowing), W.partitionBy(*keys)
    carried = {"_size": F.sum("_n").over(every), "_before": F.coalesce(F.sum("_n").over(before), F.lit(0))}
    for c in aggs:
        if c != "_n":
            over = F.sum if c.startswith(("_sum_", "_count_")) else F.min if c.startswith("_min_") else F.max
            carried[f"_b{c}"] = over(c).over(before)
    tails = [m for m in measures.values() if m.kind in ("lag", "last")]
    heads = [m for m in measures.values() if m.kind == "lead"]
    if tails:
        k = max(m.k for m in tails)
        joined = F.flatten(F.collect_list("_tail").over(before))
        carried["_b_tail"] = F.slice(joined, F.greatest(F.lit(1), F.size(joined) - (k - 1)), k)
    if heads:
        carried["_b_head"] = F.slice(F.flatten(F.collect_list("_head").over(after)), 1, max(m.k for m in heads))
    carry = parts_of.select(*[F.col(c).alias(f"_k{c}") for c in groups], *[c.alias(n) for n, c in carried.items()])
    joined = rows.join(carry, same(groups, {c: carry[f"_k{c}"] for c in groups}, rows))
    row = F.row_number().over(local)
    out = {}
    for name, m in measures.items():
        c = m.column
        if m.kind == "place":
            out[name] = F.col("_before") + row
        elif m.kind == "size":
            out[name] = F.col("_size")
        elif m.kind in ("min", "max"):
            out[name] = (F.least if m.kind == "min" else F.greatest)(F.col(f"_b_{m.kind}_{c}"), getattr(F, m.kind)(c).over(above))
        elif m.kind in ("sum", "count", "mean"):
            total = lambda kind, f, c=c: F.coalesce(F.col(f"_b_{kind}_{c}") + f(c).over(above), F.col(f"_b_{kind}_{c}"), f(c).over(above))
            out[name] = total("sum", F.sum) / F.nullif(total("count", F.count), F.lit(0)) if m.kind == "mean" else total(m.kind, F.sum if m.kind == "sum" else F.count)
        elif m.kind == "lag":
            outside = F.try_element_at("_b_tail", (F.size("_b_tail") - m.k + row).cast("int"))
            out[name] = F.when(row > m.k, F.lag(c, m.k).over(local)).when(F.size("_b_tail") - m.k + row >= 1, outside[c])
        elif m.kind == "lead":
            left = F.count("*").over(W.partitionBy(*groups)) - row
            out[name] = F.when(left >= m.k, F.lead(c, m.k).over(local)).when(F.size("_b_head") >= m.k - left, F.try_element_at("_b_head", (m.k - left).cast("int"))[c])
        elif m.kind == "last":
            # Structs, as a list of bare values would pass over nulls.
            inside = F.collect_list(F.struct(c)).over(local.rowsBetween(-m.k, -1))
            both = F.concat(F.col("_b_tail")[c], inside[c])
            out[name] = F.slice(both, F.greatest(F.lit(1), F.size(both) - (m.k - 1)), m.k)
        else:
            raise ValueError(f"no such measure: {m.kind}")
    return joined.select(*[rows[c] for c in df.columns], *[c.alias(n) for n, c in out.items()])


def edges(rows: DataFrame, groups: list[str], order: list[Column], columns: list[str], k: int, name: str, last_ones: bool) -> DataFrame:
    """(groups, name): the first or last k rows of each part and group, as a list of structs in their order."""
    local = W.partitionBy(*groups).orderBy(*order)
    numbered = rows.withColumn("_r", F.row_number().over(local)).withColumn("_m", F.count("*").over(W.partitionBy(*groups)))
    kept = numbered.where(F.col("_r") > F.col("_m") - k if last_ones else F.col("_r") <= k)
    packed = F.array_sort(F.collect_list(F.struct("_r", F.struct(*columns).alias("_v"))))
    return kept.groupBy(*groups).agg(F.transform(packed, lambda x: x["_v"]).alias(name))
