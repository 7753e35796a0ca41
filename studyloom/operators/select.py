"""Exact ranks (medians, quantiles, trimmed bounds) in many groups of any size.

A number becomes a 64-bit key in the same order. Each round looks at the next DIGIT bits of the keys: one aggregation counts
them for every group and rank, and a running count finds the cell that holds the rank, so a round gathers 2**DIGIT
rows for a group and rank at most, whatever its size. A cell of few rows is sorted, all cells
that are left at the end hold equal numbers. So no task sees a group's values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans import scratch

DIGIT = 12
#: A cell with so many rows or fewer is sorted by one task.
CELL = 8192


def order_key(x: Column) -> Column:
    """A long for each double, in the same order; equal numbers have equal keys. NaN is the largest, null stays null.

    The bits of the absolute value are its binary exponent and what is left of it, which is exact."""
    a = F.abs(x)
    guess = F.floor(F.log2(a))
    power = lambda e: F.pow(F.lit(2.0), e)
    e = guess + F.when(power(guess) > a, -1).when(power(guess + 1) <= a, 1).otherwise(0)
    e = F.greatest(e, F.lit(-1022))
    scaled = a / power(e)
    bits = ((e + 1022).cast("long") * (1 << 52)) + (scaled * float(1 << 52)).cast("long")
    whole = F.when(a == 0, F.lit(0)).when(a == float("inf"), F.lit(2047 << 52)).otherwise(bits).cast("long")
    return F.when(F.isnan(x), F.lit((1 << 63) - 1)).when(x < 0, -whole).otherwise(whole)


def equal(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [left[c].eqNullSafe(right[f"_r{c}"]) for c in names], F.lit(True))


def matched(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """left with the other columns of right, null matching null."""
    right = right.withColumnsRenamed({c: f"_r{c}" for c in names})
    return left.join(right, equal(left, right, names), how).drop(*[f"_r{c}" for c in names])


def at_ranks(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """(keys, n, a column for each of ranks): the values at these places, from 0 in ascending order.

    A rank is an expression of `n`, the number of values that are neither null nor NaN; it is null where the rank is outside. Groups with null and
    NaN values only are left out, null is a key like any other, and without keys all rows are one group."""
    x = F.col(value).cast("double")
    rows = df.select(*keys, x.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    rows = scratch.stage(rows.withColumn("_key", order_key(F.col("_v"))), "select-values")
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    targets = F.explode(F.array(*[F.struct(F.lit(name).alias("_name"), r.cast("long").alias("_rank")) for name, r in ranks.items()]))
    asked = sizes.select(*keys, "n", targets.alias("t")).select(*keys, "n", "t.*").where("_rank >= 0 and _rank < n")
    # Ranks of one group that are equal or fall into one cell are looked for together: cells are (keys, _prefix, _shift).
    state = scratch.stage(asked.withColumns({"_prefix": F.lit(0).cast("long"), "_shift": F.lit(64), "_cell": F.col("n")}), "select-state")
    cell = [*keys, "_prefix", "_shift"]
    above = 64
    while above > 0:
        shift, open_ = max(above - DIGIT, 0), (F.col("_cell") > CELL) & (F.col("_shift") > 0)
        wide = state.where(open_).select(*cell).distinct()
        if wide.isEmpty():
            break
        cells = matched(rows.withColumns(prefix_at("_key", above)), wide, cell)
        counts = cells.groupBy(*cell, F.shiftright("_key", shift).alias("_next")).agg(F.count("*").alias("_c"))
        order = W.partitionBy(*cell).orderBy("_next")
        counts = counts.withColumn("_below", F.sum("_c").over(order) - F.col("_c"))
        found = matched(state.where(open_), counts, cell).where((F.col("_rank") >= F.col("_below")) & (F.col("_rank") < F.col("_below") + F.col("_c")))
        moved = found.select(*keys, "n", "_name", (F.col("_rank") - F.col("_below")).alias("_rank"), F.col("_next").alias("_prefix"), F.lit(shift).alias("_shift"), F.col("_c").alias("_cell"))
        state = scratch.stage(state.where(~open_).unionByName(moved), "select-state")
        above = shift
    closed = state.select(*cell, "_cell").distinct()
    shifts = [r[0] for r in closed.select("_shift").distinct().collect()]
    values = None
    for shift in shifts:
        own = matched(rows.withColumns(prefix_at("_key", shift)), closed.where(F.col("_shift") == shift).drop("_cell"), cell)
        if shift == 0:  # one number, however many rows
            each = own.groupBy(*cell).agg(F.min("_v").alias("_v")).withColumn("_place", F.lit(None).cast("long"))
        else:
            each = own.withColumn("_place", (F.row_number().over(W.partitionBy(*cell).orderBy("_key")) - 1).cast("long")).select(*cell, "_v", "_place")
        values = each if values is None else values.unionByName(each)
    if values is None:
        return sizes.select(*keys, "n", *[F.lit(None).cast("double").alias(name) for name in ranks])
    hit = matched(state, values, cell).where(F.col("_place").isNull() | (F.col("_place") == F.col("_rank")))
    wide = hit.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in ranks])
    return matched(sizes, wide, keys, "left").select(*keys, "n", *ranks)


def prefix_at(key: str, shift: int) -> dict[str, Column]:
    """The cell of a key whose bits above `shift` are fixed."""
    prefix = F.lit(0).cast("long") if shift >= 64 else F.shiftright(key, shift)
    return {"_prefix": prefix, "_shift": F.lit(min(shift, 64))}


def middle(n: Column) -> dict[str, Column]:
    """The ranks of the two middle values of n."""
    return {"_low": F.call_function("div", n - 1, F.lit(2).cast("long")), "_high": F.call_function("div", n, F.lit(2).cast("long"))}


def medians(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """(keys, n, median): the middle value, or the mean of the two, of values that are neither null nor NaN."""
    found = at_ranks(df, keys, value, middle(F.col("n")))
    return found.select(*keys, "n", ((F.col("_low") + F.col("_high")) / 2).alias(name))
