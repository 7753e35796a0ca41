"""Column expressions that several operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Start of FNV-1a and its prime, in 32-bit halves (the prime is 2**40 + 435).
FNV_HIGH, FNV_LOW, FNV_PRIME_LOW = 3421674724, 2216829733, 435
M32 = (1 << 32) - 1


def no_nan(c: Column) -> Column:
    """NaN as null, so that aggregates pass it over."""
    return F.when(~F.isnan(c), c)


def median(c: Column) -> Column:
    """The middle value, or the mean of the two; NaN left out."""
    return F.median(no_nan(c))


def squared_distance(a: Column, b: Column) -> Column:
    """Over the shorter of two arrays."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def hash_uniform(seed, *parts: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the parts alone: 52 bits of an md5."""
    key = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def snap(raw: Column, low: float, high: float, step: float) -> Column:
    """The nearest multiple of step above low, within the range."""
    return F.least(F.greatest(F.lit(low) + F.round((raw - low) / step) * step, F.lit(low)), F.lit(high))


def radical_inverse(index: Column, base: Column | int) -> Column:
    """Digits of index (0 at least) in this base, mirrored at the point (van der Corput). A base that is a number is
    the faster one: its digits are plain expressions."""
    if isinstance(base, int):
        powers = [base**k for k in range(64) if base**k < 1 << 63]
        digit = lambda p: F.call_function("div", index.cast("long"), F.lit(p).cast("long")) % base
        return reduce(lambda x, y: x + y, [digit(p) / float(p * base) for p in powers])

    def step(acc: Column, _: Column) -> Column:
        more, f = acc["i"] > 0, acc["f"] / base
        return F.struct(F.when(more, F.floor(acc["i"] / base)).otherwise(0).cast("long").alias("i"), F.when(more, f).otherwise(acc["f"]).alias("f"), F.when(more, acc["r"] + f * (acc["i"] % base)).otherwise(acc["r"]).alias("r"))

    start = F.struct(index.cast("long").alias("i"), F.lit(1.0).alias("f"), F.lit(0.0).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), start, step, lambda acc: acc["r"])


def fnv1a(text: Column) -> Column:
    """(hi, lo) of the 64-bit FNV-1a of the UTF-8 bytes, as two unsigned 32-bit halves in longs."""
    hexed = F.hex(F.encode(text, "UTF-8"))
    codes = F.transform(F.sequence(F.lit(1), F.greatest(F.length(hexed), F.lit(2)) - 1, F.lit(2)), lambda k: F.conv(F.substring(hexed, k, F.lit(2)), 16, 10).cast("long"))
    codes = F.when(F.length(hexed) > 0, codes).otherwise(F.array().cast("array<bigint>"))

    def step(acc: Column, x: Column) -> Column:
        lo = acc["lo"].bitwiseXOR(x)
        low = lo * FNV_PRIME_LOW
        high = acc["hi"] * FNV_PRIME_LOW + F.shiftrightunsigned(low, 32) + lo * 256
        return F.struct(high.bitwiseAND(F.lit(M32)).alias("hi"), low.bitwiseAND(F.lit(M32)).alias("lo"))

    return F.aggregate(codes, F.struct(F.lit(FNV_HIGH).cast("long").alias("hi"), F.lit(FNV_LOW).cast("long").alias("lo")), step)


def hash_bucket(text: Column, dim: int) -> Column:
    """FNV-1a modulo dim, unsigned."""
    h = fnv1a(text)
    return ((h["hi"] % dim) * ((1 << 32) % dim) + h["lo"] % dim) % dim


def tokens(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[^\p{IsAlphabetic}\p{N}]+", -1)
    return F.transform(F.filter(parts, lambda x: x != ""), F.lower)


def box_iou(a: Column, b: Column) -> Column:
    """Intersection over union of boxes [x1, y1, x2, y2] whose corners may come in any order; 0 without area."""
    lo, hi = (lambda c, k: F.least(c[k], c[k + 2]).cast("double")), (lambda c, k: F.greatest(c[k], c[k + 2]).cast("double"))
    side = lambda k: F.greatest(F.least(hi(a, k), hi(b, k)) - F.greatest(lo(a, k), lo(b, k)), F.lit(0.0))
    area = lambda c: (hi(c, 0) - lo(c, 0)) * (hi(c, 1) - lo(c, 1))
    both = side(0) * side(1)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def fuse(vectors: Column, how: str) -> Column:
    """Feature vectors of several modalities as one: concat, mean or sum (of equal lengths)."""
    if how == "concat":
        return F.flatten(vectors)
    total = F.aggregate(F.slice(vectors, F.lit(2), F.size(vectors)), vectors[0].cast("array<double>"), lambda acc, v: F.zip_with(acc, v.cast("array<double>"), lambda x, y: x + y))
    if how == "sum":
        return total
    if how == "mean":
        return F.transform(total, lambda x: x / F.size(vectors))
    raise ValueError(f"no such fusion: {how}")


def map_le(request: Column, free: Column, eps: float = 1e-9) -> Column:
    """Whether each amount asked for is free; a key that is missing counts as 0."""
    pairs = F.map_zip_with(request, free, lambda _, a, b: F.coalesce(a, F.lit(0.0)) <= F.coalesce(b, F.lit(0.0)) + eps)
    return F.forall(F.map_values(pairs), lambda x: x)
