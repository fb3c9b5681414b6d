"""Column functions on numeric arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str, floor: float = 1e-12) -> Column:
    """Cosine with a floor under each norm, so a zero vector scores 0."""
    return dot(a, b) / (F.greatest(norm(a), F.lit(floor)) * F.greatest(norm(b), F.lit(floor)))


def unit(a: Column | str, floor: float = 1e-12) -> Column:
    return F.transform(col(a), lambda x: x / F.greatest(norm(a), F.lit(floor)))


def total(a: Column | str) -> Column:
    return F.aggregate(col(a), F.lit(0.0), lambda s, x: s + x)


def mean(a: Column | str) -> Column:
    return F.try_divide(total(a), F.size(col(a)))


def median(a: Column | str) -> Column:
    """Median of an array's non-null values; null for none."""
    s = F.array_sort(F.filter(col(a), lambda x: x.isNotNull()))
    n = F.size(s)
    lower, upper = F.get(s, F.floor((n - 1) / 2).cast("int")), F.get(s, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (lower + upper) / 2)


def resample(a: Column | str, n: int) -> Column:
    """Linear resampling of an array to n values: same length copies, one value repeats."""
    a = col(a)
    size = F.size(a)
    place = lambda i: i * (size - 1) / F.lit(float(max(n - 1, 1)))
    low = lambda i: F.floor(place(i)).cast("int")
    value = lambda i: F.get(a, low(i)) + (F.get(a, F.least(low(i) + 1, size - 1)) - F.get(a, low(i))) * (place(i) - low(i))
    return F.when(size == n, a).when(size == 1, F.array_repeat(F.get(a, F.lit(0)), n)).when(size > 1, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), value))


def gcd(a: Column | str) -> Column:
    """Greatest common divisor of an array of positive integers."""
    step = lambda p: F.struct(p["b"].alias("a"), (p["a"] % F.when(p["b"] == 0, 1).otherwise(p["b"])).alias("b"))
    # 64 steps of Euclid are enough for any pair of 64-bit numbers below 2**44
    pair = lambda x, y: F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.struct(x.cast("long").alias("a"), y.cast("long").alias("b")), lambda p, _: F.when(p["b"] == 0, p).otherwise(step(p)))["a"]
    return F.aggregate(col(a), F.lit(0).cast("long"), lambda s, x: pair(x.cast("long"), s))
