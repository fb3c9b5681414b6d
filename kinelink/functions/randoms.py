"""Random numbers from keyed hashes: the same key gives the same number on any partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCALE = 1 << 53


def uniform(seed: int, *keys: Column | str) -> Column:
    """In (0, 1)."""
    bits = F.xxhash64(F.lit(seed), *keys).bitwiseAND(F.lit(_SCALE - 1))
    return (bits + 0.5) / float(_SCALE)


def normal(seed: int, *keys: Column | str) -> Column:
    return F.sqrt(-2 * F.log(uniform(seed, *keys, F.lit("r")))) * F.cos(2 * math.pi * uniform(seed, *keys, F.lit("a")))


def pick(values, seed: int, *keys: Column | str) -> Column:
    """One of the values, each as likely."""
    n = len(values)
    return F.get(F.array(*(F.lit(v) for v in values)), F.least(F.floor(uniform(seed, *keys) * n), F.lit(n - 1)).cast("int"))


def whole(low: int | Column, high: int | Column, seed: int, *keys: Column | str) -> Column:
    """Whole number from low to high, both included."""
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return (low + F.least(F.floor(uniform(seed, *keys) * (high - low + 1)), high - low)).cast("long")
