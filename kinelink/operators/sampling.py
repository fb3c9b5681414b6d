"""Draws for resampling: permutations by key, and bootstrap sums dealt over shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
#: One added number for each round of the network.
_STEPS = [np.uint64(r * 0x9E3779B97F4A7C15 % (1 << 64)) for r in range(6)]
#: Rows of a bootstrap shard.
SHARD = 1 << 16


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


def permuted(place: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """Where the key's permutation of range(n) puts each place.

    A Feistel network permutes the next power of four from 256 on; a place that lands beyond n walks on until it is
    inside, so the places up to n are permuted among themselves. No list of n is made.
    """
    half = np.uint64(max(4, ((n - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, going = place.astype(np.uint64), np.arange(len(place))
    while len(going):
        x, k = out[going], key[going].astype(np.uint64)
        left, right = x >> half, x & mask
        for step in _STEPS:
            left, right = right, left ^ (_mixed(right + k + step) & mask)
        out[going] = (left << half) | right
        going = going[out[going] >= np.uint64(n)]
    return out.astype(np.int64)


def permuted_place(place: Column, key: Column, n: Column) -> Column:
    """Column function of `permuted`, for few draws out of many places."""

    @F.pandas_udf("long")
    def drawn(places: pd.Series, keys: pd.Series, sizes: pd.Series) -> pd.Series:
        out = np.empty(len(places), np.int64)
        for size in sizes.unique():
            at = (sizes == size).to_numpy()
            out[at] = permuted(places.to_numpy()[at], keys.to_numpy()[at].view(np.uint64), int(size))
        return pd.Series(out)

    return drawn(place, key, n)


def shard_draws(shard: int, shards: int, n: int, size: int, trials: int, seed: int) -> np.ndarray:
    """How many of a trial's n draws fall on a shard's rows, for every trial.

    From the root of a tree of shards down, a node's draws are split between its halves by a binomial draw that seed and node
    key, so every shard finds its share alone and all shares of a trial add up to n: together they are multinomial.
    """
    draws, low, high = np.full(trials, n, np.int64), 0, shards
    while high - low > 1:
        middle = (low + high) // 2
        rows = lambda a, b: min(b * size, n) - a * size
        left = np.random.Generator(np.random.Philox(key=[seed, low * shards + high])).binomial(draws, rows(low, middle) / rows(low, high))
        draws, low, high = (left, low, middle) if shard < middle else (draws - left, middle, high)
    return draws


def bootstrap_sums(placed: DataFrame, place: str, value: str, n: int, trials: int, seed: int, size: int = SHARD) -> DataFrame:
    """(trial, total): the sum of n values drawn with replacement, for every trial.

    placed has whole places from 0 to n - 1. A shard draws among its own rows only as often as the tree of shards says, and passes on one
    sum for each trial.
    """
    shards = -(-n // size)

    def draw(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by("p")
        shard, values = key[0].as_py(), table.column("v").to_numpy()
        times = shard_draws(shard, shards, n, size, trials, seed)
        rng = np.random.Generator(np.random.Philox(key=[seed + 1, shard]))
        totals = np.array([values[rng.integers(0, len(values), t)].sum() for t in times.tolist()])
        yield pa.RecordBatch.from_pydict({"trial": np.arange(trials), "total": totals})

    rows = placed.select(F.floor(F.col(place) / size).cast("int").alias("shard"), F.col(place).cast("long").alias("p"), F.col(value).cast("double").alias("v"))
    return rows.groupBy("shard").applyInArrow(draw, "trial long, total double").groupBy("trial").agg(F.sum("total").alias("total"))
