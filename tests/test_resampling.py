"""Draws, kernels, second-best assignments, neighbours by ranges and shuffle nulls against brute force."""

import hashlib
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinelink.operators import accuracy, batches, kernels, orientation, sampling, stats
from kinelink.operators.assignment import best_two


@pytest.mark.parametrize("n", [1, 2, 7, 300, 5000])
def test_a_permutation_hits_every_place_once(n):
    for key in (0, 1, 2**63 + 5):
        assert sorted(sampling.permuted(np.arange(n), np.full(n, key, np.uint64), n).tolist()) == list(range(n))


def test_draws_are_uniform():
    n, trials = 6, 30000
    keys = np.random.default_rng(0).integers(0, 2**63, trials).astype(np.uint64)
    first, second = (sampling.permuted(np.full(trials, j), keys, n) for j in (0, 1))
    assert (first != second).all()
    pairs = np.bincount(first * n + second, minlength=n * n).reshape(n, n)
    expected = trials / (n * (n - 1))
    chi = sum((pairs[a, b] - expected) ** 2 / expected for a in range(n) for b in range(n) if a != b)
    assert chi < 60  # 29 degrees of freedom: above 60 once in two thousand


def test_group_test_equals_its_own_draws(spark):
    rng = np.random.default_rng(4)
    units = [(f"u{i:03d}", rng.normal(size=(3, 4)).tolist(), rng.normal(size=(3, 4)).tolist()) for i in range(40)]
    df = spark.createDataFrame(units, "unit_id string, imu array<array<double>>, video array<array<double>>")
    out = {r["size"]: r for r in accuracy.group_test(df, [2, 5, 41], trials=30, seed=9).collect()}
    assert out.keys() == {2, 5}
    unit = lambda m: np.asarray(m) / np.linalg.norm(m, axis=1, keepdims=True)
    for size, r in out.items():
        keys = [x.h for x in spark.range(30).select(F.xxhash64(F.lit(9), F.lit(size), "id").alias("h")).collect()]
        hits = []
        for key in keys:
            drawn = sampling.permuted(np.arange(size), np.full(size, key, np.int64).view(np.uint64), 40)
            assert len(set(drawn.tolist())) == size
            scores = np.array([[(unit(units[a][1]) * unit(units[b][2])).sum(axis=1).mean() for b in drawn] for a in drawn])
            best = max(permutations(range(size)), key=lambda p: scores[np.arange(size), list(p)].sum())
            hits.append(np.mean([c == i for i, c in enumerate(best)]))
        assert r.trials == 30 and r.mean_acc == pytest.approx(np.mean(hits)) and r.std_acc == pytest.approx(np.std(hits))


def test_shares_of_shards_add_up_and_are_binomial():
    n, size, trials = 1000, 90, 4000
    shards = -(-n // size)
    shares = np.array([sampling.shard_draws(s, shards, n, size, trials, 3) for s in range(shards)])
    assert (shares.sum(axis=0) == n).all()
    rows = np.array([min(n, (s + 1) * size) - s * size for s in range(shards)])
    assert np.abs(shares.mean(axis=1) - rows).max() < 5 * np.sqrt(size / trials)
    assert np.abs(shares.var(axis=1) / (rows * (1 - rows / n)) - 1).max() < 0.12


def test_bootstrap_means_do_not_depend_on_shards(spark):
    rng = np.random.default_rng(1)
    values = rng.normal(5, 2, 3000)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "p long, v double").repartition(5)
    for size in (1 << 16, 256):
        totals = np.array([r.total for r in sampling.bootstrap_sums(df, "p", "v", 3000, 1500, 2, size).collect()]) / 3000
        assert len(totals) == 1500 and totals.mean() == pytest.approx(values.mean(), abs=0.01) and totals.std() == pytest.approx(values.std() / np.sqrt(3000), rel=0.1)
    found = stats.bootstrap_interval(df, ["p"], "v", 1000).first()
    assert found.n == 3000 and found.low < values.mean() < found.high and found.high - found.low == pytest.approx(2 * 1.96 * values.std() / np.sqrt(3000), rel=0.2)
    assert stats.bootstrap_interval(df.limit(0), ["p"], "v", 10).collect() == []


@pytest.mark.parametrize("group", [1000, 17])
def test_kernel_gap_equals_all_pairs(spark, group):
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(60, 3)), rng.normal(0.7, 1, size=(45, 3))
    both, side = np.concatenate([x, y]), np.repeat([0, 1], [60, 45])
    i, j = np.triu_indices(len(both), 1)
    d = ((both[i] - both[j]) ** 2).sum(axis=1)
    k = np.exp(-d / np.median(d))
    kind = side[i] + side[j]
    frame = lambda m: spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(m)] + [(999, None)], "id long, v array<double>")
    got = kernels.kernel_gap(frame(x), frame(y), "v", "id", group).first().mmd
    assert got == pytest.approx(k[kind == 0].mean() + k[kind == 2].mean() - 2 * k[kind == 1].mean(), abs=1e-10)
    assert kernels.kernel_gap(frame(x[:0]), frame(y[:0]), "v", "id", group).count() == 1


def test_covariances(spark):
    m = np.random.default_rng(3).normal(3, 2, size=(50, 5))
    df = spark.createDataFrame([(v.tolist(),) for v in m] + [(None,), ([1.0],)], "v array<double>").repartition(4)
    want = np.cov(m[:, :4].T)
    assert all(r.covariance == pytest.approx(want[r.i, r.j]) for r in stats.covariances(df, "v", 4).collect())


def test_second_best_by_one_solve():
    rng = np.random.default_rng(5)
    for n in range(2, 8):
        for _ in range(12):
            m = rng.integers(0, 9, (n, n)) / 4 if rng.random() < 0.5 else rng.normal(size=(n, n))
            sums = sorted((m[np.arange(n), list(p)].sum() for p in permutations(range(n))), reverse=True)
            assert best_two(m) == pytest.approx(tuple(sums[:2]))
    assert np.isnan(best_two(np.ones((2, 3)))[1]) and np.isnan(best_two(np.ones((1, 1)))[1])


@pytest.mark.parametrize("parts", [1, 2, 9, 40])
def test_neighbours_across_ranges(spark, parts):
    rng = np.random.default_rng(parts)
    rows = [(i, "hot" if i % 4 else f"a{i % 3}", float(rng.integers(0, 60)) / 2) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, act string, x double")
    for k in (1, 4):
        want = {(i, j, n + 1) for i, act, x in rows for n, (_, j) in enumerate(sorted((abs(y - x), j) for j, b, y in rows if j != i and b == act)[:k])}
        assert {tuple(r) for r in batches.hard_negatives(df, "id", "act", "x", k, parts=parts).collect()} == want


def test_time_shuffles_and_strata(spark):
    rng = np.random.default_rng(11)
    rows = [(s, t, *map(float, rng.normal(size=4)), bool(rng.random() < 0.8)) for s in (1, 2) for t in range(60)] + [(3, t, 1.0, 1.0, 0.0, 0.0, True) for t in range(9)] + [(1, 60, 1.0, float("nan"), 0.0, 0.0, True), (2, 60, None, 1.0, 0.0, 0.0, True)]
    df = spark.createDataFrame(rows, "s int, t long, rate double, gx double, gy double, gz double, ok boolean")
    shuffles = {r.s: r for r in orientation.time_shuffle_null(df, ["s"], "t", "rate", ["gx", "gy", "gz"], F.col("ok")).collect()}
    strata = {(r.s, r.stratum): r for r in orientation.motion_strata(df, ["s"], "rate", ["gx", "gy", "gz"], F.col("ok")).collect()}
    for s in (1, 2):
        own = sorted((r for r in rows if r[0] == s), key=lambda r: r[1])
        x, y = np.array([abs(r[2]) if r[2] is not None else np.nan for r in own]), np.array([np.sqrt(r[3] ** 2 + r[4] ** 2 + r[5] ** 2) for r in own])
        ok = np.array([r[6] for r in own]) & np.isfinite(x) & np.isfinite(y)
        null = []
        for trial in range(16):
            order = sorted(range(len(own)), key=lambda i: hashlib.md5(f"0:{trial}:{i}".encode()).hexdigest())
            both = ok & np.isfinite(y[order])
            null.append(abs(np.corrcoef(x[both], y[order][both])[0, 1]))
        assert shuffles[s].trials == 16 and shuffles[s].abs_r == pytest.approx(abs(np.corrcoef(x[ok], y[ok])[0, 1])) and shuffles[s].abs_r_null == pytest.approx(np.quantile(null, 0.95))
        for name, inside in (("low", y <= np.quantile(y[ok], 0.5)), ("high", y >= np.quantile(y[ok], 0.9))):
            at = ok & inside
            assert strata[s, name].frames == at.sum() and strata[s, name].corr == pytest.approx(np.corrcoef(x[at], y[at])[0, 1])
    assert shuffles[3].abs_r is None and shuffles[3].trials == 0 and strata[3, "low"].corr is None


@pytest.mark.parametrize("n", [41, 42])
def test_median_of_all_pairs_reads_them_in_five_passes(spark, monkeypatch, n):
    """Two middle places share their passes; the median is exact to the last digit, also with many equal distances and a far outlier."""
    rng, seen, over = np.random.default_rng(n), [], kernels._over_pairs
    monkeypatch.setattr(kernels, "_over_pairs", lambda *a: seen.append(1) or over(*a))
    x = np.concatenate([np.zeros((n // 2, 3)), rng.normal(size=(n - n // 2 - 1, 3)), [[1e4, 0, 0]]])
    rows = spark.createDataFrame([(i % 2, i, v.tolist()) for i, v in enumerate(x)], "s int, k long, v array<double>")
    got = kernels._median(kernels._cells(rows, n, 16))
    want = np.median([((a - b) ** 2).sum() for i, a in enumerate(x) for b in x[:i]])
    assert abs(got - want) <= 1e8 / 2**42 and len(seen) == 4


@pytest.mark.parametrize("kind", ["float", "double"])
def test_cells_send_no_copies_of_rows(spark, kind):
    """Rows are shuffled once, not once for each cell that they are part of, and each pair is met once: keys of a side that are equal are no pair."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=(101, 3)).astype(np.float32)
    keys = [(int(rng.integers(0, 2)), int(rng.integers(0, 30))) for _ in v]
    rows = spark.createDataFrame([(s, k, x.tolist()) for (s, k), x in zip(keys, v)], f"s int, k long, v array<{kind}>")

    def listed(tiles):
        kinds, values = [np.empty(0, int)], [np.empty(0)]
        for side, x in tiles:
            kinds.append(np.full(len(x), side))
            values.append(x.copy())
        return pa.RecordBatch.from_pydict({"kind": np.concatenate(kinds), "d": np.concatenate(values)})

    found = kernels._over_pairs(kernels._cells(rows, len(v), 4), listed, "kind long, d double")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    want = sorted((a[0] + b[0], float(((x - y) ** 2).sum())) for (a, x), (b, y) in combinations(zip(keys, v.astype(float)), 2) if a != b)
    got = sorted((r.kind, r.d) for r in found.collect())
    assert [k for k, _ in got] == [k for k, _ in want] and np.allclose([d for _, d in got], [d for _, d in want], atol=1e-12)
