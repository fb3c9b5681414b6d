"""Ties of assignments, as their SQL orders them."""

from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelink.operators import assignment, history, joins


@pytest.mark.parametrize("n", [2, 3, 5, 6])
def test_sums_are_compared_after_rounding(n):
    rng = np.random.default_rng(n)
    for _ in range(60):
        m = rng.integers(0, 3, (n, n)) / 2 + rng.integers(0, 9, (n, n)) * 1e-10
        sums = {p: sum(m[i, p[i]] for i in range(n)) for p in permutations(range(n))}
        keys = {p: float(assignment.rounded_key(np.array(s), 9)) for p, s in sums.items()}
        assert tuple(assignment.hungarian(m)) == min(p for p in keys if keys[p] == max(keys.values()))
    near = np.array([[0.5, 0.5 + 4e-10], [0.5 + 4e-10, 0.5]])
    assert assignment.hungarian(near).tolist() == [1, 0]  # 1.0000000008 rounds up, 1 does not


def test_sums_as_they_are(spark):
    m = np.array([[0.5, 0.5], [0.5 + 1e-13, 0.5]])
    assert assignment.hungarian(m).tolist() == [0, 1] and assignment.hungarian(m, None).tolist() == [1, 0]
    rows = [("a", 0, i, t, float(m[i, t])) for i in range(2) for t in range(2)]
    scores = spark.createDataFrame(rows, "clip string, w long, imu_idx long, track long, score double")
    windows = spark.createDataFrame([("a", 0, 0, 2)], "clip string, w long, window_start long, window_end long")
    frames = spark.createDataFrame([("a", 0), ("a", 1)], "clip string, frame_idx long")
    people = frames.withColumn("gt_id", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("track", 1 - F.col("gt_id")).withColumn("visible", F.lit(True))
    clips = history.segment_decisions(scores, scores.limit(0), windows, frames, people, ["clip"], "w")
    assert [(r.correct, r.total) for r in clips.collect()] == [(4, 4)]
    seen = frames.withColumn("track", F.explode(F.expr("sequence(0L, 1L)")))
    tracked = history.tracked_session_decisions(scores, windows, seen, frames, people, ["clip"], "w")
    assert {r.rule: r.correct for r in tracked.collect()} == {"now": 4, "history": 4}


@pytest.mark.parametrize("others", [0, 4])
def test_boxes_apart_are_no_pair(spark, others):
    box = lambda x, y, w: {"x1": float(x), "y1": float(y), "x2": float(x + w), "y2": float(y + w)}
    kind = "bbox struct<x1:double,y1:double,x2:double,y2:double>"
    # tracks 0 and 1 are copies and overlap box 1 alone: track 0 takes it; more boxes far off make the group a large one
    gt = spark.createDataFrame([(1, 0, box(500, 500, 9)), (1, 1, box(0, 0, 10))] + [(1, 2 + k, box(2000 * (k + 1), 0, 5)) for k in range(others)], f"frame long, gt_idx long, {kind}")
    det = spark.createDataFrame([(1, 0, box(0, 0, 8)), (1, 1, box(0, 0, 8))], f"frame long, track_idx long, {kind}")
    assert [(r.gt_idx, r.track_idx) for r in joins.match_boxes_hungarian(gt, det, ["frame"]).collect()] == [(1, 0)]
