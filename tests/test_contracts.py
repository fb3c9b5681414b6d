"""Behaviour contracts of single operators on hand-made tables."""

import io
import json
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinelink.functions import channels, layouts, pose, quaternions
from kinelink.operators import accuracy, assignment, features, grouped, history, joins, linking, orientation, quality, series, stats, variants, windows
from kinelink.sources import readers, sinks


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


# assignment


def test_assignment_methods(spark):
    m = [[3, 8, 2], [2, 7, 6], [0, 0, 3]]
    df = spark.createDataFrame([(1, i, j, float(m[i][j])) for i in range(3) for j in range(3)], "g int, row int, col int, score double")
    pick = lambda how: [r.col for r in assignment.assign(df, ["g"], method=how).orderBy("row").collect()]
    assert pick("hungarian") == [1, 2, 0] and pick("greedy") == [1, 0, 2]
    assert [r.col for r in assignment.assign_small(df, ["g"], 3).orderBy("row").collect()] == [1, 2, 0]


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.data())
def test_hungarian_is_best_and_first(r, c, data):
    from itertools import permutations

    m = np.array(data.draw(st.lists(st.integers(0, 4), min_size=r * c, max_size=r * c)), float).reshape(r, c)
    n = max(r, c)
    pad = np.zeros((n, n))
    pad[:r, :c] = m
    best = max(permutations(range(n)), key=lambda p: (sum(pad[i, p[i]] for i in range(n)), [-x for x in p[:r]]))
    assert assignment.hungarian(m).tolist() == [x if x < c else -1 for x in best[:r]]


def test_rectangles_and_bad_scores(spark):
    df = spark.createDataFrame([(1, 0, 5, 1.0), (1, 1, 5, 2.0)], "g int, row int, col int, score double")
    assert [(r.row, r.col) for r in assignment.assign(df, ["g"]).orderBy("row").collect()] == [(0, None), (1, 5)]
    bad = df.withColumn("score", F.lit(float("nan")))
    with pytest.raises(Exception, match="finite"):
        assignment.assign(bad, ["g"]).collect()
    with pytest.raises(Exception, match="cells"):
        assignment.assign(df.union(df), ["g"]).collect()


def test_frame_acc_policies(spark):
    schema = "grp string, idx int, imu_emb array<double>, video_emb array<double>"
    pair = spark.createDataFrame([("a", 0, [1.0, 0.0], [1.0, 0.0]), ("a", 1, [0.0, 1.0], [0.0, 1.0]), ("b", 0, [0.0, 0.0], [1.0, 0.0])], schema)
    r = accuracy.frame_acc(pair, "grp", "idx").first()
    assert (r.n_groups, r.n_evaluated, r.n_singletons, r.n_correct, r.n_total, r.frame_acc) == (2, 1, 1, 2, 2, 1.0)
    assert accuracy.frame_acc(pair, "grp", "idx", "count_as_correct").first().n_total == 3
    with pytest.raises(Exception, match="single item"):
        accuracy.frame_acc(pair, "grp", "idx", "error").collect()


def test_leftover_candidate_stays_alone(spark):
    df = spark.createDataFrame([("s", f"p{i}", 0) for i in range(3)], "split string, path string, window_start int")
    out = windows.assign_candidate_groups(df, 2, ["split", "window_start"], ["split", "path", "window_start"], ["path"])
    assert [(r.candidate_group_id, r.candidate_index) for r in out.orderBy("path").collect()] == [("cross:s:0:0", 0), ("cross:s:0:0", 1), (None, None)]


def test_session_rollup_of_clips(spark):
    clips = spark.createDataFrame([("s1", 5, 10), ("s1", 1, 1), ("s2", 2, 8)], "session string, correct long, total long")
    r = {x.session: x for x in accuracy.session_rollup(clips).collect()}
    assert r["s1"].frame_acc == pytest.approx(6 / 11) and r["s1"].mean_clip_acc == 0.75 and r["s2"].frame_acc == 0.25


# history


def _scores(spark, data):
    return spark.createDataFrame([("s", w, i, t, float(v)) for w, tracks in data.items() for t, vs in tracks.items() for i, v in enumerate(vs)], "session string, window_idx int, imu_idx int, track string, score double")


def test_history_accumulates_and_preserves(spark):
    df = _scores(spark, {0: {"a": [0.9, 0.1]}, 1: {"a": [0.2, 0.8], "b": [0.8, 0.2]}})
    last = {(r.track, r.imu_idx): r.accumulated for r in history.history_scores(df, ["session"], "window_idx").filter("window_idx = 1").collect()}
    assert last[("a", 0)] == pytest.approx(1.1) and last[("a", 1)] == pytest.approx(0.9) and last[("b", 0)] == pytest.approx(0.8)
    low = _scores(spark, {0: {"a": [0.9, 0.1]}, 1: {"a": [0.51, 0.49], "b": [0.52, 0.48]}})
    kept = {(r.track, r.imu_idx): (r.accumulated, r.status) for r in history.history_scores(low, ["session"], "window_idx", threshold=0.25).filter("window_idx = 1").collect()}
    assert kept[("a", 0)] == (pytest.approx(0.9), "preserved") and kept[("b", 0)] == (pytest.approx(0.52), "initialized")


def test_best_segment(spark):
    data = [(c, i, j, float(v)) for c, s in ((5, 10), (15, 8), (25, 1), (35, 1)) for i in range(2) for j in range(2) for v in [s if i == j else 0]]
    df = spark.createDataFrame([("x", *d) for d in data], "k string, centre int, row int, col int, score double")
    e = history.segment_evidence(df, ["k"], "centre", 20, 2)
    gaps = {r.segment: r.gap for r in e.select("segment", "gap").distinct().collect()}
    assert gaps == {0: 9.0, 1: 1.0}
    assert rows(history.offline_policy(df, ["k"], "centre", "global_best_segment", 20, 2).select("row", "col"), "row") == [(0, 0), (1, 1)]
    alone = history.segment_evidence(df, ["k"], "centre", 20, 5)
    assert {(r.segment, r.margin, r.consistency) for r in alone.collect()} == {(-1, 0.0, 1.0)}


# signals


def test_uneven_derivatives(spark):
    t = [0.0, 0.5, 1.5, 3.0]
    df = spark.createDataFrame([(1, x, x * x) for x in t], "k int, ts double, x double")
    out = series.derivatives(df, ["k"], "ts", ["x"]).orderBy("ts").collect()
    assert [r.x_velocity for r in out] == [0, 0.5, 2.0, 4.5] and [r.velocity_valid for r in out] == [False, True, True, True]


def test_turning_shoulders_have_rate_one(spark):
    points = [[(0.0, 0.0)] * 17 for _ in range(8)]
    data = []
    for i in range(8):
        p = [pt for pt in points[i]]
        p[11], p[14] = (0.0, 0.0), (math.cos(0.1 * i), math.sin(0.1 * i))
        data.append((1, 0.1 * i, [(x, y, 0.0) for x, y in p], [True] * 17))
    df = spark.createDataFrame(data, "k int, ts double, joints array<struct<x:double,y:double,z:double>>, v array<boolean>")
    out = orientation.torso_proxy_2d(df, ["k"], "ts", "joints", "v").collect()
    assert all(r.rate == pytest.approx(1.0) and r.valid for r in out)
    same = df.withColumn("joints", F.transform("joints", lambda p: pose.xyz(0.0, 0.0, 0.0)))
    assert {r.reason for r in orientation.torso_proxy_2d(same, ["k"], "ts", "joints", "v").collect()} == {"degenerate_shoulder_axis"}


def test_similarity_ignores_one_moving_joint():
    rng = np.random.default_rng(1)
    before = rng.normal(size=(17, 2))
    now = before + np.array([0.2, -0.1])
    now[9] += (100, -100)
    few = np.where(np.arange(17)[:, None] < 2, before, np.nan)
    found = {k: v.tolist() for k, v in grouped.similarities(np.stack([before, few]), np.stack([now, now])).items()}
    assert found["valid"] == [True, False] and found["dx"] == pytest.approx([0.2, 0]) and found["dy"] == pytest.approx([-0.1, 0])
    assert abs(found["log_scale"][0]) < 0.1 and abs(found["angle"][0]) < 0.1
    turn = np.array([[0.0, 2.0], [-2.0, 0.0]])
    found = grouped.similarities(before[None], (before @ turn)[None])
    assert found["log_scale"][0] == pytest.approx(math.log(2)) and found["angle"][0] == pytest.approx(math.pi / 2)


def brute_spectrum(x, t, size=16):
    """Dominant Hz, band energy, entropy, periodicity and profile of one channel, number by number."""
    n, x = len(x), np.array(x) - np.mean(x)
    dt = float(np.median(np.diff(t)))
    power = [abs(sum(x[i] * np.exp(-2j * np.pi * k * i / n) for i in range(n))) ** 2 for k in range(n // 2 + 1)]
    f = [k / (n * dt) for k in range(n // 2 + 1)]
    band = [k for k in range(len(f)) if f[k] <= 4.5]
    own = {k: power[k] if k else 0.0 for k in band}
    total = sum(own.values())
    auto = [sum(x[i] * x[i + lag] for i in range(n - lag)) for lag in range(n)]
    profile = np.interp(np.linspace(0, 4.5, size), [f[k] for k in band], [math.log1p(power[k]) for k in band])
    profile = profile - profile.mean()
    return f[max(own, key=own.get)], total / n, -sum(p / total * math.log(max(p / total, 1e-12)) for p in own.values()) / math.log(max(len(band), 2)), max(auto[1:]) / auto[0], profile / max(profile.std(), 1e-5)


def test_spectrum_of_two_hertz(spark):
    """A sine at 2 Hz beside noise, a gap and a short series, against sums over all frequencies."""
    rng, rows = np.random.default_rng(6), []
    series_ = {1: np.sin(4 * np.pi * np.arange(60) / 30), 2: rng.normal(size=60), 3: rng.normal(size=41), 4: np.array([1.0, 2.0, 1.0])}
    for k, x in series_.items():
        rows += [(k, i / 30, float(v)) for i, v in enumerate(x)]
    rows += [(2, 3.0, float("nan")), (2, 3.1, 5.0), (2, 3.2, None)]
    df = spark.createDataFrame(rows, "k int, t double, x double")
    got = {r.k: r for r in grouped.spectral_summary(df, ["k"], "t", ["x"]).collect()}
    profile = {r.k: r.profile for r in grouped.frequency_profile(df, ["k"], "t", ["x"], 16).collect()}
    assert got[1].valid and abs(got[1].dominant_hz - 2) < 0.25 and not got[4].valid and got[4].periodicity == 0 and profile[4] == [0.0] * 16
    for k in (1, 2, 3):
        hz, energy, entropy, periodicity, shape = brute_spectrum(series_[k], np.arange(len(series_[k])) / 30)
        assert (got[k].dominant_hz, got[k].band_energy, got[k].spectral_entropy, got[k].periodicity) == pytest.approx((hz, energy, entropy, periodicity))
        assert profile[k] == pytest.approx(shape, abs=1e-6)
    with pytest.raises(ValueError):
        grouped.spectral_summary(df, ["k"], "t", ["x"], band=(0, 20))


def test_motion_figures_leave_out_what_is_not_finite(spark):
    rng = np.random.default_rng(8)
    pose_ = rng.normal(size=(30, 17, 3))
    pose_[4, 13, 0] = np.nan
    rows = [(1, i, [tuple(map(float, p)) for p in frame]) for i, frame in enumerate(pose_)] + [(2, i, [(0.0, 0.0, 0.0)] * 17) for i in range(3)]
    df = spark.createDataFrame(rows, "k int, i int, joints array<struct<x:double,y:double,z:double>>")
    found = features.motion_complexity(df, ["k"], "i", "joints").collect()
    assert [r.k for r in found] == [1]
    own = pose_ - pose_[:, :1]
    bones = [np.linalg.norm(f[i] - f[p]) for f in pose_ for i, p in enumerate(layouts.H36M_PARENTS) if p >= 0]
    scale = np.median([b for b in bones if np.isfinite(b) and b > 1e-8])
    speed = np.linalg.norm(np.diff(own, axis=0), axis=2) / scale
    real = speed[np.isfinite(speed)]
    on = (speed > np.quantile(real, 0.75)) & np.isfinite(speed)
    r = found[0]
    assert (r.scale, r.motion_energy, r.max_speed) == pytest.approx((scale, real.mean(), real.max()))
    assert r.active_ratio == pytest.approx(on.sum() / len(real)) and r.simultaneous_ratio == pytest.approx(np.mean(2 * on.sum(axis=1) >= np.isfinite(speed).sum(axis=1)))
    assert r.jerk_energy == pytest.approx(np.nanmean(np.linalg.norm(np.diff(own, n=3, axis=0), axis=2)) / scale)


def test_guards_fill_every_long_gap():
    """Against a look at every stretch of 24 frames, from the left."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 120))
        ok, data = rng.random(n) < rng.choice([0.02, 0.2]), rng.random(n) < rng.choice([0.05, 0.9])
        got = variants.with_guards(ok, data)
        assert (got >= ok).all() and not (got & ~ok & ~data).any()
        assert all((got & data)[s : s + 24].any() or not data[s : s + 24].any() for s in range(n - 23))


def test_small_groups_without_python_equal_the_solver(spark):
    rng, rows = np.random.default_rng(5), []
    for g in range(60):
        n, m = (int(rng.integers(1, 6)) for _ in range(2))
        rows += [(g, r, c, float(rng.random())) for r in range(n) for c in range(m)]
    df = spark.createDataFrame(rows, "g int, row int, col int, score double")
    both = [{(r.g, r.row): r.col for r in f(df, ["g"]).collect()} for f in (assignment.assign, assignment.assign_by_size)]
    assert both[0] == both[1]


def test_numbers_in_order_over_ranges(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 10007 as v").repartition(5)
    assert [r.n for r in stats.numbered(df, ["v"], "n").orderBy("v").collect()] == list(range(1000))


def test_comparators_prefer_the_match():
    t = np.arange(120) / 30
    x, z = np.sin(4 * np.pi * t), np.random.default_rng(4).normal(size=120)
    assert grouped.coherence(x, np.sin(4 * np.pi * t + 0.7)) > grouped.coherence(x, z)
    y = np.stack([x + 0.01 * np.cos(t), np.random.default_rng(8).normal(size=120)], axis=-1)
    assert grouped.cca(x[:, None], y) > grouped.cca(x[:, None], np.random.default_rng(9).normal(size=(120, 2)))


def test_lowpass_keeps_slow_and_drops_fast():
    t = np.arange(120) / 30
    slow, fast = np.sin(2 * np.pi * t), np.sin(2 * np.pi * 10 * t)
    assert np.allclose(grouped.lowpass((slow + fast)[:, None], 4, 30)[:, 0], slow, atol=1e-6)
    with pytest.warns(RuntimeWarning):
        grouped.lowpass(slow[:, None], 50, 30)


def frames_of(spark, x):
    rows = [(1, i, [tuple(map(float, q)) for q in f]) for i, f in enumerate(x)]
    return spark.createDataFrame(rows, "k int, i int, joints array<struct<x:double,y:double,z:double>>").repartition(3)


def features_by_hand(x, mode):
    """Frame by frame, from the definition of the modes."""
    n, out, angles, p = len(x), [], [], []
    x = x * [1, 1, mode != "h36m2d"]
    scaled = [(f - f[0]) / max(math.dist(f[14], f[11]), 1e-4) for f in x]
    for i in range(n):
        p.append(sum(scaled[min(max(j, 0), n - 1)] for j in range(i - 4, i + 5)) / 9)
    unit = lambda v: v / max(np.linalg.norm(v), 1e-8)
    torso = [(f[14] - f[11], f[8] - f[0]) for f in p]
    fronts = [np.cross(a, b) for a, b in torso]
    seen = [math.hypot(f[0], f[2]) > 1e-5 for f in fronts]
    for f, ok in zip(fronts, seen):
        angle = math.atan2(f[2], f[0]) if ok else 0.0
        while angles and angle - angles[-1] > math.pi:
            angle -= 2 * math.pi
        while angles and angle - angles[-1] < -math.pi:
            angle += 2 * math.pi
        angles.append(angle)

    def written(i):
        if mode == "h36m3d_zonly":
            return p[i] * [0, 0, 1]
        if mode == "h36m3d_bone":
            return np.array([p[i][j] - p[i][parent] if parent >= 0 else p[i][j] * 0 for j, parent in enumerate(layouts.H36M_PARENTS)])
        if mode == "h36m3d_rotinv" and seen[i]:
            s, c = math.sin(angles[i]), math.cos(angles[i])
            return p[i] @ np.array([[c, 0, -s], [0, 1, 0], [s, 0, c]])
        return p[i]

    def forearm(i, elbow, wrist):
        d = unit(p[i][wrist] - p[i][elbow])
        a, b = map(unit, torso[i])
        return np.array([d @ a, d @ b, d @ unit(np.cross(a, b))]) if mode.endswith("_rot") else d

    for i in range(n):
        moved = (written(i) - written(max(i - 1, 0))) * (mode != "h36m3d_no_velocity")
        row = [*written(i).ravel(), *moved.ravel()]
        if mode == "h36m3d_heading":
            row += [math.sin(angles[i]) * seen[i], math.cos(angles[i]) * seen[i]]
        if "heading" in mode:
            row += [angles[i] - angles[max(i - 1, 0)], float(seen[i])]
        if mode == "h36m3d_geom":
            row += [np.linalg.norm(p[i][j] - p[i][parent]) if parent >= 0 else 0.0 for j, parent in enumerate(layouts.H36M_PARENTS)]
        for side, ends in (("left", (12, 13)), ("right", (15, 16))):
            if side in mode or "both" in mode:
                row += [*forearm(i, *ends), *np.cross(forearm(max(i - 1, 0), *ends), forearm(i, *ends))]
        out.append(row)
    return np.array(out)


@pytest.mark.parametrize("mode", features.H36M_MODES)
def test_h36m_modes(spark, mode):
    x = np.random.default_rng(2).normal(size=(20, 17, 3)).cumsum(axis=0)
    out = np.array([r.features for r in features.h36m_features(frames_of(spark, x), ["k"], "i", "joints", mode).orderBy("i").collect()])
    assert out.shape == (20, features.h36m_width(mode))
    if mode == "h36m3d_zonly":
        assert np.allclose(out[:, :51].reshape(20, 17, 3)[..., :2], 0)
    assert np.allclose(out, features_by_hand(x, mode), atol=1e-9)


def test_raw_pose(spark):
    x = np.random.default_rng(3).normal(500, 100, size=(15, 17, 3))
    out = np.array([r.features for r in features.skeleton_features(frames_of(spark, x), ["k"], "i", "joints", "raw72").orderBy("i").collect()])
    p = [sum(x[min(max(j, 0), 14), :, :2] / [1920, 1080] for j in range(i - 4, i + 5)) / 9 for i in range(15)]
    for i, row in enumerate(out):
        own, before = p[i] - p[i][5], p[max(i - 1, 0)] - p[max(i - 1, 0)][5]
        assert np.allclose(row, [*own.ravel(), *(own - before).ravel(), *p[i][5], *((p[i][11] + p[i][12]) / 2 - p[i][5])])
    with pytest.raises(ValueError):
        features.h36m_width("other")


def test_arm_tokens(spark):
    """One token by hand, unit lengths, and joints that all stand in one place."""
    rng = np.random.default_rng(4)
    pose_ = rng.normal(500, 200, size=(12, 17, 2))
    rows = [(1, i, [(float(x), float(y), 0.0) for x, y in f]) for i, f in enumerate(pose_)] + [(2, i, [(0.0, 0.0, 0.0)] * 17) for i in range(12)]
    df = spark.createDataFrame(rows, "k int, i int, joints array<struct<x:double,y:double,z:double>>")
    out = {(r.k, r.i): np.array(r.features).reshape(4, 12) for r in features.skeleton_features(df, ["k"], "i", "joints", "tokens").collect()}
    still = np.stack([out[2, i] for i in range(12)])
    assert np.isfinite(still).all() and abs(still[:, 2, 4]).max() <= math.log(1e3)
    p = np.stack([np.concatenate([pose_[:1].repeat(4, 0), pose_, pose_[-1:].repeat(4, 0)])[i : i + 9].mean(axis=0) for i in range(12)]) / np.array(features.SCREEN)
    for i in range(12):
        across = p[i, 6] - p[i, 5]
        width = np.linalg.norm(across)
        e1, arm = across / width, (p[i, 7] - p[i, 5]) / max(width, 0.05)
        local = np.array([arm @ e1, e1[0] * arm[1] - e1[1] * arm[0]])
        assert out[1, i][0, :3] == pytest.approx([*(local / np.linalg.norm(local)), np.linalg.norm(local)]) and out[1, i][3, :2] == pytest.approx(p[i, 5])
        assert out[1, i][:, 7][[0, 1, 3]].tolist() == [1, 1, 1] and out[1, i][2, 11] == 1



def test_quaternions(spark):
    q = [0.5, 0.5, 0.5, 0.5]
    df = spark.createDataFrame([(q, [0.0, 0.0, math.pi / 2])], "q array<double>, v array<double>")
    r = df.select(quaternions.from_matrix(quaternions.to_matrix("q")).alias("b"), quaternions.axis_angle_to_matrix("v").alias("m"), quaternions.multiply("q", F.array(*map(F.lit, (1.0, 0.0, 0.0, 0.0)))).alias("same")).first()
    assert r.b == pytest.approx(q) and r.m == pytest.approx([0, -1, 0, 1, 0, 0, 0, 0, 1], abs=1e-9) and r.same == pytest.approx(q)


def test_channel_views(spark):
    names = ["acc_x", "acc_y", "acc_z", "gyro_x", "gyro_y", "gyro_z", *layouts.QUAT]
    df = spark.createDataFrame([([float(i) for i in range(10)],)], "v array<double>")
    assert df.select(channels.select_view("v", names, ["gyro_z", "acc_x", "quat_w"]).alias("x")).first().x == [5.0, 0.0, 6.0]
    with pytest.raises(ValueError, match="missing"):
        channels.select_view("v", names[:3], "gyro")
    wide = [0.0] * 48
    wide[0:9] = wide[9:18] = wide[18:27] = wide[27:36] = [1, 0, 0, 0, 1, 0, 0, 0, 1]
    wide[42:45] = [1, 2, 3]
    big = spark.createDataFrame([([float(x) for x in wide],)], "v array<double>")
    assert big.select(channels.unpack_48d("v", "L_LowLeg").alias("x")).first().x == [1, 2, 3, 1, 0, 0, 0]


def test_joint_layouts(spark):
    df = spark.createDataFrame([([(float(i), 2.0 * i, 1.0) for i in range(25)],)], "j array<struct<x:double,y:double,z:double>>")
    r = df.select(pose.coco17_to_h36m17("j").alias("c"), pose.smplx25_to_h36m17("j").alias("s"), pose.capture21_to_h36m17("j", [f"x{i}" for i in range(8)] + list(layouts.CAPTURE21)).alias("t")).first()
    at = layouts.H36M17.index
    assert r.c[at("pelvis")].x == 11.5 and r.c[at("neck")].x == 0 and r.c[at("head")].x == pytest.approx(-0.5 * 5.5 / 2) and r.c[at("head")].z == 0
    assert r.s[at("thorax")].x == 8.5 and r.s[at("neck")].x == 24 and r.s[at("head")].x == 24 + 0.5 * 17 and r.s[at("left_wrist")].x == 12
    assert [p.x for p in r.t] == list(range(8, 25))
    with pytest.raises(ValueError):
        pose.capture21_to_h36m17("j", ["Hips"])


def test_augmented_windows(spark):
    df = spark.createDataFrame([(w, t, [1.0] * 6, [(1.0, 1.0, 1.0)] * 17) for w in range(4) for t in range(5)], "w int, t int, imu array<double>, joints array<struct<x:double,y:double,z:double>>")
    same = features.augment_window(df, ["w"], "t", "imu", "joints", 1)
    assert all(r.imu == [1.0] * 6 and r.joints[3].x == 1 for r in same.collect())
    out = features.augment_window(df, ["w"], "t", "imu", "joints", 1, 0.1, 0.5, 0.1, 0.5).collect()
    masks = {(r.w, tuple(v == 0 for v in r.imu), tuple(j.x == 0 for j in r.joints)) for r in out}
    assert len(masks) == 4 and any(any(m) for _, m, _ in masks) and len({r.imu[0] for r in out}) > 2


# variants


@pytest.fixture(scope="module")
def recording(spark):
    joints = [(float(i), 0.5 * i, 1.0) for i in range(17)]
    sk = spark.createDataFrame([("a", p, t, joints, True, p) for p in range(2) for t in range(60)], "sequence_id string, person_idx int, frame_idx long, joints array<struct<x:double,y:double,z:double>>, visible boolean, track_idx int")
    imu = spark.createDataFrame([("a", p, t, math.sin(t), 0.0, 9.8, *((-1.0) ** t * x for x in (2.0, 0.0, 0.0, 0.0))) for p in range(2) for t in range(60)], f"sequence_id string, person_idx int, frame_idx long, {', '.join(f'{c} double' for c in layouts.CANONICAL7)}")
    return imu, sk


def test_sensor_variants(recording):
    imu, _ = recording
    spec = variants.Spec(acc_noise_std=0.5, acc_spike_ratio=0.05, mount_euler_xyz_deg=(10, 20, 30), global_yaw_deg=40)
    noisy = variants.acc_noise(imu, spec)
    assert rows(noisy.select("quat_w"), "quat_w") == rows(imu.select("quat_w"), "quat_w") and rows(noisy, "person_idx", "frame_idx") == rows(variants.acc_noise(imu.repartition(7), spec), "person_idx", "frame_idx")
    both = variants.acc_spikes(imu, spec).alias("n").join(imu.alias("o"), ["person_idx", "frame_idx"])
    changed = both.select(sum((F.abs(F.col(f"n.{c}") - F.col(f"o.{c}")) > 1e-9).cast("int") for c in layouts.ACC).alias("c")).agg(F.sum("c")).first()[0]
    assert changed == round(60 * 2 * 3 * 0.05)
    held = variants.acc_dropout_hold(imu, spec).orderBy("person_idx", "frame_idx").collect()
    assert sum(not r.imu_valid for r in held) == 6 and held[0].imu_valid
    fixed = variants.quat_repair(imu, spec).collect()
    assert all(r.quat_w == pytest.approx(fixed[0].quat_w) and abs(r.quat_w) == pytest.approx(1) for r in fixed if r.person_idx == fixed[0].person_idx)
    turned = variants.mount_rotation(imu, spec).alias("n").join(imu.alias("o"), ["person_idx", "frame_idx"])
    size = lambda t: F.sqrt(sum((F.col(f"{t}.{c}") ** 2 for c in layouts.ACC), F.lit(0.0)))
    assert turned.filter(F.abs(size("n") - size("o")) > 1e-6).isEmpty()


def test_skeleton_variants(recording):
    _, sk = recording
    spec = variants.Spec(joint_dropout_rate=0.1, fragmentation_rate=0.1)
    scaled = variants.bone_scale(sk, spec).select("person_idx", F.get("joints", F.lit(0)).alias("r"), pose.bone_lengths("joints").alias("l")).collect()
    assert all(tuple(r.r) == (0.0, 0.0, 1.0) for r in scaled) and len({(r.person_idx, tuple(round(x, 9) for x in r.l)) for r in scaled}) == 2
    noisy = variants.coord_noise(sk, spec).select(F.get("joints", F.lit(0)).alias("r"), F.get("joints", F.lit(3)).alias("j")).collect()
    assert all(tuple(r.r) == (0.0, 0.0, 1.0) for r in noisy) and len({r.j.x for r in noisy}) > 100
    dropped = variants.joint_dropout(sk, spec).collect()
    assert any(not all(r.joint_visible) for r in dropped) and all(r.joint_visible[i] for r in dropped for i in layouts.PROTECTED)
    moved = variants.temporal_jitter(sk, spec).collect()
    assert len(moved) == 120 and all(0 <= r.source_frame < 60 for r in moved) and any(r.source_frame != r.frame_idx for r in moved)
    broken = variants.track_fragmentation(sk, spec).orderBy("person_idx", "frame_idx").collect()
    flags = [r.track_valid for r in broken[:60]]
    assert not all(flags) and all(any(flags[i : i + 24]) for i in range(37)) and all(r.track_idx is None for r in broken if not r.track_valid)
    assert variants.apply_variant(sk, sk, ["identity"])[1] is sk
    with pytest.raises(KeyError):
        variants.apply_variant(sk, sk, ["nonsense"])
    with pytest.raises(ValueError):
        variants.Spec(bone_scale_min=2.0)


# joins and linking


def test_boxes(spark):
    box = "struct<x1:double,y1:double,x2:double,y2:double>"
    gt = spark.createDataFrame([(0, 0, (0.0, 0.0, 20.0, 40.0), True), (0, 1, (100.0, 0.0, 120.0, 40.0), True)], f"frame int, gt_idx long, bbox {box}, visible boolean")
    det = spark.createDataFrame([(0, 0, (0.0, 0.0, 20.0, 40.0)), (0, 1, (101.0, 0.0, 121.0, 40.0)), (1, 2, (0.0, 0.0, 1.0, 1.0))], f"frame int, track_idx long, bbox {box}")
    for match in (joins.match_boxes_argmax, joins.match_boxes_hungarian, joins.match_boxes_exclusive):
        assert [(r.gt_idx, r.track_idx) for r in match(gt, det, ["frame"]).orderBy("gt_idx").collect()] == [(0, 0), (1, 1)]


def test_interpolation_edges(spark):
    s = spark.createDataFrame([(1, 0.0, 0.0), (1, 2.0, 4.0)], "k int, ts double, x double")
    t = spark.createDataFrame([(1, -1.0), (1, 0.0), (1, 0.5), (1, 2.0), (1, 3.0)], "k int, ts double")
    got = lambda edge: [r.x for r in joins.interpolate_join(s, t, ["k"], "ts", ["x"], edge).orderBy("ts").collect()]
    assert got("null") == [None, 0.0, 1.0, 4.0, None] and got("zero") == [0.0, 0.0, 1.0, 4.0, 0.0] and got("clamp") == [0.0, 0.0, 1.0, 4.0, 4.0]


def test_linking_to_a_known_number(spark):
    st_ = spark.createDataFrame([("v", i) for i in (1, 2, 3, 4)], "video string, track_id long")
    links = spark.createDataFrame([("v", 1, 2, 0.1), ("v", 3, 4, 0.2), ("v", 2, 3, 0.3)], "video string, src long, dst long, score double")
    assert [r.new_id for r in linking.link_tracklets(st_, links, ["video"]).orderBy("track_id").collect()] == [0, 0, 0, 0]
    assert [r.new_id for r in linking.link_tracklets(st_, links, ["video"], 2).orderBy("track_id").collect()] == [0, 0, 1, 1]
    assert [r.new_id for r in linking.link_tracklets(st_, links, ["video"], 3).orderBy("track_id").collect()] == [0, 0, 1, 2]


# quality


def test_sequence_rules(spark):
    seq = spark.createDataFrame([("ok", "d", 2, ["a", "b"]), ("bad", "x", 3, ["a", "a"]), ("none", "d", 1, ["a"])], "sequence_id string, dataset string, n_frames long, imu_channels array<string>")
    fr = spark.createDataFrame([("ok", "imu", 0, [1.0, 2.0]), ("ok", "imu", 1, [1.0, 2.0]), ("ok", "gt", 0, [0.0]), ("ok", "gt", 1, [0.0]), ("ok", "extract", 0, [1.0]), ("ok", "extract", 1, [1.0]), ("bad", "imu", 0, [0.0, 0.0]), ("bad", "imu", 1, [0.0, 0.0]), ("bad", "gt", 0, [float("nan")])], "sequence_id string, source string, frame_id long, values array<double>")
    found = {(r.rule, r.key) for r in quality.validate_sequences(seq, fr, ["d"]).collect()}
    assert ("ok" not in {k for _, k in found}) and {("dataset", "bad"), ("channel_names", "bad"), ("zero_imu", "bad"), ("not_finite", "bad"), ("length", "bad"), ("no_frames", "none")} <= found
    with pytest.raises(ValueError):
        quality.assert_clean(quality.validate_sequences(seq, fr, ["d"]))


def _records(spark, **change):
    cells = stats.expected_cells(spark, ["s1", "s2"], [1, 2, 3], {f"fold{i}": f"ses{i}" for i in range(4)})
    expected = cells.filter("phase = 'evaluate'").withColumn("dataset", F.lit("custom")).withColumn("train_job_id", F.lit("t"))
    h = "a" * 64
    made = {"status": F.lit("completed"), "protocol_hash": F.lit("p"), "resolved_config": F.lit("{}"), "config_hash": F.sha2(F.lit("{}").cast("binary"), 256), "data_manifest_hash": F.lit("m"), "checkpoint": F.lit("c"), "checkpoint_sha256": F.lit(h), "raw_results": F.lit("r"), "raw_results_sha256": F.lit(h), "git_commit": F.lit("g"), "git_dirty": F.lit(False), "frame_acc": F.struct(F.lit(5).alias("correct"), F.lit(10).alias("total"), F.lit(0.5).alias("value")), "candidate_groups": F.struct(F.lit(0.0).alias("singleton_rate"), F.lit(2).alias("candidate_group_size_min"))}
    expected = spark.createDataFrame(expected.collect(), expected.schema)
    return expected.withColumns(made | change), expected.select("job_id", "condition", "dataset", "source", "seed", "test_session", "train_job_id")


def test_run_records(spark):
    good, expected = _records(spark)
    assert expected.count() == 66 and stats.expected_cells(spark, ["s1", "s2"], [1, 2, 3], {f"fold{i}": f"ses{i}" for i in range(4)}).filter("phase = 'train'").count() == 42
    assert quality.validate_run_records(good, expected).isEmpty()
    rule = lambda **c: {r.rule for r in quality.validate_run_records(_records(spark, **c)[0], expected).collect()}
    assert rule(status=F.lit("failed")) == {"not_completed"}
    assert rule(protocol_hash=F.when(F.col("seed") == 1, "x").otherwise("y")) == {"mixed_protocol"}
    assert rule(frame_acc=F.struct(F.lit(5).alias("correct"), F.lit(10).alias("total"), F.lit(0.6).alias("value"))) == {"value"}
    less = good.filter("seed > 1")
    assert {r.rule for r in quality.validate_run_records(less, expected).collect()} == {"missing"}
    assert {r.rule for r in quality.validate_run_records(good.union(good.limit(1)), expected).collect()} == {"duplicate"}


def test_mapping_and_gates(spark):
    seq = spark.createDataFrame([("a", [1, 2], [2, 1]), ("b", [1], [3])], "sequence_id string, imu_ids array<int>, person_ids array<int>")
    win = spark.createDataFrame([("a", "f1", 0, 0), ("a", "f2", 0, 1), ("b", "f3", None, 0)], "sequence_id string, npz_path string, person_idx int, imu_idx int")
    files = spark.createDataFrame([("f1",), ("f2",)], "npz_path string")
    got = {r.sequence_id: r for r in quality.audit_person_imu_mapping(win, seq, files).collect()}
    assert got["a"].same_ids and got["a"].mismatched == 1 and not got["b"].same_ids and got["b"].blank == 1 and got["b"].missing_refs == 1
    audits = spark.createDataFrame([("x", True, 1.0, True), ("y", True, 1.0, False), ("z", False, 1.0, True)], "source string, present boolean, finite_share double, mapped boolean")
    assert [r.status for r in quality.gate_sources(audits).orderBy("source").collect()] == ["included", "conditional", "pending"]


# sources and sinks


def test_sensor_text(spark, tmp_path):
    f = tmp_path / "a.sensors"
    f.write_text("2 3\n1\nA 1 0 0 0 1 2 3\nB 1 0 0 0 4 5 6\n\n2\nA 1 0 0 0 7 8 9\nC 1 0 0 0 1 1 1\n3\nA 0 1 0 0 1 1 1\nB 0 1 0 0 2 2 2\n4\nA 1 0 0 0 0 0 0\n")
    got = readers.read_xsens_sensors(spark, str(f), ["A", "B"]).orderBy("frame_idx", "sensor").collect()
    assert [(r.frame_idx, r.sensor, r.acc) for r in got] == [(0, "A", [1, 2, 3]), (0, "B", [4, 5, 6]), (1, "A", [1, 1, 1]), (1, "B", [2, 2, 2])]
    aux = tmp_path / "b.sensors"
    row = lambda n, v: " ".join([n, *map(str, range(1, 5)), *[str(v + i) for i in range(6)], "0", "0", "0"])
    aux.write_text("\n".join(["2 2", "1", row("A", 10), row("B", 20), "2", row("A", 30), row("B", 40)]))
    got = readers.read_xsens_aux(spark, str(aux), "B").orderBy("frame_idx").collect()
    assert [(r.acc, r.gyro) for r in got] == [([20, 21, 22], [23, 24, 25]), ([40, 41, 42], [43, 44, 45])] and got[1].ts_s == pytest.approx(1 / 60)
    with pytest.raises(Exception, match="lacks"):
        readers.read_xsens_aux(spark, str(aux), "Z").collect()


def test_vicon_text(spark, tmp_path):
    f = tmp_path / "v.txt"
    f.write_text("Hips\tHead\t\n1 2 3\t4 5 6\t\nbad\n7 8\t1 1 1\n0 0 1\t1 1 1\t\n")
    got = readers.read_vicon_positions(spark, str(f)).orderBy("frame_idx", "joint").collect()
    assert [(r.frame_idx, r.name, r.x, r.z) for r in got] == [(0, "Hips", 1, 3), (0, "Head", 4, 6), (1, "Hips", 0, 1), (1, "Head", 1, 1)]


def test_device_csv(spark, tmp_path):
    head = "epoch_ms,四元数0(),四元数1(),四元数2(),四元数3(),加速度X(g),加速度Y(g),加速度Z(g),角速度X(°/s),角速度Y(°/s),角速度Z(°/s)"
    (tmp_path / "a.csv").write_text("﻿" + head + "\n1000,1,0,0,0,1,0,0,180,0,0\n1050,1,0,0,0,1,0,0,0,0,0\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text(head + "\n1050,1,0,0,0,9,0,0,0,0,0\n1025,1,0,0,0,2,0,0,0,0,0\n", encoding="utf-8")
    one = readers.read_imu_csv(spark, str(tmp_path / "a.csv"), True).orderBy("ts_ms").first()
    assert one.acc_x == pytest.approx(9.80665) and one.gyro_x == pytest.approx(math.pi)
    both = readers.read_imu_csv_series(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).orderBy("ts_s").collect()
    assert [r.ts_s for r in both] == [0.0, 0.025, 0.05] and both[2].acc_x == pytest.approx(9.80665)


def test_pose_policies(spark, tmp_path):
    k = [1.0] * 51
    data = [{"image_id": "0.jpg", "idx": [1, 2], "box": [0, 0, 20, 40], "keypoints": k, "score": 0.5}, {"image_id": "0.jpg", "idx": 3, "box": [100, 0, 20, 40], "keypoints": k, "score": 0.9}, {"image_id": "1.jpg", "idx": 4, "box": [0, 0, 1, 1], "keypoints": k, "score": 0.1}, {"image_id": "x.jpg", "idx": 4, "box": [0, 0, 5, 5], "keypoints": k[:3], "score": 0.1}]
    f = tmp_path / "p.json"
    f.write_text(json.dumps(data))
    got = lambda policy, *c: sorted(tuple(r) for r in readers.read_pose_tracks(spark, str(f), policy).select(*c).collect())
    assert got("expand", "frame_id", "track_id") == [(0, 1), (0, 2), (0, 3), (1, 4)]
    assert got("atomic", "frame_id", "track_label", "first_ord") == [(0, "3", 1), (0, "[1,2]", 0), (1, "4", 2)]
    assert got("first", "frame_id", "track_id", "w") == [(0, 1, 20.0), (0, 3, 80.0), (1, 4, 1.0), (3, 4, 5.0)]
    assert got("sized", "frame_id", "track_id") == [(0, 1), (0, 3)]


def test_small_readers(spark, tmp_path):
    (tmp_path / "t.txt").write_text("5,1,0,0,10,20,0.9\n\n6,2,1,1,10,20,0.8\n7,1\n")
    assert [(r.frame_idx, r.track_id, r.bbox.x2) for r in readers.read_mot_tracks(spark, str(tmp_path / "t.txt")).orderBy("frame_idx").collect()] == [(0, 1, 10.0), (1, 2, 11.0)]
    for n in ("s1_frame_timestamps.csv", "s1_frame_timestamps_retimed.csv", "s2_frame_timestamps.csv"):
        (tmp_path / n).write_text(f"frame_index,timestamp_ms\n1,{100 if 'retimed' in n else 5}\n")
    times = readers.read_frame_timestamps(spark, [str(tmp_path / "*_frame_timestamps*.csv")])
    assert rows(times, "session") == [("s1", 0, 100.0), ("s2", 0, 5.0)]
    with pytest.raises(Exception, match="no time"):
        readers.frame_times(spark.createDataFrame([("s1", 9)], "session string, frame_id long"), times).collect()
    (tmp_path / "boxes.csv").write_text("timestamp_ms,p1_bbox_x,p1_bbox_y,p1_bbox_w,p1_bbox_h,p1_is_absent,p2_bbox_x,p2_bbox_y,p2_bbox_w,p2_bbox_h,p2_is_absent\n10,1,2,3,4,0,0,0,0,0,True\n")
    assert [(r.person_idx, r.bbox.x2, r.visible) for r in readers.read_box_annotations(spark, str(tmp_path / "boxes.csv")).orderBy("person_idx").collect()] == [(0, 4.0, True), (1, 0.0, False)]
    (tmp_path / "w.csv").write_text("split,npz_path,window_start,window_end,candidate_group_id\ntrain,a.npz,0,24,\n")
    w = readers.read_windows(spark, str(tmp_path / "w.csv")).first()
    assert (w.split, w.window_end, w.candidate_group_id, w.imu_idx) == ("train", 24, None, None)


def test_archives(spark, tmp_path):
    f = tmp_path / "seq.npz"
    np.savez(f, imu=np.arange(12, dtype=np.float32).reshape(3, 2, 2), frame_ids=np.array([4, 5, 7]), sequence_id=np.array("s", dtype=object), imu_channels=np.array(["a", "b"], dtype=object))
    got = readers.import_array_archive(spark, str(f)).orderBy("frame_idx", "person_idx").collect()
    assert [(r.frame_id, r.person_idx, r.values) for r in got][-1] == (7, 1, [10.0, 11.0]) and len(got) == 6
    meta = {r.key: json.loads(r.value) for r in readers.import_archive_metadata(spark, str(f)).collect()}
    assert meta["sequence_id"] == "s" and meta["imu_channels"] == ["a", "b"]
    evil = io.BytesIO()
    np.save(evil, np.array([print], dtype=object))
    with pytest.raises(Exception, match="not opened"):
        readers.open_array(evil.getvalue())
    for n, t in (("ses_aria01", 4), ("ses_aria02", 3)):
        np.savez(tmp_path / f"{n}.npz", sensor_names=np.array(["L", "R"]), acc=np.ones((t, 2, 3)), quat=np.ones((t, 2, 4)), pose2d=np.ones((t, 17, 2)), pose2d_mask=np.ones((t, 17)))
    cache = readers.read_person_cache(spark, str(tmp_path / "ses_*.npz"), "R")
    assert sorted((r.person_id, r.n) for r in cache.groupBy("person_id").agg(F.count("*").alias("n")).collect()) == [(1, 3), (2, 3)]


def test_inventory_and_records(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"f{i}.bin").write_bytes(b"x" * (i + 1))
    inv = readers.inventory_files(spark, {"a": str(tmp_path), "b": str(tmp_path / "nowhere")})
    assert sorted((r.source, r.status) for r in inv.collect()) == [("a", "present")] * 5 + [("b", "missing")]
    assert sorted(r.path[-6:] for r in readers.inventory_files(spark, {"a": str(tmp_path)}, "ends").collect()) == ["f0.bin", "f2.bin", "f4.bin"]
    d = tmp_path / "runs" / "x"
    d.mkdir(parents=True)
    (d / "r.json").write_text(json.dumps({"job_id": "j", "status": "completed", "frame_acc": {"total": 3}}))
    schema = "job_id string, status string, frame_acc struct<total:long>"
    assert readers.read_run_records(spark, str(tmp_path / "runs"), schema, True).first().job_id == "j"


def test_split_series_and_domains(spark):
    parts = spark.createDataFrame([("k", s, i, [float(v)]) for s, v in (("train", 1), ("val", 2), ("test", 3)) for i in range(2)], "k string, split string, frame_idx long, values array<double>")
    got = lambda **a: [r.values[0] for r in readers.concat_split_series(parts, ["k"], **a).orderBy("frame_idx").collect()]
    assert got() == [1, 1, 2, 2, 3, 3] and got(target=7) == [1, 1, 2, 2, 3, 3, 0] and got(target=4) == [1, 1, 2, 2] and got(target=3, mode="test") == [0, 3, 3]
    w = spark.createDataFrame([("s1",), ("s2",)], "session string")
    union, audit = readers.union_domains([("a", 30.0, ["s1"], w), ("b", 60.0, None, w)])
    assert union.count() == 3 and {(r.dataset, r.kept, r.skipped) for r in audit.collect()} == {("a", 1, 1), ("b", 2, 0)}


def test_sidecar(spark):
    fr = spark.createDataFrame([("a.npz", "seqa", 0, 0), ("b.npz", "seqb", 0, 0)], "file string, sequence_id string, imu_idx int, frame_idx int")
    side = spark.createDataFrame([("a.npz", 0, 0, [1.0], [2.0]), ("seqb", 0, 0, [3.0], [4.0])], "name string, imu_idx int, frame_idx int, acc array<double>, gyro array<double>")
    assert [r.acc for r in readers.attach_gyro_sidecar(fr, side).orderBy("file").collect()] == [[1.0], [3.0]]
    with pytest.raises(Exception, match="no sidecar"):
        readers.attach_gyro_sidecar(fr, side.limit(1)).collect()
    assert readers.attach_gyro_sidecar(fr, side.limit(1), True).count() == 1


def test_sinks(spark, tmp_path):
    win = spark.createDataFrame([("train", "s", "g"), ("test", "s", " "), ("test", "t", None)], "split string, source_sequence string, candidate_group_id string")
    sinks.write_windows(win, str(tmp_path), csv=True)
    assert spark.read.parquet(str(tmp_path / "windows")).filter("split = 'test'").count() == 2
    s = sinks.window_summary(win).first()
    assert (s.windows, s.candidate_groups, s.singleton_rows, s.per_split) == (3, 1, 2, {"test": 2, "train": 1})
    fr = spark.createDataFrame([("d", "raw", "s", 0, 1.0)], "dataset string, variant string, sequence_id string, frame_idx long, x double")
    sinks.write_frames(fr, str(tmp_path / "silver"), fr.select("sequence_id"))
    assert spark.read.parquet(str(tmp_path / "silver/frames")).filter("variant = 'raw'").count() == 1
    paths = spark.createDataFrame([(0, " a "), (1, ""), (2, "b"), (3, "a")], "ord int, video_path string")
    assert rows(sinks.video_manifest(paths), "ord") == [("a", 0), ("b", 2)]
    rec = sinks.run_record(fr, spark.createDataFrame([(1, 2)], "correct int, total int"), "{}", {"job_id": "j"})
    again = sinks.run_record(fr.repartition(3), spark.createDataFrame([(1, 2)], "correct int, total int"), "{}", {"job_id": "j"})
    assert rec.first() == again.first() and len(rec.first().config_hash) == 64
    ids = spark.createDataFrame([(1, 7)], "track_id long, new_id long")
    assert rows(sinks.rewrite_track_ids(spark.createDataFrame([(1,), (2,)], "track_id long"), ids), "track_id") == [(2,), (7,)]
    assert rows(sinks.id_mapping(ids)) == [(7, [1])]


# streams


def test_stream_equals_batch(spark, tmp_path):
    from kinelink.plans import stream_queries as S
    from kinelink.streaming import matching

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").filter("user_id < 6")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    out = S._finish(matching.realtime_match(S.stream_scores(stream), threshold=0.2)).collect()
    scores = S.stream_scores(events).withColumn("w", F.unix_millis("window_end"))
    batch = history.history_scores(scores, ["session"], "w", threshold=0.2)
    want = {(r.session, r.w, r.track, r.imu_idx): r.accumulated for r in batch.collect()}
    assert out and all(r.accumulated == pytest.approx(want[(r.session, r.window_end_ms, r.track, r.imu_idx)]) for r in out if r.track)


def test_attitude_stream_equals_batch(spark, tmp_path):
    from kinelink.plans import stream_queries as S
    from kinelink.streaming import matching

    rng = np.random.default_rng(3)
    names = [*layouts.ACC, *layouts.GYRO, *layouts.QUAT]
    data = [("d", int(1000 + 20 * i), *map(float, rng.normal(size=10))) for i in range(80)]
    df = spark.createDataFrame(data, f"device string, ms long, {', '.join(f'{n} double' for n in names)}").withColumn("ts", F.timestamp_millis("ms"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = S._finish(matching.madgwick_stream(stream, "device", "ts", list(layouts.ACC), list(layouts.GYRO), list(layouts.QUAT), delay="200 milliseconds")).orderBy("ts_ms").collect()
    batch = grouped.madgwick(df.withColumn("t", F.col("ms") / 1000), ["device"], "t", list(layouts.ACC), list(layouts.GYRO), list(layouts.QUAT)).orderBy("ms").collect()
    assert len(out) >= 60
    for a, b in zip(out, batch):
        assert abs(sum(a[q] * b[q] for q in layouts.QUAT)) == pytest.approx(1, abs=1e-9)


def test_feature_manifest_reads_channels_only(spark):
    channels = [f"acc_{a}" for a in "xyz"] + [f"quat_{a}" for a in "wxyz"]
    rows = [("s", i, 1.0, 0.0, 0.0, *((0.0,) * 4 if i == 2 else (1.0, 0.0, 0.0, 0.0)), True) for i in range(6)]
    rows.append(("t", 0, None, float("nan"), 0.0, 1.0, 0.0, 0.0, 0.0, False))
    df = spark.createDataFrame(rows, ["seq", "frame", *channels, "correct"])
    out = features.feature_manifest(df, ["seq"], "L_LowArm", "measured")
    assert "correct" not in out.columns
    got = {(r.seq, r.view_id): (r.n_frames, r.n_channels, r.n_valid, r.sensor_location) for r in out.collect()}
    assert got["s", "I6_acc_quat"] == (6, 7, 5, "L_LowArm") and got["s", "I0_acc"] == (6, 3, 6, "L_LowArm")
    assert got["t", "I0_acc"][2] == 0 and got["t", "I4_delta_quaternion"][2] == 1
    assert {v for _, v in got} == {"I0_acc", "I1_acc_magnitude", "I2_acc_changes", "I4_delta_quaternion", "I6_acc_quat"}
    for bad in (lambda: features.feature_manifest(df.drop("acc_x"), ["seq"], "a", "b"), lambda: features.feature_manifest(df, ["seq"], " ", "b")):
        with pytest.raises(ValueError):
            bad()


def test_hard_negatives_are_the_nearest(spark):
    from kinelink.operators import batches

    rows = [(i, "a", float(x)) for i, x in enumerate([0.9, 2.1, -1.0, 50, 50, 50, 50, 50, 50, 90, 7.5, 7.5, 30.25])] + [(20, "b", 1.0), (21, "b", 99.0), (22, "c", 5.0), (23, None, 5.0), (24, "a", None)]
    df = spark.createDataFrame(rows, "id long, act string, x double")
    for k in (1, 3):
        want = set()
        for i, act, x in rows:
            others = sorted((abs(y - x), j) for j, b, y in rows if j != i and act is not None and b == act and x is not None and y is not None) if x is not None else []
            want |= {(i, j, n + 1) for n, (_, j) in enumerate(others[:k])}
        assert {tuple(r) for r in batches.hard_negatives(df, "id", "act", "x", k, 5).collect()} == want
