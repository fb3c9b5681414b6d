"""Orientation, whole-series methods, features and variants on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinelink.functions import layouts as L
from kinelink.functions import pose as P
from kinelink.operators import features, grouped, orientation, series, variants
from kinelink.plans import standins as S
from kinelink.plans.registry import query


def _seen(spark, sf):
    return S.skeletons(spark, sf).withColumn("v", F.transform("joints", lambda p: p["z"] > -0.2))


def _p(i: int, a: str) -> str:
    return f"e[{3 * i + 1 + 'xyz'.index(a)}]"


_H = f"""{S.RECORDINGS}, sk AS (SELECT seq, frame_idx, ts_s, {_p(14, "x")} - {_p(11, "x")} AS lx, {_p(14, "y")} - {_p(11, "y")} AS ly, {_p(14, "z")} - {_p(11, "z")} AS lz, {_p(8, "x")} - {_p(0, "x")} AS ux, {_p(8, "y")} - {_p(0, "y")} AS uy, {_p(8, "z")} - {_p(0, "z")} AS uz,
  {_p(11, "z")} > -0.2 AND {_p(14, "z")} > -0.2 AS sh, {_p(0, "z")} > -0.2 AND {_p(8, "z")} > -0.2 AS sp FROM r)"""


@query(f"""WITH {_H}, c AS (SELECT *, ly * uz - lz * uy AS fx, lx * uy - ly * ux AS fz FROM sk)
SELECT seq, frame_idx, sh AND sp AS valid, round(CASE WHEN sh AND sp THEN sin(atan2(fz, fx)) ELSE 0 END, 5) + 0.0 AS angle_sin, round(CASE WHEN sh AND sp THEN cos(atan2(fz, fx)) ELSE 0 END, 5) + 0.0 AS angle_cos, CASE WHEN NOT sp THEN 'missing_pelvis_thorax' WHEN NOT sh THEN 'missing_shoulders' ELSE '' END AS reason FROM c""")
def torso_heading_3d(spark, sf):
    t = orientation.torso_heading_3d(_seen(spark, sf), ["seq"], "ts_s", "joints", "v")
    return S.rounded(t.select("seq", "frame_idx", "valid", "angle_sin", "angle_cos", "reason"), 5)


@query(f"""WITH {_H} SELECT seq, frame_idx, sh AS valid, round(CASE WHEN sh THEN sin(2 * atan2(ly, lx)) ELSE 0 END, 5) + 0.0 AS angle_sin, round(CASE WHEN sh THEN cos(2 * atan2(ly, lx)) ELSE 0 END, 5) + 0.0 AS angle_cos, CASE WHEN NOT sh THEN 'missing_shoulder' ELSE '' END AS reason FROM sk""")
def torso_proxy_2d(spark, sf):
    t = orientation.torso_proxy_2d(_seen(spark, sf), ["seq"], "ts_s", "joints", "v")
    return S.rounded(t.select("seq", "frame_idx", "valid", "angle_sin", "angle_cos", "reason"), 5)


@query(f"""WITH {S.SENSORS}, n AS (SELECT *, sqrt(quat_w ** 2 + quat_x ** 2 + quat_y ** 2 + quat_z ** 2) AS s FROM im), u AS (SELECT seq, frame_idx, quat_w / s AS w, quat_x / s AS x, quat_y / s AS y, quat_z / s AS z FROM n)
SELECT seq, frame_idx, round(atan2(1 - 2 * (x * x + y * y), 2 * (x * z + y * w)), 5) + 0.0 AS angle, round(1 - 2 * (y * y + z * z), 5) + 0.0 AS first_6d FROM u""")
def root_orientation(spark, sf):
    q = S.sensors(spark, sf).withColumn("q", F.array(*L.QUAT))
    t = orientation.root_orientation(q, ["seq"], "ts_s", "q")
    return S.rounded(t.select("seq", "frame_idx", "angle", F.get("orientation_6d", F.lit(0)).alias("first_6d")), 5)


def resampled_sql(values: str, n: int) -> str:
    """SQL: a list resampled to n values between neighbours."""
    place = f"(i * (len({values}) - 1) / {n - 1}.0::DOUBLE)"
    return f"list_transform(range({n}), lambda i: {values}[floor({place})::BIGINT + 1] + ({values}[least(floor({place})::BIGINT + 2, len({values}))] - {values}[floor({place})::BIGINT + 1]) * ({place} - floor({place})))"


_STREAM = f"""{_H}, c AS (SELECT seq, frame_idx, ts_s, sh AND sp AS ok, atan2(lx * uy - ly * ux, ly * uz - lz * uy) AS a FROM sk),
g AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY frame_idx) - row_number() OVER (PARTITION BY seq, ok ORDER BY frame_idx) AS isl FROM c), d AS (SELECT *, a - lag(a) OVER (PARTITION BY seq, ok, isl ORDER BY frame_idx) AS d FROM g),
un AS (SELECT *, a + sum(CASE WHEN d IS NULL OR abs(d) < pi() THEN 0 ELSE -2 * pi() * floor((d + pi()) / (2 * pi())) END) OVER (PARTITION BY seq, ok, isl ORDER BY frame_idx) AS u FROM d),
h AS (SELECT *, u - lag(u) OVER k AS du, ts_s - lag(ts_s) OVER k AS hb, lead(u) OVER k - u AS eu, lead(ts_s) OVER k - ts_s AS ha FROM un WINDOW k AS (PARTITION BY seq, ok, isl ORDER BY frame_idx)),
rr AS (SELECT seq, frame_idx, ok, a, greatest(-1, least(1, CASE WHEN NOT ok THEN 0 WHEN du IS NOT NULL AND eu IS NOT NULL THEN (du / hb * ha + eu / ha * hb) / (ha + hb) ELSE coalesce(du / hb, eu / ha, 0) END / 5)) AS rate FROM h),
l AS (SELECT seq, list(CASE WHEN ok THEN sin(a) ELSE 0 END ORDER BY frame_idx) AS c0, list(CASE WHEN ok THEN cos(a) ELSE 0 END ORDER BY frame_idx) AS c1, list(CASE WHEN ok THEN rate ELSE 0 END ORDER BY frame_idx) AS c2, list(ok::INT::DOUBLE ORDER BY frame_idx) AS c3, list(abs(rate) ORDER BY frame_idx) AS c4 FROM rr GROUP BY seq),
s48 AS (SELECT seq, {resampled_sql("c0", 48)} AS s0, {resampled_sql("c1", 48)} AS s1, {resampled_sql("c2", 48)} AS s2, list_transform({resampled_sql("c3", 48)}, lambda v: (v >= 0.5)::INT::DOUBLE) AS s3, list_transform({resampled_sql("c4", 48)}, lambda v: (v >= 0.5)::INT::DOUBLE) AS s4 FROM l)"""


@query(f"WITH {_STREAM} SELECT seq, list_transform(list_concat(s0, list_concat(s1, list_concat(s2, list_concat(s3, s4)))), lambda v: round(v, 4) + 0.0) AS stream FROM s48")
def orientation_stream(spark, sf):
    t = orientation.torso_heading_3d(_seen(spark, sf), ["seq"], "ts_s", "joints", "v")
    return S.rounded(orientation.orientation_stream(t, ["seq"], "frame_idx", 48).select("seq", F.transform(F.flatten("stream"), lambda v: F.round(v, 4) + F.lit(0.0)).alias("stream")), 4)


@query(f"WITH {_STREAM} SELECT seq, list_sum(s4)::BIGINT AS turning_count FROM s48")
def turning_counts(spark, sf):
    t = orientation.torso_heading_3d(_seen(spark, sf), ["seq"], "ts_s", "joints", "v")
    return orientation.turning_counts(orientation.orientation_stream(t, ["seq"], "frame_idx", 48), ["seq"])


@query()
def fft_lowpass(spark, sf):
    out = grouped.fft_lowpass(S.sensors(spark, sf).select("seq", "frame_idx", *L.ACC), ["seq"], ["frame_idx"], list(L.ACC), 4.0, 30.0)
    return S.rounded(out)


@query()
def madgwick(spark, sf):
    out = grouped.madgwick(S.sensors(spark, sf), ["seq"], "ts_s", list(L.ACC), list(L.GYRO), list(L.QUAT))
    return S.rounded(out.select("seq", "frame_idx", *L.QUAT))


@query()
def spectral_summary(spark, sf):
    return S.rounded(grouped.spectral_summary(S.sensors(spark, sf), ["seq"], "ts_s", list(L.ACC)))


@query()
def frequency_profile(spark, sf):
    out = grouped.frequency_profile(S.sensors(spark, sf), ["seq"], "ts_s", list(L.ACC), 16)
    return out.select("seq", F.transform("profile", lambda v: F.round(v, 5)).alias("profile"))


@query()
def similarity_descriptor(spark, sf):
    out = grouped.similarity_descriptor(S.skeletons(spark, sf), ["seq"], "frame_idx", "joints")
    return S.rounded(out.select("seq", "frame_idx", "transform.*"))


def _screen_rows(spark, sf):
    """Groups of four recordings' stretches: the two sides are two numbers of the same vectors."""
    r = S.recordings(spark, sf).withColumn("part", F.floor(F.col("frame_idx") / 12))
    cells = F.array_sort(F.collect_list(F.struct("frame_idx", F.array(F.get("e", F.lit(0))).alias("l"), F.array(F.get("e", F.lit(0)) + F.get("e", F.lit(1)), F.get("e", F.lit(2))).alias("r"))))
    return r.groupBy("seq", "part").agg(cells.alias("c")).filter(F.size("c") == 12).select((F.floor(F.col("seq") / 4) * 1000 + F.col("part")).alias("grp"), (F.col("seq") % 4).alias("idx"), "c.l", "c.r")


@query()
def physical_screen(spark, sf):
    return grouped.physical_screen(_screen_rows(spark, sf), "grp", "idx", "l", "r", "ncc", 1)


@query()
def physical_screen_cca(spark, sf):
    return S.rounded(grouped.series_scores(_screen_rows(spark, sf), "grp", "idx", "l", "r", "cca"))


@query()
def physical_screen_coherence(spark, sf):
    return S.rounded(grouped.series_scores(_screen_rows(spark, sf), "grp", "idx", "l", "r", "coherence"))


@query()
def skeleton_tokens(spark, sf):
    out = features.skeleton_features(S.skeletons(spark, sf), ["seq"], "frame_idx", "joints", "tokens")
    return out.select("seq", "frame_idx", F.transform("features", lambda v: F.round(v, 4) + F.lit(0.0)).alias("features"))


@query()
def h36m_features(spark, sf):
    """Width and mean size of every feature mode."""
    f = features.h36m_modes(S.skeletons(spark, sf), ["seq"], "frame_idx", "joints", features.H36M_MODES)
    told = lambda m: [F.max(F.size(m)).alias(f"{m}_width"), F.avg(F.aggregate(m, F.lit(0.0), lambda a, v: a + v * v)).alias(f"{m}_square")]
    one = f.groupBy("seq").agg(*(c for m in features.H36M_MODES for c in told(m)))
    rows = F.array(*(F.struct(F.col(f"{m}_width").alias("width"), F.col(f"{m}_square").alias("mean_square"), F.lit(m).alias("mode")) for m in features.H36M_MODES))
    return S.rounded(one.select("seq", F.explode(rows).alias("_x")).select("seq", "_x.*"), 4)


@query()
def motion_complexity(spark, sf):
    return S.rounded(features.motion_complexity(S.skeletons(spark, sf), ["seq"], "frame_idx", "joints"))


_SCORED = lambda v: f"list_transform({v}, lambda v: round((v - list_avg({v})) / greatest(list_stddev_pop({v}), 1e-5), 5) + 0.0)"


@query(f"""WITH {S.SENSORS}, k AS (SELECT seq, frame_idx, frame_idx // 24 AS w, ts_s, ({_p(11, "x")} + {_p(14, "x")}) / 2 AS x, ({_p(11, "y")} + {_p(14, "y")}) / 2 AS y, {_p(11, "z")} > -0.2 AND {_p(14, "z")} > -0.2 AS ok FROM r),
v AS (SELECT *, CASE WHEN ok AND lag(ok) OVER g AND ts_s > lag(ts_s) OVER g THEN sqrt(((x - lag(x) OVER g) / (ts_s - lag(ts_s) OVER g)) ** 2 + ((y - lag(y) OVER g) / (ts_s - lag(ts_s) OVER g)) ** 2) ELSE 0 END AS speed FROM k WINDOW g AS (PARTITION BY seq, w ORDER BY frame_idx)),
l AS (SELECT v.seq, v.w, list(speed ORDER BY v.frame_idx) AS a, list(sqrt(acc_x ** 2 + acc_y ** 2 + acc_z ** 2) ORDER BY v.frame_idx) AS b FROM v JOIN im ON im.seq = v.seq AND im.frame_idx = v.frame_idx GROUP BY 1, 2),
s24 AS (SELECT seq, w, {resampled_sql("a", 24)} AS a, {resampled_sql("b", 24)} AS b FROM l) SELECT seq, w, {_SCORED("a")} AS feature, {_SCORED("b")} AS acc_magnitude FROM s24""")
def trajectory_feature_pair(spark, sf):
    """Shoulder speed and acceleration size of windows of 24 frames, both resampled and standardised."""
    anchor = P.global_anchors("joints", "v", L.H36M17)["A3_shoulder_midpoint"]
    k = _seen(spark, sf).withColumn("w", F.floor(F.col("frame_idx") / 24)).withColumn("a", anchor)
    k = k.select("seq", "w", "frame_idx", "ts_s", "a.p.x", "a.p.y", F.col("a.valid").alias("ok"))
    speed = features.scalar_feature(k, ["seq", "w"], "ts_s", ["x", "y"], F.col("ok"), "speed")
    left = features.window_feature(speed, ["seq", "w"], "frame_idx", "feature", 24)
    imu = series.imu_views(S.sensors(spark, sf).withColumn("w", F.floor(F.col("frame_idx") / 24)), ["seq", "w"], "ts_s", False, False)
    right = features.window_feature(imu, ["seq", "w"], "frame_idx", "acc_magnitude", 24)
    both = left.join(right, ["seq", "w"])
    return both.select("seq", "w", *(F.transform(c, lambda v: F.round(v, 5) + F.lit(0.0)).alias(c) for c in ("feature", "acc_magnitude")))


def _imu(spark, sf):
    return S.sensors(spark, sf).select(F.col("seq").cast("string").alias("sequence_id"), F.lit(0).alias("person_idx"), "frame_idx", *L.ACC, *L.QUAT)


def _people(spark, sf):
    return S.skeletons(spark, sf).select(F.col("seq").cast("string").alias("sequence_id"), F.lit(0).alias("person_idx"), "frame_idx", "joints", F.lit(True).alias("visible"))


_SPEC = variants.Spec(acc_noise_std=0.05, acc_lowpass_cutoff_hz=4.0, acc_spike_ratio=0.02, mount_euler_xyz_deg=(10.0, 20.0, 30.0), global_yaw_deg=15.0, joint_dropout_rate=0.1, fragmentation_rate=0.1)


@query()
def variant_imu(spark, sf):
    """All sensor variants in a chain."""
    out, _ = variants.apply_variant(_imu(spark, sf), _people(spark, sf), list(variants.IMU), _SPEC)
    return S.rounded(out)


@query()
def variant_skeleton(spark, sf):
    """All skeleton variants in a chain: the pelvis and one wrist of each frame."""
    _, out = variants.apply_variant(_imu(spark, sf), _people(spark, sf), list(variants.SKELETON), _SPEC)
    return S.rounded(out.select("sequence_id", "frame_idx", F.get("joints", F.lit(0))["x"].alias("pelvis_x"), F.get("joints", F.lit(13))["x"].alias("wrist_x"), "visible", "track_valid", "source_frame", F.get("joint_visible", F.lit(13)).alias("wrist_visible")))


_Q = f"""{S.SENSORS}, n AS (SELECT *, sqrt(quat_w ** 2 + quat_x ** 2 + quat_y ** 2 + quat_z ** 2) AS s FROM im)"""


@query(f"""WITH {_Q}, u AS (SELECT seq::VARCHAR AS sequence_id, frame_idx, quat_w / s AS w, quat_x / s AS x, quat_y / s AS y, quat_z / s AS z FROM n), d AS (SELECT *, w * lag(w) OVER k + x * lag(x) OVER k + y * lag(y) OVER k + z * lag(z) OVER k AS p FROM u WINDOW k AS (PARTITION BY sequence_id ORDER BY frame_idx)),
o AS (SELECT *, sum(coalesce(p < 0, false)::INT) OVER (PARTITION BY sequence_id ORDER BY frame_idx) % 2 = 1 AS odd FROM d) SELECT sequence_id, frame_idx, round(CASE WHEN odd THEN -w ELSE w END, 6) + 0.0 AS quat_w FROM o""")
def variant_quat_repair(spark, sf):
    return S.rounded(variants.quat_repair(_imu(spark, sf), _SPEC).select("sequence_id", "frame_idx", "quat_w"))


_FINITE = lambda group, axes: " AND ".join(f"isfinite({group}_{a})" for a in axes)


@query(f"""WITH {S.SENSORS}, ok AS (SELECT seq, coalesce({_FINITE("acc", "xyz")}, false) AS a, coalesce({_FINITE("gyro", "xyz")}, false) AS g, coalesce({_FINITE("quat", "wxyz")} AND sqrt(quat_w * quat_w + quat_x * quat_x + quat_y * quat_y + quat_z * quat_z) > 1e-8, false) AS q FROM im),
v AS (SELECT * FROM (VALUES ('I0_acc', 3, true, false, false), ('I1_acc_magnitude', 2, true, false, false), ('I2_acc_changes', 4, true, false, false), ('I3_gyro', 3, false, true, false), ('I4_delta_quaternion', 5, false, false, true), ('I5_acc_gyro', 6, true, true, false), ('I6_acc_quat', 7, true, false, true), ('I7_acc_gyro_quat', 10, true, true, true)) t(view_id, n_channels, na, ng, nq))
SELECT seq, view_id, count(*) AS n_frames, n_channels::BIGINT AS n_channels, sum(((NOT na OR a) AND (NOT ng OR g) AND (NOT nq OR q))::INT)::BIGINT AS n_valid, 'wrist' AS sensor_location, 'measured' AS provenance FROM ok, v GROUP BY seq, view_id, n_channels""")
def feature_manifest(spark, sf):
    return S.rounded(features.feature_manifest(S.sensors(spark, sf), ["seq"], "wrist", "measured").drop("channels"))
