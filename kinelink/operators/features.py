"""Per-window features of skeletons and sensors, as arrays per frame."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelink.functions import layouts as L
from kinelink.functions import pose as P
from kinelink.functions import randoms as R
from kinelink.functions import vectors as V
from kinelink.operators.series import derivatives, diff_zero, moving_average, over, unwrap

_EPS = 1e-8


# COCO joint numbers of the arm tokens and the image size.
_LS, _LH, _RH = 5, 11, 12
_ARM = {"ls": _LS, "rs": 6, "le": 7, "lw": 9, "lh": _LH, "rh": _RH}
SCREEN = (1920.0, 1080.0)


def arm_tokens(df: DataFrame, keys: list[str], order: str, joints: str, kernel: int = 9) -> DataFrame:
    """(keys, order, features): four tokens of twelve numbers per frame: upper arm, forearm, their relation, body context.

    One plan: the joints used are smoothed, turned into the shoulders' frame, their angles unwrapped and differences taken by
    windows over one partitioning; the tokens are arrays of these columns, filled with zeros.
    """
    out = df.select(*keys, order, *((F.get(joints, F.lit(j))[a] / size_).alias(f"{n}_{a}") for n, j in _ARM.items() for a, size_ in zip("xy", SCREEN)))
    for n in _ARM if kernel > 1 else ():
        for a in "xy":
            out = moving_average(out, keys, [order], f"{n}_{a}", kernel, f"{n}_{a}")
    xy = lambda n: (F.col(f"{n}_x"), F.col(f"{n}_y"))
    less = lambda p, q: (p[0] - q[0], p[1] - q[1])
    half = lambda p, q: ((p[0] + q[0]) / 2, (p[1] + q[1]) / 2)
    dot = lambda p, q: p[0] * q[0] + p[1] * q[1]
    cross = lambda p, q: p[0] * q[1] - p[1] * q[0]
    long = lambda p: F.sqrt(dot(p, p))
    across = less(xy("rs"), xy("ls"))
    out = out.withColumn("_width", long(across)).withColumn("scale", F.greatest("_width", F.lit(0.05)))
    axis = tuple(c / F.greatest(F.col("_width"), F.lit(_EPS)) for c in across)
    trunk = half(half(xy("lh"), xy("rh")), half(xy("ls"), xy("rs")))
    spans = {"upper": less(xy("le"), xy("ls")), "fore": less(xy("lw"), xy("le")), "wrist": less(xy("lw"), xy("ls")), "centre": less(trunk, xy("ls"))}
    # along the shoulders and square to them, in shoulder widths
    out = out.withColumns({f"{n}_{a}": f(axis, v) / F.col("scale") for n, v in spans.items() for a, f in (("x", dot), ("y", cross))})
    for n in ("upper", "fore"):
        out = unwrap(out.withColumn("_angle", F.atan2(f"{n}_y", f"{n}_x")), keys, [order], "_angle", F.lit(True), name=f"{n}_angle")
    out = unwrap(out.withColumn("_angle", F.col("fore_angle") - F.col("upper_angle")), keys, [order], "_angle", F.lit(True), name="bend")
    out = diff_zero(out, keys, [order], "bend", name="bending")
    for n in ("upper", "fore", "centre"):
        for a in "xy":
            out = diff_zero(diff_zero(out, keys, [order], f"{n}_{a}", name=f"{n}_step_{a}"), keys, [order], f"{n}_{a}", 2, f"{n}_turn_{a}")
    unit_of = lambda n: tuple(c / F.greatest(long(xy(n)), F.lit(_EPS)) for c in xy(n))
    one, none, u, f = F.lit(1.0), F.lit(0.0), unit_of("upper"), unit_of("fore")
    bone = lambda n, bending: [*unit_of(n), long(xy(n)), *xy(f"{n}_step"), long(xy(f"{n}_turn")), bending, one]
    gap = less(less(xy("wrist"), xy("upper")), xy("fore"))
    ratio = F.log(F.least(F.greatest(F.greatest(long(xy("upper")), F.lit(1e-4)) / F.greatest(long(xy("fore")), F.lit(1e-4)), F.lit(1e-3)), F.lit(1e3)))
    tokens = [
        bone("upper", none),
        bone("fore", F.col("bending")),
        [dot(u, f), cross(u, f), F.cos("bend"), F.sin("bend"), ratio, *gap, long(gap), *xy("wrist"), F.abs("bending"), one],
        [*xy("ls"), *xy("centre"), *xy("centre_step"), F.col("scale"), one],
    ]
    return out.select(*keys, order, F.array(*(x for t in tokens for x in t + [none] * (12 - len(t)))).alias("features"))


def _smoothed(df: DataFrame, keys: list[str], order: str, vector: str, kernel: int) -> DataFrame:
    """An array column replaced by its mean over `kernel` frames, number by number; the first and last frame stand for what lies beyond the ends."""
    if kernel <= 1:
        return df
    pad, w = kernel // 2, over(keys, [order])
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place, frames = F.row_number().over(w), F.count(F.lit(1)).over(whole)
    out = df.withColumns({"_near": F.collect_list(vector).over(w.rowsBetween(-pad, kernel - 1 - pad)), "_first": F.first(vector).over(whole), "_last": F.last(vector).over(whole), "_lack": F.greatest(F.lit(0), pad + 1 - place), "_over": F.greatest(F.lit(0), place + kernel - 1 - pad - frames)})
    ends = F.zip_with("_first", "_last", lambda a, b: a * F.col("_lack") + b * F.col("_over"))
    total = F.aggregate("_near", ends, lambda t, v: F.zip_with(t, v, lambda a, b: a + b))
    return out.withColumn(vector, F.transform(total, lambda v: v / kernel)).drop("_near", "_first", "_last", "_lack", "_over")


def _steps(vector: Column, keys: list[str], order: str) -> Column:
    """An array's difference to that of the frame before, zeros in the first frame."""
    before = F.lag(vector).over(over(keys, [order]))
    return F.coalesce(F.zip_with(vector, before, lambda a, b: a - b), F.transform(vector, lambda v: F.lit(0.0)))


def _numbers(points: Column, axes: str = "xyz") -> Column:
    return F.flatten(F.transform(points, lambda p: F.array(*(p[a] for a in axes))))


def raw_pose(df: DataFrame, keys: list[str], order: str, joints: str, kernel: int = 9) -> DataFrame:
    """(keys, order, features): 72 numbers per frame: the image's joints seen from the left shoulder, their steps, the shoulder, and the hips from it."""
    screen = F.transform(_numbers(F.col(joints), "xy"), lambda v, i: v.cast("double") / F.when(i % 2 == 0, SCREEN[0]).otherwise(SCREEN[1]))
    out = _smoothed(df.select(*keys, order, screen.alias("p")), keys, order, "p", kernel)
    at = lambda j, a: F.get("p", F.lit(2 * j + a))
    shoulder = [at(_LS, a) for a in (0, 1)]
    out = out.withColumn("own", F.transform("p", lambda v, i: v - F.when(i % 2 == 0, shoulder[0]).otherwise(shoulder[1])))
    hips = [(at(_LH, a) + at(_RH, a)) / 2 - shoulder[a] for a in (0, 1)]
    return out.select(*keys, order, F.concat("own", _steps(F.col("own"), keys, order), F.array(*shoulder, *hips)).alias("features"))


# The feature modes, each with how joints are written and what follows them and their steps.
_MODES = {
    "h36m2d": ("flat", ()),
    "h36m3d": ("plain", ()),
    "h36m3d_no_velocity": ("plain", ()),
    "h36m3d_bone": ("bones", ()),
    "h36m3d_heading": ("plain", ("direction", "rate", "seen")),
    "h36m3d_heading_rate": ("plain", ("rate", "seen")),
    "h36m3d_rotinv": ("turned", ()),
    "h36m3d_zonly": ("depth", ()),
    "h36m3d_geom": ("plain", ("lengths",)),
    "h36m3d_left_wrist": ("plain", ("left",)),
    "h36m3d_right_wrist": ("plain", ("right",)),
    "h36m3d_both_wrist": ("plain", ("left", "right")),
    "h36m3d_left_wrist_rot": ("plain", ("left_in_torso",)),
}
H36M_MODES = tuple(_MODES)
_WIDTHS = {"direction": 2, "rate": 1, "seen": 1, "lengths": 17, "left": 6, "right": 6, "left_in_torso": 6}
# H36M joint numbers.
_PELVIS, _THORAX, _LEFT, _RIGHT = 0, 8, 11, 14
_FOREARMS = {"left": (12, 13), "right": (15, 16)}


def h36m_width(mode: str) -> int:
    if mode not in _MODES:
        raise ValueError(f"unknown feature mode {mode!r}; there are {', '.join(H36M_MODES)}")
    return 102 + sum(_WIDTHS[part] for part in _MODES[mode][1])


def _with_unit(df: DataFrame, name: str) -> DataFrame:
    """A column of vectors in unit length."""
    return df.withColumn("_long", F.greatest(P.length(F.col(name)), F.lit(_EPS))).withColumn(name, P.times(F.col(name), 1 / F.col("_long"))).drop("_long")


def h36m_modes(df: DataFrame, keys: list[str], order: str, joints: str, modes: Sequence[str], kernel: int = 9) -> DataFrame:
    """(keys, order, and a column of features for each mode): the 17 joints and their steps, written as the mode says, and the mode's own numbers.

    Joints stand from the pelvis in shoulder widths, smoothed. The heading is the angle in the x-z plane of what stands square to shoulders
    and trunk; it is unwrapped before its rate is taken. A wrist has the forearm's direction (from outside or along shoulders,
    trunk and front) and its cross product with the one a frame before. One plan of columns and windows over one partitioning, whose
    parts are made once for all modes.
    """
    for mode in modes:
        h36m_width(mode)
    forms, extras = {_MODES[m][0] for m in modes}, {part for m in modes for part in _MODES[m][1]}
    points = lambda z: F.transform(joints, lambda q: P.minus(P.xyz(q["x"], q["y"], z(q)), P.xyz(*(P.joint(joints, _PELVIS)[a] for a in "xy"), z(P.joint(joints, _PELVIS)))))
    kinds = {name: points(z) for name, z, used in (("n", lambda q: q["z"], forms - {"flat"}), ("flat", lambda q: F.lit(0.0), forms & {"flat"})) if used}
    width = lambda name: F.greatest(P.distance(P.joint(name, _RIGHT), P.joint(name, _LEFT)), F.lit(1e-4))
    out = df.select(*keys, order, *(c.alias(name) for name, c in kinds.items())).withColumns({f"_w{name}": width(name) for name in kinds})
    out = out.withColumns({name: F.zip_with(_numbers(F.col(name)), F.array_repeat(f"_w{name}", 51), lambda v, w: v / w) for name in kinds}).drop(*(f"_w{name}" for name in kinds))
    for name in kinds:
        out = _smoothed(out, keys, order, name, kernel)
    at = lambda i: P.joint("p", i)
    if "n" in kinds:
        out = out.withColumn("p", F.transform(F.sequence(F.lit(0), F.lit(16)), lambda j: P.xyz(*(F.get("n", 3 * j + a) for a in range(3)))))
        out = out.withColumns({"across": P.minus(at(_RIGHT), at(_LEFT)), "trunk": P.minus(at(_THORAX), at(_PELVIS))})
    if "turned" in forms or "rate" in extras:
        out = out.withColumn("front", P.cross(F.col("across"), F.col("trunk")))
        out = out.withColumn("seen", F.hypot(F.col("front.x"), F.col("front.z")) > 1e-5)
        out = out.withColumn("angle", F.when(F.col("seen"), F.atan2(F.col("front.z"), F.col("front.x"))).otherwise(0.0))
        out = out.withColumns({n: F.when(F.col("seen"), f("angle")).otherwise(0.0) for n, f in (("sine", F.sin), ("cosine", F.cos))})
    if "rate" in extras:
        out = diff_zero(unwrap(out, keys, [order], "angle", F.lit(True), name="whole_angle"), keys, [order], "whole_angle", name="rate")
    if "bones" in forms or "lengths" in extras:
        out = out.withColumn("bones", F.array(*(P.minus(at(i), at(p)) if p >= 0 else P.xyz(0, 0, 0) for i, p in enumerate(L.H36M_PARENTS))))
    sine, cosine = F.col("sine"), F.col("cosine")
    written = {
        "plain": lambda: F.col("n"),
        "flat": lambda: F.col("flat"),
        "depth": lambda: F.transform("n", lambda v, i: F.when(i % 3 == 2, v).otherwise(0.0)),
        "bones": lambda: _numbers(F.col("bones")),
        # turned about the vertical until the front stands on the x axis
        "turned": lambda: _numbers(F.when(F.col("seen"), F.transform("p", lambda q: P.xyz(q["x"] * cosine + q["z"] * sine, q["y"], q["z"] * cosine - q["x"] * sine))).otherwise(F.col("p"))),
    }
    for form in sorted(forms):
        out = out.withColumn(f"own_{form}", written[form]())
        out = out.withColumn(f"steps_{form}", _steps(F.col(f"own_{form}"), keys, order))
    added = {"lengths": F.transform("bones", P.length), "direction": F.array(sine, cosine), **{n: F.array(F.col(n).cast("double")) for n in ("rate", "seen")}}
    for name in sorted(extras - added.keys()):
        elbow, wrist = map(at, _FOREARMS[name.split("_")[0]])
        out = _with_unit(out.withColumn(name, P.minus(wrist, elbow)), name)
        if name.endswith("in_torso"):
            out = _with_unit(_with_unit(out.withColumns({"unit_across": F.col("across"), "unit_trunk": F.col("trunk")}), "unit_across"), "unit_trunk")
            out = _with_unit(out.withColumn("unit_front", P.cross(F.col("unit_across"), F.col("unit_trunk"))), "unit_front")
            out = out.withColumn(name, P.xyz(*(P.dot(F.col(name), F.col(f"unit_{c}")) for c in ("across", "trunk", "front"))))
        turned = P.cross(F.coalesce(F.lag(name).over(over(keys, [order])), F.col(name)), F.col(name))
        added[name] = _numbers(F.array(F.col(name), turned))
    still = F.array_repeat(F.lit(0.0), 51)
    features = {m: F.concat(F.col(f"own_{_MODES[m][0]}"), still if m == "h36m3d_no_velocity" else F.col(f"steps_{_MODES[m][0]}"), *(added[part] for part in _MODES[m][1])) for m in modes}
    made = out.select(*keys, order, *(c.alias(m) for m, c in features.items()))
    finite = lambda m: F.assert_true(F.forall(m, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(f"{m} gives numbers that are not finite"))
    return made.select(*keys, order, *(F.when(finite(m).isNull(), F.col(m)).alias(m) for m in modes))


def h36m_features(df: DataFrame, keys: list[str], order: str, joints: str, mode: str = "h36m3d", kernel: int = 9) -> DataFrame:
    """(keys, order, features) of one mode, as in h36m_modes."""
    return h36m_modes(df, keys, order, joints, [mode], kernel).withColumnRenamed(mode, "features")


def skeleton_features(df: DataFrame, keys: list[str], order: str, joints: str, mode: str, kernel: int = 9) -> DataFrame:
    """(keys, order, features): 'tokens', 'raw72' or one of the H36M modes; whole series or windows, as the keys say."""
    plans = {"tokens": arm_tokens, "raw72": raw_pose}
    return plans[mode](df, keys, order, joints, kernel) if mode in plans else h36m_features(df, keys, order, joints, mode, kernel)


MOTION = ("motion_energy", "max_speed", "acceleration_energy", "jerk_energy", "active_ratio", "simultaneous_ratio", "spectral_entropy", "periodicity", "scale")


def rhythms(speeds: pd.Series) -> pd.DataFrame:
    """Entropy of a speed's spectrum and its largest absolute correlation with itself at lags 1 to 8 (five samples or more)."""
    out = np.zeros((len(speeds), 2))
    sizes = np.fromiter(map(len, speeds), np.int64, len(speeds))
    for n in np.unique(sizes[sizes > 1]).tolist():
        at = np.flatnonzero(sizes == n)
        x = np.stack([np.asarray(speeds.iloc[i], float) for i in at])
        power = np.abs(np.fft.rfft(x - x.mean(axis=1, keepdims=True), axis=1))[:, 1:] ** 2
        total = power.sum(axis=1, keepdims=True)
        share = power / np.where(total > 0, total, 1.0)
        out[at, 0] = np.where(total[:, 0] > 0, -(share * np.log(share + 1e-12)).sum(axis=1), 0.0)
        for lag in range(1, min(8, n - 5) + 1):
            a, b = x[:, lag:] - x[:, lag:].mean(axis=1, keepdims=True), x[:, :-lag] - x[:, :-lag].mean(axis=1, keepdims=True)
            spread = np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
            out[at, 1] = np.maximum(out[at, 1], np.where(spread > 0, np.abs((a * b).sum(axis=1)) / np.where(spread > 0, spread, 1.0), 0.0))
    return pd.DataFrame(out, columns=["entropy", "periodicity"])


def motion_complexity(df: DataFrame, keys: list[str], order: str, joints: str, wrists: tuple[int, int] = (13, 16), two_d: bool = False) -> DataFrame:
    """(keys, figures): one row per series of four frames or more.

    Joints stand relative to the root; everything is in median bone lengths, and numbers that are not finite are left
    out of every figure (a frame whose wrists have none is out of the rhythm). A joint is active above the upper quartile of its series' speeds.
    """
    axes = "xy" if two_d else "xyz"
    real = lambda c: F.when(F.abs(c) < float("inf"), c)
    norm = lambda parts: F.sqrt(reduce(Column.__add__, (c * c for c in parts)))
    at = lambda i, a: F.get(joints, F.lit(i))[a].cast("double")
    lengths = F.array(*(norm([at(i, a) - at(p, a) for a in axes]) for i, p in enumerate(L.H36M_PARENTS) if p >= 0))
    bones = df.select(*keys, F.explode(lengths).alias("_b")).filter("_b > 1e-8 and _b < double('inf')")
    scale = bones.groupBy(*keys).agg(F.median("_b").alias("scale"))
    size_ = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 4").join(scale, keys, "left").fillna(1.0, ["scale"])
    each = df.select(*keys, order, *(at(0, a).alias(f"_root_{a}") for a in axes), F.posexplode(joints).alias("_j", "_q"))
    each = each.select(*keys, order, "_j", *((F.col("_q")[a].cast("double") - F.col(f"_root_{a}")).alias(a) for a in axes)).join(size_, keys)
    w, before = over([*keys, "_j"], [order]), list(axes)
    for name in ("speed", "acc", "jerk"):
        each = each.withColumns({f"_{name}_{a}": F.col(c) - F.lag(c).over(w) for a, c in zip(axes, before)})
        before = [f"_{name}_{a}" for a in axes]
        each = each.withColumn(name, real(norm(map(F.col, before)) / F.col("scale")))
    moves = each.select(*keys, order, "_j", "scale", "speed", "acc", "jerk")
    energy = moves.groupBy(*keys).agg(F.avg("speed").alias("motion_energy"), F.max("speed").alias("max_speed"), F.avg("acc").alias("acceleration_energy"), F.avg("jerk").alias("jerk_energy"), F.percentile("speed", 0.75).alias("_limit"), F.first("scale").alias("scale"))
    per_frame = moves.filter("speed is not null").join(energy.select(*keys, "_limit"), keys).groupBy(*keys, order).agg(F.count_if(F.col("speed") > F.col("_limit")).alias("_on"), F.count(F.lit(1)).alias("_all"), F.avg(F.when(F.col("_j").isin(*wrists), F.col("speed"))).alias("_wrist"))
    rhythm = F.array_sort(F.collect_list(F.when(F.col("_wrist").isNotNull(), F.struct(order, "_wrist"))))
    active = per_frame.groupBy(*keys).agg((F.sum("_on") / F.sum("_all")).alias("active_ratio"), F.avg((2 * F.col("_on") >= F.col("_all")).cast("double")).alias("simultaneous_ratio"), rhythm.alias("_r"))
    figures = active.withColumn("_w", F.pandas_udf(rhythms, "struct<entropy:double,periodicity:double>")(F.col("_r._wrist"))).select(*keys, "active_ratio", "simultaneous_ratio", F.col("_w.entropy").alias("spectral_entropy"), F.col("_w.periodicity").alias("periodicity"))
    return energy.join(figures, keys).select(*keys, *MOTION)


def augment_window(df: DataFrame, keys: list[str], order: str, imu: str, joints: str, seed: int, imu_noise: float = 0.0, channel_dropout: float = 0.0, joint_noise: float = 0.0, joint_dropout: float = 0.0) -> DataFrame:
    """Noise on every number, and channels and joints that are 0 over a whole window: one draw per window and channel or joint.

    imu is an array of channels, joints an array of structs, keys name the window.
    """
    noise = lambda std, *more: std * R.normal(seed, *keys, order, *more)
    kept = lambda share, kind, i: (R.uniform(seed, *keys, F.lit(kind), i) > share).cast("double")
    channels = F.transform(imu, lambda v, i: (v + noise(imu_noise, i)) * kept(channel_dropout, "channel", i))
    moved = lambda p, i: F.struct(*(((p[a] + noise(joint_noise, i, F.lit(a))) * kept(joint_dropout, "joint", i)).alias(a) for a in "xyz"))
    return df.withColumn(imu, channels).withColumn(joints, F.transform(joints, moved))


def scalar_feature(df: DataFrame, keys: list[str], ts: str, coords: list[str], valid: Column, feature: str) -> DataFrame:
    """Adds feature: one number per frame from a trajectory ('speed', 'energy', or the size of a vector one); 0 where not valid."""
    out = derivatives(df, keys, ts, coords, valid)
    if feature in ("speed", "energy"):
        return out.withColumn("feature", F.col(feature))
    names = coords if feature == "position" else [f"{c}_{feature}" for c in coords]
    missing = [n for n in names if n not in out.columns]
    if missing:
        raise ValueError(f"unknown feature {feature!r}")
    return out.withColumn("feature", F.sqrt(sum((F.col(n) ** 2 for n in names), F.lit(0.0))))


def window_feature(df: DataFrame, keys: list[str], order: str, column: str, length: int, standardise: bool = True, floor: float = 1e-5) -> DataFrame:
    """(keys, column): the window's samples resampled to `length`, then standardised; what is not a number becomes 0."""
    cells = F.array_sort(F.collect_list(F.struct(order, F.coalesce(F.col(column).cast("double"), F.lit(0.0)).alias("v"))))
    out = df.groupBy(*keys).agg(cells.alias("_c")).select(*keys, V.resample("_c.v", length).alias("_a"))
    if standardise:
        out = out.withColumn("_m", V.mean("_a"))
        spread = F.sqrt(V.mean(F.transform("_a", lambda x: (x - F.col("_m")) * (x - F.col("_m")))))
        out = out.withColumn("_s", F.greatest(spread, F.lit(floor))).withColumn("_a", F.transform("_a", lambda x: (x - F.col("_m")) / F.col("_s")))
    return out.select(*keys, F.transform("_a", lambda x: F.nanvl(x, F.lit(0.0))).alias(column))


# Sensor views, their channels and the channel groups that must be valid in a frame.
SENSOR_VIEWS = {
    "I0_acc": (("acc_x", "acc_y", "acc_z"), ("acc",)),
    "I1_acc_magnitude": (("acc_magnitude", "acc_magnitude_centered"), ("acc",)),
    "I2_acc_changes": (("acc_dx", "acc_dy", "acc_dz", "acc_change_energy"), ("acc",)),
    "I3_gyro": (("gyro_x", "gyro_y", "gyro_z"), ("gyro",)),
    "I4_delta_quaternion": (("quat_w", "quat_x", "quat_y", "quat_z", "angular_speed"), ("quat",)),
    "I5_acc_gyro": (("acc_x", "acc_y", "acc_z", "gyro_x", "gyro_y", "gyro_z"), ("acc", "gyro")),
    "I6_acc_quat": (("acc_x", "acc_y", "acc_z", "quat_w", "quat_x", "quat_y", "quat_z"), ("acc", "quat")),
    "I7_acc_gyro_quat": (("acc_x", "acc_y", "acc_z", "gyro_x", "gyro_y", "gyro_z", "quat_w", "quat_x", "quat_y", "quat_z"), ("acc", "gyro", "quat")),
}


def feature_manifest(df: DataFrame, keys: list[str], sensor_location: str, provenance: str) -> DataFrame:
    """(keys, view_id, channels, n_frames, n_channels, n_valid, sensor_location, provenance): each series' possible sensor views.

    A view needs all its channel groups in df; nothing but channels is read, so no label gets in. Null is not valid.
    """
    if not sensor_location.strip() or not provenance.strip():
        raise ValueError("sensor_location and provenance are required")
    groups = {"acc": "xyz", "gyro": "xyz", "quat": "wxyz"}
    have = {g: [f"{g}_{a}" for a in axes] for g, axes in groups.items() if all(f"{g}_{a}" in df.columns for a in axes)}
    if "acc" not in have:
        raise ValueError("the acceleration channels acc_x, acc_y, acc_z are required")

    def valid(group: str) -> Column:
        total = sum((F.col(c).cast("double") ** 2 for c in have[group]), F.lit(0.0))
        finite = total < float("inf")
        return F.coalesce(finite & (F.sqrt(total) > _EPS) if group == "quat" else finite, F.lit(False))

    views = {v: (channels, needs) for v, (channels, needs) in SENSOR_VIEWS.items() if all(g in have for g in needs)}
    counts = [F.count_if(reduce(Column.__and__, map(valid, needs))).alias(v) for v, (_, needs) in views.items()]
    rows = [F.struct(F.lit(v).alias("view_id"), F.array(*map(F.lit, channels)).alias("channels"), F.lit(len(channels)).alias("n_channels"), F.col(v).alias("n_valid")) for v, (channels, _) in views.items()]
    each = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_frames"), *counts)
    return each.select(*keys, "n_frames", F.explode(F.array(*rows)).alias("_v")).select(*keys, "_v.view_id", "_v.channels", "n_frames", "_v.n_channels", "_v.n_valid", F.lit(sensor_location).alias("sensor_location"), F.lit(provenance).alias("provenance"))
