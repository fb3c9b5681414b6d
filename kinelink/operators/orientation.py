"""Heading of a body over time: tracks of angle, rate and reasons, and the five-channel stream made of them."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelink.functions import layouts as L
from kinelink.functions import pose as P
from kinelink.functions import quaternions as Q
from kinelink.functions.vectors import resample
from kinelink.operators.series import angle_rate, lag_correlation, masked_moving_average, ordered


def _track(df: DataFrame, keys: list[str], ts: str, period: float) -> DataFrame:
    """Completes angle, valid and reason: sine and cosine of the angle (doubled for a line), rate and its validity."""
    rated = angle_rate(df, keys, ts, "angle", F.col("valid"), period)
    turn = F.col("angle") * (2 if period == math.pi else 1)
    shown = lambda c: F.when(F.col("valid"), c).otherwise(0.0)
    return rated.withColumn("angle_sin", shown(F.sin(turn))).withColumn("angle_cos", shown(F.cos(turn))).withColumn("angle", shown(F.col("angle")))


def torso_proxy_2d(df: DataFrame, keys: list[str], ts: str, joints: str, visible: str, names: Sequence[str] = L.H36M17, floor: float = 1e-6) -> DataFrame:
    """Angle of the line through the shoulders: a line has no front, so the period is pi."""
    left, right = L.required(names, "left_shoulder"), L.required(names, "right_shoulder")
    seen = F.get(visible, F.lit(left)) & F.get(visible, F.lit(right))
    axis = P.minus(P.joint(joints, right), P.joint(joints, left))
    long = F.sqrt(axis["x"] ** 2 + axis["y"] ** 2) > floor
    out = df.withColumn("valid", seen & long).withColumn("angle", F.atan2(axis["y"], axis["x"])).withColumn("reason", F.when(~seen, "missing_shoulder").when(~long, "degenerate_shoulder_axis").otherwise(""))
    return _track(out, keys, ts, math.pi)


def torso_heading_3d(df: DataFrame, keys: list[str], ts: str, joints: str, visible: str, names: Sequence[str] = L.H36M17, up_axis: int = 1, lateral_first: bool = True, floor: float = 1e-6) -> DataFrame:
    """Heading of the body's front: the product of the shoulder line and the spine, projected along the up axis.

    Later reasons win where several hold. A front along the up axis makes the row invalid without a reason of its own.
    """
    i = {n: L.required(names, n) for n in ("left_shoulder", "right_shoulder", "pelvis", "thorax")}
    seen = {n: F.get(visible, F.lit(k)) for n, k in i.items()}
    shoulders, spine = seen["left_shoulder"] & seen["right_shoulder"], seen["pelvis"] & seen["thorax"]
    lateral, up = P.minus(P.joint(joints, i["right_shoulder"]), P.joint(joints, i["left_shoulder"])), P.minus(P.joint(joints, i["thorax"]), P.joint(joints, i["pelvis"]))
    out = df.withColumn("_l", lateral).withColumn("_u", up)
    unit = lambda c: P.times(F.col(c), 1 / F.greatest(P.length(F.col(c)), F.lit(floor)))
    out = out.withColumn("_lv", P.length(F.col("_l")) > floor).withColumn("_uv", P.length(F.col("_u")) > floor).withColumn("_l", unit("_l")).withColumn("_u", unit("_u"))
    out = out.withColumn("_f", P.cross(F.col("_l"), F.col("_u")) if lateral_first else P.cross(F.col("_u"), F.col("_l")))
    out = out.withColumn("_fv", F.col("_lv") & F.col("_uv") & (P.length(F.col("_f")) > floor)).withColumn("_f", unit("_f"))
    a, b = (n for k, n in enumerate("xyz") if k != up_axis)
    flat = F.sqrt(F.col(f"_f.{a}") ** 2 + F.col(f"_f.{b}") ** 2) > floor
    reason = F.when(~F.col("_fv"), "degenerate_forward").when(spine & ~F.col("_uv"), "degenerate_up").when(shoulders & ~F.col("_lv"), "degenerate_lateral").when(~spine, "missing_pelvis_thorax").when(~shoulders, "missing_shoulders").otherwise("")
    out = out.withColumn("valid", shoulders & spine & F.col("_lv") & F.col("_uv") & F.col("_fv") & flat).withColumn("angle", F.atan2(F.col(f"_f.{b}"), F.col(f"_f.{a}"))).withColumn("direction", F.col("_f")).withColumn("reason", reason)
    return _track(out.drop("_l", "_u", "_lv", "_uv", "_f", "_fv"), keys, ts, 2 * math.pi)


def root_orientation(df: DataFrame, keys: list[str], ts: str, rotation: str, kind: str = "quaternion", forward: int = 2, sign: float = 1.0, up_axis: int = 1, floor: float = 1e-6) -> DataFrame:
    """Heading from a root rotation: arrays w, x, y, z or an axis with its angle as length. Adds the matrix's first two columns."""
    if kind not in ("quaternion", "axis_angle"):
        raise ValueError("kind is 'quaternion' or 'axis_angle'")
    unit = Q.normalize(rotation)
    matrix = Q.to_matrix(unit) if kind == "quaternion" else Q.axis_angle_to_matrix(rotation)
    out = df.withColumn("_m", matrix)
    at = lambda r: sign * F.get("_m", F.lit(3 * r + forward))
    a, b = (k for k in range(3) if k != up_axis)
    valid = F.coalesce(F.col("_m").isNotNull() & (F.sqrt(at(a) ** 2 + at(b) ** 2) > floor), F.lit(False))
    six = F.array(*(F.get("_m", F.lit(3 * r + c)) for r in range(3) for c in range(2)))
    out = out.withColumn("valid", valid).withColumn("angle", F.coalesce(F.atan2(at(b), at(a)), F.lit(0.0))).withColumn("orientation_6d", F.when(valid, six).otherwise(F.array_repeat(F.lit(0.0), 6))).withColumn("reason", F.when(valid, "").otherwise("horizontal_projection_degenerate")).drop("_m")
    return _track(out, keys, ts, 2 * math.pi)


def orientation_stream(track: DataFrame, keys: list[str], order: str, size: int, rate_scale: float = 5.0, rate_only: bool = False) -> DataFrame:
    """(keys, stream): sine, cosine, clipped rate, validity and activity of a window, resampled to `size` samples.

    Validity and activity are 0 or 1 after resampling: activity means at least half the rate scale.
    """
    rate = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("rate") / rate_scale))
    shown = lambda c: F.when(F.col("valid"), c).otherwise(0.0)
    zero = F.lit(0.0)
    cells = track.select(*keys, order, (zero if rate_only else shown(F.col("angle_sin"))).alias("c0"), (zero if rate_only else shown(F.col("angle_cos"))).alias("c1"), shown(rate).alias("c2"), F.col("valid").cast("double").alias("c3"), F.when(F.col("rate_valid"), F.abs(rate)).otherwise(0.0).alias("c4"))
    whole = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, "c0", "c1", "c2", "c3", "c4"))).alias("_c"))

    def channel(k: int) -> Column:
        out = resample(F.col(f"_c.c{k}"), size)
        return F.transform(out, lambda v: (v >= 0.5).cast("double")) if k > 2 else out

    return whole.select(*keys, F.array(*(channel(k) for k in range(5))).alias("stream"))


def turning_counts(streams: DataFrame, group: list[str]) -> DataFrame:
    """(group, turning_count): active samples over a group's rows."""
    active = F.aggregate(F.get("stream", F.lit(4)), F.lit(0.0), lambda s, v: s + v)
    return streams.groupBy(*group).agg(F.sum(F.round(active)).cast("long").alias("turning_count"))


__all__ = ["orientation_stream", "root_orientation", "torso_heading_3d", "torso_proxy_2d", "turning_counts"]


def gyro_association(rows: DataFrame, keys: list[str], order: str, rate: str, gyro: list[str], valid: Column, width: int, max_lag: int) -> DataFrame:
    """Per series how a rotation rate goes with each gyro axis: frames, valid frames, the best axis and its Pearson raw, smoothed and over lags.

    The best is that of the largest absolute value, of equals the later axis (and lag). Smoothing is a masked mean of
    `width` frames. Null where no axis has five valid samples and variance.
    """
    known = rows.withColumn("_ok", F.coalesce(valid, F.lit(False)))
    each = known.select(*keys, order, rate, "_ok", F.posexplode(F.array(*(F.col(c).cast("double") for c in gyro))).alias("axis", "_g"))
    by = [*keys, "axis"]
    raw = lag_correlation(each.withColumns({"_x": F.when(F.col("_ok"), F.col(rate)), "_y": F.when(F.col("_ok"), F.col("_g"))}), by, [order], "_x", "_y", 0)
    smooth = masked_moving_average(masked_moving_average(each, by, [order], rate, F.col("_ok"), width, "_x"), by, [order], "_g", F.col("_ok"), width, "_y")
    lags = lag_correlation(smooth, by, [order], "_x", "_y", max_lag)
    best = lambda df, what: df.filter("corr is not null").groupBy(*keys).agg(F.max_by(F.struct(*what), F.struct(F.round(F.abs("corr"), 9), *what[1:])).alias("_b"))
    one = best(raw, ["corr", "axis"]).select(*keys, F.col("_b.corr").alias("raw_r"), F.col("_b.axis").alias("raw_axis"))
    two = best(lags.filter("lag = 0"), ["corr", "axis"]).select(*keys, F.col("_b.corr").alias("smooth_r"), F.col("_b.axis").alias("smooth_axis"))
    three = best(lags, ["corr", "lag", "axis"]).select(*keys, F.col("_b.corr").alias("lag_r"), F.col("_b.lag").alias("lag_frames"), F.col("_b.axis").alias("lag_axis"))
    sizes = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("frames"), F.count_if("_ok").alias("valid_frames"))
    return sizes.join(one, keys, "left").join(two, keys, "left").join(three, keys, "left")


def orientation_gyro_summary(associations: DataFrame, kind: str, axes: int = 3) -> DataFrame:
    """Per kind of pairing: series, medians of the absolute best correlations and of the lag, and how often each axis is best.

    A shuffled pairing goes through the same best-of-three rule, so its medians are what chance gives.
    """
    histogram = F.array(*(F.count_if(F.col("raw_axis") == a) for a in range(axes)))
    medians = [F.median(F.abs(c)).alias(f"median_{c}") for c in ("raw_r", "smooth_r", "lag_r")]
    return associations.groupBy(kind).agg(F.count(F.lit(1)).alias("series"), *medians, F.median("lag_frames").alias("median_lag_frames"), histogram.alias("axis_histogram"))


def _turning(rows: DataFrame, rate: str, gyro: list[str], valid: Column) -> DataFrame:
    """Adds the sizes _x of the rate and _y of the gyro (null if any axis is not finite) and whether both count."""
    axes = [F.col(c).cast("double") for c in gyro]
    finite = F.lit(True)
    for axis in axes:
        finite = finite & axis.isNotNull() & ~F.isnan(axis) & (F.abs(axis) < float("inf"))
    size = F.sqrt(sum((a * a for a in axes), F.lit(0.0)))
    marked = rows.withColumns({"_x": F.abs(F.col(rate).cast("double")), "_y": F.when(finite, size), "_ok": F.coalesce(valid & finite, F.lit(False))})
    return marked.withColumn("_ok", F.col("_ok") & F.col("_x").isNotNull() & ~F.isnan("_x"))


def motion_strata(rows: DataFrame, keys: list[str], rate: str, gyro: list[str], valid: Column, low: float = 0.5, high: float = 0.9, least: int = 5) -> DataFrame:
    """(keys, stratum, frames, corr): how the size of a rate goes with that of the gyro where a series moves little and much.

    'low' holds the valid frames up to the series' quantile `low` of the gyro's size, 'high' those from the quantile `high` on. corr is
    null below `least` frames or without variance.
    """
    known = _turning(rows, rate, gyro, valid).filter("_ok")
    cuts = known.groupBy(*keys).agg(F.percentile("_y", low).alias("_low"), F.percentile("_y", high).alias("_high"))
    strata = F.array(F.when(F.col("_y") <= F.col("_low"), F.lit("low")), F.when(F.col("_y") >= F.col("_high"), F.lit("high")))
    each = known.join(cuts, keys).withColumn("stratum", F.explode(F.array_compact(strata)))
    varied = (F.stddev_pop("_x") > 1e-12) & (F.stddev_pop("_y") > 1e-12)
    return each.groupBy(*keys, "stratum").agg(F.count(F.lit(1)).alias("frames"), F.when((F.count(F.lit(1)) >= least) & varied, F.try_divide(F.covar_pop("_x", "_y"), F.stddev_pop("_x") * F.stddev_pop("_y"))).alias("corr"))


def time_shuffle_null(rows: DataFrame, keys: list[str], order: str, rate: str, gyro: list[str], valid: Column, trials: int = 16, seed: int = 0, quantile: float = 0.95, least: int = 5) -> DataFrame:
    """(keys, trials, abs_r, abs_r_null): the correlation of the sizes of rate and gyro, and what chance gives when the gyro's frames are shuffled.

    Every trial puts the gyro's frames of a series in the order of a digest of seed, trial and frame, and pairs them with the rate's frames
    in time; abs_r_null is that quantile of the trials' absolute correlations. A shuffle is a sort of one recording's array, so
    all trials take one pass and no join. Nulls as in `motion_strata`; a frame whose gyro is not finite counts in no pair.
    """
    series = ordered(_turning(rows, rate, gyro, valid), keys, [order], ["_x", "_y", "_ok"])

    def pearson(y: Column) -> Column:
        pairs = F.filter(F.arrays_zip(F.col("_x").alias("x"), y.alias("y"), F.col("_ok").alias("ok")), lambda p: p["ok"] & p["y"].isNotNull())
        mean = lambda f: F.try_divide(F.aggregate(pairs, F.lit(0.0), lambda s, p: s + f(p)), F.size(pairs))
        mx, my = mean(lambda p: p["x"]), mean(lambda p: p["y"])
        xx, yy = mean(lambda p: p["x"] * p["x"]) - mx * mx, mean(lambda p: p["y"] * p["y"]) - my * my
        return F.when((F.size(pairs) >= least) & (xx > 1e-12) & (yy > 1e-12), F.try_divide(mean(lambda p: p["x"] * p["y"]) - mx * my, F.sqrt(xx * yy)))

    def shuffled(trial: Column) -> Column:
        digest = lambda i: F.md5(F.concat_ws(":", F.lit(seed).cast("string"), trial.cast("string"), i.cast("string")))
        return F.transform(F.array_sort(F.transform("_y", lambda y, i: F.struct(digest(i).alias("h"), y.alias("y")))), lambda s: s["y"])

    drawn = series.select(*keys, F.abs(pearson(F.col("_y"))).alias("abs_r"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(trials - 1)), lambda t: F.abs(pearson(shuffled(t))))).alias("_r"))
    return drawn.groupBy(*keys).agg(F.count("_r").alias("trials"), F.first("abs_r").alias("abs_r"), F.percentile("_r", quantile).alias("abs_r_null"))
