"""Operators on ordered series: each takes the keys of a series and its order columns.

Everything is a window function over one partitioning of the keys, so several operators in a row share one
shuffle and sort.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def over(keys: list[str], order: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def derivatives(df: DataFrame, keys: list[str], ts: str, coords: list[str], valid: Column | None = None) -> DataFrame:
    """Adds displacement, velocity, acceleration and jerk of each coordinate (backward differences in seconds), speed and energy.

    A difference is valid if both samples are; what is not valid is 0. Displacement counts from the first
    valid sample.
    """
    w = over(keys, [ts])
    ok = F.coalesce(valid, F.lit(False)) if valid is not None else F.lit(True)
    for c in coords:
        ok = ok & F.coalesce(F.col(c).isNotNull() & ~F.isnan(c), F.lit(False))
    out = df.withColumn("valid", ok)
    for c in coords:
        out = out.withColumn(c, F.when(F.col("valid"), F.col(c)).otherwise(0.0))
        first = F.first(F.when(F.col("valid"), F.col(c)), ignorenulls=True).over(Window.partitionBy(*keys).orderBy(ts).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        out = out.withColumn(f"{c}_displacement", F.when(F.col("valid"), F.col(c) - first).otherwise(0.0))
    before = "valid"
    for order, name in enumerate(("velocity", "acceleration", "jerk")):
        mask = f"{name}_valid"
        out = out.withColumn(mask, F.coalesce(F.col(before) & F.lag(before).over(w) & (F.col(ts) > F.lag(ts).over(w)), F.lit(False)))
        for c in coords:
            source = c if order == 0 else f"{c}_{('velocity', 'acceleration')[order - 1]}"
            out = out.withColumn(f"{c}_{name}", F.when(F.col(mask), (F.col(source) - F.lag(source).over(w)) / (F.col(ts) - F.lag(ts).over(w))).otherwise(0.0))
        before = mask
    energy = sum((F.col(f"{c}_velocity") ** 2 for c in coords), F.lit(0.0))
    return out.withColumn("energy", energy).withColumn("speed", F.sqrt("energy"))


def diff_zero(df: DataFrame, keys: list[str], order: list[str], column: str, times: int = 1, name: str | None = None) -> DataFrame:
    """Difference to the sample before, the first 0, `times` times over."""
    name, w = name or f"{column}_diff{times}", over(keys, order)
    out = df.withColumn(name, F.col(column))
    for _ in range(times):
        out = out.withColumn(name, F.col(name) - F.lag(name, 1).over(w)).withColumn(name, F.coalesce(name, F.lit(0.0)))
    return out


def moving_average(df: DataFrame, keys: list[str], order: list[str], column: str, kernel: int, name: str | None = None) -> DataFrame:
    """Centred mean over `kernel` samples (odd); the first and last sample stand for what lies beyond the ends."""
    if kernel % 2 == 0:
        raise ValueError("the kernel must be odd")
    pad, w = kernel // 2, over(keys, order)
    whole = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place, size = F.row_number().over(w), F.count(F.lit(1)).over(whole)
    before, after = F.greatest(F.lit(0), pad - (place - 1)), F.greatest(F.lit(0), pad - (size - place))
    inside = F.sum(column).over(w.rowsBetween(-pad, pad))
    return df.withColumn(name or f"{column}_ma", (inside + before * F.first(column).over(whole) + after * F.last(column).over(whole)) / kernel)


def masked_moving_average(df: DataFrame, keys: list[str], order: list[str], column: str, valid: Column, width: int, name: str | None = None) -> DataFrame:
    """Centred mean of the valid samples; null with fewer than max(3, width // 2 + 1) of them."""
    w = over(keys, order).rowsBetween(-(width // 2), width // 2)
    shown = F.when(valid, F.col(column))
    return df.withColumn(name or f"{column}_ma", F.when(F.count(shown).over(w) >= max(3, width // 2 + 1), F.avg(shown).over(w)))


def with_runs(df: DataFrame, keys: list[str], order: list[str], mask: Column, name: str = "run") -> DataFrame:
    """Adds the number of the run of equal mask values that a row is in, from 1."""
    w = over(keys, order)
    return df.withColumn("_m", F.coalesce(mask, F.lit(False))).withColumn("_new", F.coalesce((F.col("_m") != F.lag("_m").over(w)).cast("int"), F.lit(1))).withColumn(name, F.sum("_new").over(w)).drop("_m", "_new")


def runs(df: DataFrame, keys: list[str], order: list[str], mask: Column) -> DataFrame:
    """(keys, run, length, first, last) of every run of true values; first and last by the first order column."""
    marked = with_runs(df, keys, order, mask).filter(mask)
    return marked.groupBy(*keys, "run").agg(F.count(F.lit(1)).alias("length"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))


def run_summary(df: DataFrame, keys: list[str], order: list[str], mask: Column) -> DataFrame:
    """Per series: samples, runs, longest run and where the first longest begins, fragmentation (runs - 1, at least 0)."""
    size = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    found = runs(df, keys, order, mask).groupBy(*keys).agg(F.count(F.lit(1)).alias("runs"), F.max("length").alias("longest"), F.max_by("first", F.struct("length", -F.col("run"))).alias("longest_first"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return size.join(found, keys, "left").select(*keys, "n", zero("runs"), zero("longest"), "longest_first", F.greatest(F.coalesce("runs", F.lit(0)) - 1, F.lit(0)).cast("long").alias("fragmentation"))


def unwrap(df: DataFrame, keys: list[str], order: list[str], angle: str, valid: Column, period: float = 2 * math.pi, name: str = "unwrapped") -> DataFrame:
    """Removes jumps of half a period or more; starts afresh in every valid run; null outside."""
    runs_of = with_runs(df, keys, order, valid, "_run")
    w = over([*keys, "_run"], order)
    step = F.col(angle) - F.lag(angle).over(w)
    half = period / 2
    wrapped = F.pmod(step + half, F.lit(period)) - half
    wrapped = F.when((wrapped == -half) & (step > 0), half).otherwise(wrapped)
    fix = F.when(F.abs(step) < half, 0.0).otherwise(wrapped - step)
    return runs_of.withColumn("_fix", F.coalesce(fix, F.lit(0.0))).withColumn(name, F.when(valid, F.col(angle) + F.sum("_fix").over(w))).drop("_fix", "_run")


def angle_rate(df: DataFrame, keys: list[str], order: str, angle: str, valid: Column, period: float = 2 * math.pi) -> DataFrame:
    """Adds rate (second-order differences on the uneven grid, one-sided at the ends of a valid run) and rate_valid."""
    flat = with_runs(unwrap(df, keys, [order], angle, valid, period, "_u"), keys, [order], valid, "_run")
    w = over([*keys, "_run"], [order])
    u, t = F.col("_u"), F.col(order)
    back, ahead = t - F.lag(order).over(w), F.lead(order).over(w) - t
    left, right = (u - F.lag("_u").over(w)) / back, (F.lead("_u").over(w) - u) / ahead
    middle = (left * ahead + right * back) / (ahead + back)
    rate = F.when(valid, F.coalesce(middle, left, right))
    return flat.withColumn("rate", rate).withColumn("rate_valid", F.col("rate").isNotNull()).withColumn("rate", F.coalesce("rate", F.lit(0.0))).drop("_u", "_run")


def quaternion_continuity(df: DataFrame, keys: list[str], order: list[str], quat: list[str], valid: Column | None = None) -> DataFrame:
    """Flips signs so that neighbours have no negative product; a product of zero or an invalid neighbour starts afresh.

    The sign is the parity of negative products since the last fresh start, so a running sum gives it.
    """
    w, valid = over(keys, order), F.lit(True) if valid is None else valid
    product = sum((F.col(q) * F.lag(q).over(w) for q in quat), F.lit(0.0))
    linked = valid & F.coalesce(F.lag(valid).over(w), F.lit(False)) & (product != 0)
    out = df.withColumn("_linked", F.coalesce(linked, F.lit(False))).withColumn("_neg", F.when(F.col("_linked") & (product < 0), 1).otherwise(0))
    out = out.withColumn("_start", F.sum((~F.col("_linked")).cast("int")).over(w))
    odd = F.sum("_neg").over(over([*keys, "_start"], order)) % 2 == 1
    out = out.withColumn("_odd", odd)
    return out.withColumns({q: F.when(F.col("_odd"), -F.col(q)).otherwise(F.col(q)) for q in quat}).drop("_linked", "_neg", "_start", "_odd")


def angular_speed(df: DataFrame, keys: list[str], order: list[str], quat: list[str], ts: str | None = None, name: str = "angular_speed") -> DataFrame:
    """2 * acos(|q[t] . q[t-1]|), by seconds if ts is given; 0 at the first sample."""
    w = over(keys, order)
    product = F.least(F.lit(1.0), F.abs(sum((F.col(q) * F.lag(q).over(w) for q in quat), F.lit(0.0))))
    angle = 2 * F.acos(product)
    return df.withColumn(name, F.coalesce(angle / (F.col(ts) - F.lag(ts).over(w)) if ts else angle, F.lit(0.0)))


def fill_forward_back(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Nulls take the last value before them, else the first after them."""
    w = over(keys, order)
    back = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ahead = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(ahead), F.first(c, ignorenulls=True).over(back)) for c in columns})


def nearest_valid_fill(df: DataFrame, keys: list[str], place: str, columns: list[str], valid: Column, default: dict | None = None) -> DataFrame:
    """Rows that aren't valid take the columns of the nearest valid one, the earlier of two; `default` where none is."""
    w = over(keys, [place])
    kept = F.when(valid, F.struct(F.col(place).alias("_p"), *columns))
    before = F.last(kept, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first(kept, ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    out = df.withColumn("_b", before).withColumn("_a", after)
    near = F.when(F.col("_a").isNull() | (F.col(place) - F.col("_b._p") <= F.col("_a._p") - F.col(place)), F.col("_b")).otherwise(F.col("_a"))
    out = out.withColumn("_near", near)
    return out.withColumns({c: F.coalesce(F.col(f"_near.{c}"), F.lit((default or {}).get(c))) for c in columns}).drop("_a", "_b", "_near")


def transition_count(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """(keys, transitions): how often the value differs from the one before."""
    changed = F.coalesce((F.col(value) != F.lag(value).over(over(keys, order))).cast("int"), F.lit(0))
    return df.withColumn("_c", changed).groupBy(*keys).agg(F.sum("_c").alias("transitions"))


def zscore(df: DataFrame, keys: list[str], columns: list[str], floor: float = 1e-5) -> DataFrame:
    """Centred and divided by the population deviation of the series, with a floor."""
    w = Window.partitionBy(*keys)
    return df.withColumns({f"{c}_z": (F.col(c) - F.avg(c).over(w)) / F.greatest(F.stddev_pop(c).over(w), F.lit(floor)) for c in columns})


def lag_correlation(df: DataFrame, keys: list[str], order: list[str], a: str, b: str, max_lag: int, min_samples: int = 5, on_constant: float | None = None) -> DataFrame:
    """(keys, lag, n, corr): Pearson of a[t + lag] with b[t]; null with too few samples, `on_constant` without variance."""
    w = over(keys, order)
    pairs = F.array(*(F.struct(F.lit(lag).alias("lag"), (F.lag(a, -lag) if lag < 0 else F.lead(a, lag)).over(w).alias("x")) for lag in range(-max_lag, max_lag + 1)))
    each = df.withColumn("_pairs", pairs).select(*keys, F.col(b).cast("double").alias("y"), F.explode("_pairs").alias("_p")).select(*keys, "y", "_p.lag", F.col("_p.x").cast("double").alias("x")).filter("x is not null and y is not null")
    sums = each.groupBy(*keys, "lag").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("y") * F.col("y")).alias("syy"), F.sum(F.col("x") * F.col("y")).alias("sxy"))
    vx, vy = F.col("n") * F.col("sxx") - F.col("sx") ** 2, F.col("n") * F.col("syy") - F.col("sy") ** 2
    flat = (vx <= 1e-12 * F.greatest(F.col("n") * F.col("sxx"), F.lit(1e-30))) | (vy <= 1e-12 * F.greatest(F.col("n") * F.col("syy"), F.lit(1e-30)))
    corr = F.when(F.col("n") < min_samples, None).when(flat, F.lit(on_constant).cast("double")).otherwise((F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / (F.sqrt(F.greatest(vx, F.lit(1e-300))) * F.sqrt(F.greatest(vy, F.lit(1e-300)))))
    return sums.select(*keys, "lag", "n", corr.alias("corr"))


def best_lag(correlations: DataFrame, keys: list[str], by: str = "abs") -> DataFrame:
    """(keys, best_lag, best_corr): largest by 'abs' or 'max'; of equals the lag nearest 0, the smaller one first."""
    size = F.abs("corr") if by == "abs" else F.col("corr")
    order = F.struct(F.round(size, 9), -F.abs("lag"), -F.col("lag"))
    return correlations.filter("corr is not null").groupBy(*keys).agg(F.max_by(F.struct("lag", "corr"), order).alias("_b")).select(*keys, F.col("_b.lag").alias("best_lag"), F.col("_b.corr").alias("best_corr"))


def ordered(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Each series as arrays of its columns in order: for series bounded by a recording's length."""
    cell = F.array_sort(F.collect_list(F.struct(*order, *columns)))
    return df.groupBy(*keys).agg(cell.alias("_c")).select(*keys, *(F.col(f"_c.{c}").alias(c) for c in columns))


def imu_activity(df: DataFrame, keys: list[str], order: list[str], acc: tuple[str, str, str]) -> DataFrame:
    """Per series: mean, deviation and energy of the acceleration's size, size of its second difference, mean of absolutes."""
    w = over(keys, order)
    size = F.sqrt(sum((F.col(c) ** 2 for c in acc), F.lit(0.0)))
    second = F.sqrt(sum(((F.col(c) - 2 * F.lag(c, 1).over(w) + F.lag(c, 2).over(w)) ** 2 for c in acc), F.lit(0.0)))
    each = df.withColumn("_s", size).withColumn("_j", second).withColumn("_abs", sum((F.abs(c) for c in acc), F.lit(0.0)) / 3)
    return each.groupBy(*keys).agg(F.avg("_s").alias("acc_mean"), F.stddev_pop("_s").alias("acc_std"), F.avg(F.col("_s") ** 2).alias("acc_energy"), F.coalesce(F.avg("_j"), F.lit(0.0)).alias("acc_jerk_energy"), F.avg("_abs").alias("acc_abs_mean"))


def activity_ratios(df: DataFrame, keys: list[str], time: str, speed: str, floor: float = 0.75) -> DataFrame:
    """Per series of joint speeds: share above the series' own quantile, and share of times when half the joints are."""
    limits = df.groupBy(*keys).agg(F.percentile(speed, floor).alias("_q"), F.avg(speed).alias("motion_energy"), F.max(speed).alias("max_speed"))
    marked = df.join(limits, keys).withColumn("_on", (F.col(speed) > F.col("_q")).cast("double"))
    frame = marked.groupBy(*keys, time).agg(F.avg("_on").alias("_share"), F.first("motion_energy").alias("motion_energy"), F.first("max_speed").alias("max_speed"), F.count(F.lit(1)).alias("_n"))
    return frame.groupBy(*keys).agg(F.first("motion_energy").alias("motion_energy"), F.first("max_speed").alias("max_speed"), (F.sum(F.col("_share") * F.col("_n")) / F.sum("_n")).alias("active_ratio"), F.avg((F.col("_share") >= 0.5).cast("double")).alias("simultaneous_ratio"))


def imu_sequence_features(df: DataFrame, keys: list[str], order: list[str], acc: list[str], quat: list[str], kernel: int = 5, dynamic: bool = True) -> DataFrame:
    """Smoothed channels, unit quaternion; dynamic adds centred and differenced acceleration and angular speed."""
    out = df
    for c in [*acc, *quat]:
        out = moving_average(out, keys, order, c, kernel, c)
    size = F.greatest(F.sqrt(sum((F.col(q) ** 2 for q in quat), F.lit(0.0))), F.lit(1e-8))
    out = out.withColumn("_size", size).withColumns({q: F.col(q) / F.col("_size") for q in quat}).drop("_size")
    if not dynamic:
        return out
    w = Window.partitionBy(*keys)
    out = out.withColumns({f"{c}_centered": F.col(c) - F.avg(c).over(w) for c in acc})
    for c in acc:
        out = diff_zero(out, keys, order, c, 1, f"{c}_delta")
    return angular_speed(out, keys, order, quat)


def imu_views(df: DataFrame, keys: list[str], ts: str, have_gyro: bool = True, have_quat: bool = True) -> DataFrame:
    """Adds the views that the channels allow: size and change of acceleration, unit quaternion with angular speed.

    acc_magnitude_centered is centred on the series' mean; gyro and quaternion views need their channels.
    """
    acc, quat, gyro = [f"acc_{a}" for a in "xyz"], [f"quat_{a}" for a in "wxyz"], [f"gyro_{a}" for a in "xyz"]
    w, whole = over(keys, [ts]), Window.partitionBy(*keys)
    out = df.withColumn("acc_magnitude", F.sqrt(sum((F.col(c) ** 2 for c in acc), F.lit(0.0))))
    out = out.withColumn("acc_magnitude_centered", F.col("acc_magnitude") - F.avg("acc_magnitude").over(whole))
    dt = F.col(ts) - F.lag(ts).over(w)
    out = out.withColumns({f"acc_d{c[-1]}": F.coalesce((F.col(c) - F.lag(c).over(w)) / dt, F.lit(0.0)) for c in acc})
    out = out.withColumn("acc_change_energy", sum((F.col(f"acc_d{a}") ** 2 for a in "xyz"), F.lit(0.0)))
    if have_quat:
        size = F.sqrt(sum((F.col(q) ** 2 for q in quat), F.lit(0.0)))
        out = out.withColumn("_size", size).withColumn("quat_valid", F.col("_size") > 1e-8)
        out = out.withColumns({q: F.when(F.col("quat_valid"), F.col(q) / F.col("_size")).otherwise(0.0) for q in quat}).drop("_size")
        both = F.coalesce(F.col("quat_valid") & F.lag("quat_valid").over(w), F.lit(False))
        out = angular_speed(out, keys, [ts], quat, ts).withColumn("angular_speed", F.when(both, F.col("angular_speed")).otherwise(0.0))
    if have_gyro:
        out = out.withColumn("gyro_valid", F.lit(True))
        for c in gyro:
            out = out.withColumn("gyro_valid", F.col("gyro_valid") & F.col(c).isNotNull() & ~F.isnan(c))
    return out
