"""Joins: boxes, times, persons, tracks, strata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelink.operators.assignment import assign_by_size


def iou(a: str, b: str, clamp: bool = True) -> Column:
    """Overlap of two boxes (struct x1, y1, x2, y2) by their union; 0 for an empty union."""
    width = F.greatest(F.lit(0.0), F.least(f"{a}.x2", f"{b}.x2") - F.greatest(f"{a}.x1", f"{b}.x1"))
    height = F.greatest(F.lit(0.0), F.least(f"{a}.y2", f"{b}.y2") - F.greatest(f"{a}.y1", f"{b}.y1"))
    side = lambda n: (F.col(f"{n}.x2") - F.col(f"{n}.x1"), F.col(f"{n}.y2") - F.col(f"{n}.y1"))
    area = lambda n: F.greatest(F.lit(0.0), side(n)[0]) * F.greatest(F.lit(0.0), side(n)[1]) if clamp else side(n)[0] * side(n)[1]
    union = area(a) + area(b) - width * height
    return F.when(union > 0, F.try_divide(width * height, union)).otherwise(0.0)


def box_scores(gt: DataFrame, det: DataFrame, frame: list[str]) -> DataFrame:
    """(frame, gt_idx, track_idx, iou) of every pair of a frame."""
    a = gt.select(*frame, "gt_idx", F.col("bbox").alias("_a"))
    b = det.select(*frame, "track_idx", F.col("bbox").alias("_b"))
    return a.join(b, frame).select(*frame, "gt_idx", "track_idx", iou("_a", "_b").alias("iou"))


def match_boxes_argmax(gt: DataFrame, det: DataFrame, frame: list[str]) -> DataFrame:
    """Best track of each box with overlap above 0, lowest index of equals; two boxes may share a track."""
    best = box_scores(gt, det, frame).filter("iou > 0").groupBy(*frame, "gt_idx").agg(F.max_by(F.struct("track_idx", "iou"), F.struct("iou", -F.col("track_idx"))).alias("_b"))
    return best.select(*frame, "gt_idx", F.col("_b.track_idx").alias("track_idx"), F.col("_b.iou").alias("iou"))


def match_boxes_hungarian(gt: DataFrame, det: DataFrame, frame: list[str], min_iou: float = 0.1) -> DataFrame:
    """One-to-one by the best total overlap of a frame; weak pairs go after solving.

    Boxes that don't overlap are no pair. Of equal totals the one counts that gives the first track the first box, then the second track, and so on.
    """
    solved = assign_by_size(box_scores(gt, det, frame), frame, "track_idx", "gt_idx", "iou", zero_is_none=True)
    return solved.filter(F.col("gt_idx").isNotNull() & (F.col("iou") >= min_iou)).select(*frame, "gt_idx", "track_idx", "iou")


def match_boxes_exclusive(gt: DataFrame, det: DataFrame, frame: list[str]) -> DataFrame:
    """Tracks in order of id take the best person left, visible ones first; an overlap of 0 will do.

    A fold over one frame's boxes; gt carries visible.
    """
    people = gt.groupBy(*frame).agg(F.array_sort(F.collect_list(F.struct("gt_idx", "visible", "bbox"))).alias("_g"))
    tracks = det.groupBy(*frame).agg(F.array_sort(F.collect_list(F.struct("track_idx", "bbox"))).alias("_t"))
    both = tracks.join(people, frame)

    def overlap(g: Column, t: Column) -> Column:
        w = F.greatest(F.lit(0.0), F.least(g["bbox"]["x2"], t["bbox"]["x2"]) - F.greatest(g["bbox"]["x1"], t["bbox"]["x1"]))
        h = F.greatest(F.lit(0.0), F.least(g["bbox"]["y2"], t["bbox"]["y2"]) - F.greatest(g["bbox"]["y1"], t["bbox"]["y1"]))
        size = lambda x: F.greatest(F.lit(0.0), x["bbox"]["x2"] - x["bbox"]["x1"]) * F.greatest(F.lit(0.0), x["bbox"]["y2"] - x["bbox"]["y1"])
        return F.coalesce(F.try_divide(w * h, size(g) + size(t) - w * h), F.lit(0.0))

    def step(state: Column, t: Column) -> Column:
        free = F.filter("_g", lambda g: ~F.array_contains(state["used"], g["gt_idx"]))
        seen = F.filter(free, lambda g: g["visible"])
        pool = F.when(F.size(seen) > 0, seen).otherwise(free)
        best = F.array_max(F.transform(pool, lambda g: F.struct(overlap(g, t).alias("iou"), (-g["gt_idx"]).cast("long").alias("neg"))))
        pick = F.struct(t["track_idx"].cast("long").alias("track_idx"), (-best["neg"]).alias("gt_idx"), best["iou"].alias("iou"))
        return F.when(F.size(free) == 0, state).otherwise(F.struct(F.array_append(state["used"], (-best["neg"])).alias("used"), F.array_append(state["out"], pick).alias("out")))

    start = F.expr("named_struct('used', cast(array() as array<bigint>), 'out', cast(array() as array<struct<track_idx:bigint,gt_idx:bigint,iou:double>>))")
    return both.select(*frame, F.explode(F.aggregate("_t", start, step, lambda s: s["out"])).alias("_o")).select(*frame, "_o.gt_idx", "_o.track_idx", "_o.iou")


def interpolate_join(samples: DataFrame, targets: DataFrame, keys: list[str], ts: str, values: list[str], edge: str = "null") -> DataFrame:
    """Linear values at the targets' times, from the samples before and after in one union and sort.

    edge: 'null' outside the samples, 'zero' for 0 there, 'clamp' for the nearest sample. A target at a sample's
    time takes the sample; nulls in a channel are not interpolated across, and of samples of one time the last counts.
    """
    if edge not in ("null", "zero", "clamp"):
        raise ValueError(f"edge is 'null', 'zero' or 'clamp', not {edge!r}")
    extra = [c for c in targets.columns if c not in (*keys, ts)]
    s = samples.select(*keys, ts, F.struct(ts, *values).alias("_s"), F.lit(0).alias("_t"), *(F.lit(None).cast(targets.schema[c].dataType).alias(c) for c in extra))
    t = targets.select(*keys, ts, F.lit(None).cast(s.schema["_s"].dataType).alias("_s"), F.lit(1).alias("_t"), *extra)
    w = Window.partitionBy(*keys).orderBy(ts, "_t")
    both = s.unionByName(t)
    both = both.withColumn("_b", F.last("_s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    both = both.withColumn("_a", F.first("_s", ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))).filter("_t = 1")

    def value(c: str) -> Column:
        b, a, at = F.col(f"_b.{c}"), F.col(f"_a.{c}"), F.col(ts)
        share = F.try_divide(at - F.col(f"_b.{ts}"), F.col(f"_a.{ts}") - F.col(f"_b.{ts}"))
        inner = F.when(F.col(f"_b.{ts}") == at, b).when(F.col("_b").isNotNull() & F.col("_a").isNotNull(), b + (a - b) * share)
        outside = {"null": F.lit(None).cast("double"), "zero": F.lit(0.0), "clamp": F.coalesce(b, a)}[edge]
        return F.when((F.col(f"_b.{ts}") == at) | (F.col("_b").isNotNull() & F.col("_a").isNotNull()), inner).otherwise(outside).alias(c)

    return both.select(*keys, ts, *extra, *(value(c) for c in values))


def nearest_join(frames: DataFrame, centers: DataFrame, keys: list[str], at: str, center: str, payload: list[str]) -> DataFrame:
    """Each frame with the payload of the nearest centre, the earlier of two; null without a centre."""
    extra = [c for c in frames.columns if c not in (*keys, at)]
    c = centers.select(*keys, F.col(center).alias("_at"), F.struct(F.col(center).alias("_c"), *payload).alias("_s"), F.lit(0).alias("_f"), *(F.lit(None).cast(frames.schema[x].dataType).alias(x) for x in extra))
    f = frames.select(*keys, F.col(at).alias("_at"), F.lit(None).cast(c.schema["_s"].dataType).alias("_s"), F.lit(1).alias("_f"), *extra)
    w = Window.partitionBy(*keys).orderBy("_at", "_f")
    both = c.unionByName(f)
    both = both.withColumn("_b", F.last("_s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    both = both.withColumn("_a", F.first("_s", ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))).filter("_f = 1")
    near = F.when(F.col("_a").isNull() | (F.col("_at") - F.col("_b._c") <= F.col("_a._c") - F.col("_at")), F.col("_b")).otherwise(F.col("_a"))
    return both.withColumn("_n", near).select(*keys, F.col("_at").alias(at), *extra, *(F.col(f"_n.{p}").alias(p) for p in payload))


def near_in_time(left: DataFrame, right: DataFrame, keys: list[str], at: str, identity: str, gap: float) -> DataFrame:
    """Left rows for which another identity of the same keys lies within the gap: a semi join on time buckets."""
    bucket = F.floor(F.col(at) / F.lit(float(max(gap, 1e-9)))).cast("long")
    a = left.withColumn("_k", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    b = right.select(*keys, F.col(at).alias("_at"), F.col(identity).alias("_id"), bucket.alias("_k"))
    hit = a.join(b, [*keys, "_k"]).filter((F.abs(F.col(at) - F.col("_at")) <= gap) & (F.col(identity) != F.col("_id")))
    return left.join(hit.select(*keys, identity).distinct(), [*keys, identity], "left_semi")


def gap_pairs(ends: DataFrame, starts: DataFrame, keys: list[str], max_gap: int) -> DataFrame:
    """Pairs with 1 <= start - end <= max_gap: ends(keys, end, ...), starts(keys, start, ...), met in buckets of the gap's size."""
    a = ends.withColumn("_k", F.explode(F.array(F.floor(F.col("end") / max_gap).cast("long"), F.floor(F.col("end") / max_gap).cast("long") + 1)))
    b = starts.withColumn("_k", F.floor(F.col("start") / max_gap).cast("long"))
    return a.join(b, [*keys, "_k"]).filter((F.col("start") - F.col("end")).between(1, max_gap)).drop("_k")


def missing_refs(rows: DataFrame, files: DataFrame, on: str) -> DataFrame:
    return rows.join(files.select(on).distinct(), on, "left_anti")


def split_overlap(rows: DataFrame, field: str, split: str = "split") -> DataFrame:
    """(value, splits) of values that stand in several splits; blanks don't count."""
    value = F.nullif(F.trim(F.col(field).cast("string")), F.lit(""))
    return rows.select(value.alias("value"), split).filter("value is not null").groupBy("value").agg(F.array_sort(F.collect_set(split)).alias("splits")).filter(F.size("splits") > 1)


def mapped_skeleton(windows: DataFrame, gt_map: DataFrame, tracks: DataFrame, keys: list[str], joints: int = 17) -> DataFrame:
    """Each person and frame with the joints of its track; zero joints where there is none."""
    zero = F.array_repeat(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z")), joints)
    return windows.join(gt_map, [*keys, "frame_idx", "person_idx"], "left").join(tracks, [*keys, "frame_idx", "track_idx"], "left").withColumn("tracked", F.col("joints").isNotNull()).withColumn("joints", F.coalesce("joints", zero))


def device_to_person(devices: DataFrame, mapping: DataFrame, people: DataFrame, keys: list[str], file: str = "file") -> DataFrame:
    """Adds person_idx: mapped devices first, the others take the free persons in order of file name."""
    known = devices.join(mapping.select(*keys, "device", "person_idx"), [*keys, "device"], "left")
    free = people.join(known.filter("person_idx is not null").select(*keys, "person_idx"), [*keys, "person_idx"], "left_anti")
    slot = free.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("person_idx"))).withColumnRenamed("person_idx", "_person")
    rest = known.filter("person_idx is null").drop("person_idx").withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(file)))
    return known.filter("person_idx is not null").unionByName(rest.join(slot, [*keys, "_n"], "left").withColumnRenamed("_person", "person_idx").drop("_n"))


def swap_order(devices: DataFrame, swapped: DataFrame, session: str = "session", person: str = "person_idx") -> DataFrame:
    """Reverses the order of persons in the sessions listed."""
    n = F.max(person).over(Window.partitionBy(session))
    marked = devices.join(F.broadcast(swapped.select(session, F.lit(True).alias("_swap")).distinct()), session, "left")
    return marked.withColumn("_n", n).withColumn(person, F.when(F.col("_swap"), F.col("_n") - F.col(person)).otherwise(F.col(person))).drop("_n", "_swap")


def attach_strata(rows: DataFrame, features: DataFrame, on: list[str]) -> DataFrame:
    """Rows with their features; has_strata tells whether there were any."""
    return rows.join(features.withColumn("_has", F.lit(True)), on, "left").withColumn("has_strata", F.coalesce("_has", F.lit(False))).drop("_has")


def method_pairs(values: DataFrame, keys: list[str], method: str, value: str) -> DataFrame:
    """For each pair of methods over shared keys: n, equal share, mean absolute difference, Pearson (null without variance)."""
    a = values.select(*keys, F.col(method).alias("left_method"), F.col(value).cast("double").alias("x"))
    b = values.select(*keys, F.col(method).alias("right_method"), F.col(value).cast("double").alias("y"))
    both = a.join(b, keys).filter("left_method < right_method")
    sums = both.groupBy("left_method", "right_method").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("x") == F.col("y")).cast("double")).alias("equal_share"), F.avg(F.abs(F.col("x") - F.col("y"))).alias("mean_abs_delta"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") ** 2).alias("sxx"), F.sum(F.col("y") ** 2).alias("syy"), F.sum(F.col("x") * F.col("y")).alias("sxy"))
    vx, vy = F.col("n") * F.col("sxx") - F.col("sx") ** 2, F.col("n") * F.col("syy") - F.col("sy") ** 2
    corr = F.when((vx > 1e-9) & (vy > 1e-9), F.try_divide(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.sqrt(vx) * F.sqrt(vy)))
    return sums.select("left_method", "right_method", "n", "equal_share", "mean_abs_delta", corr.alias("corr"))


def orientation_gyro_join(orientation: DataFrame, gyro: DataFrame, keys: list[str], person: str, people: str) -> DataFrame:
    """Rows of both signals for the same person, and with the next person's gyro as the null pairing (kind 'matched' or 'shuffled')."""
    same = orientation.join(gyro, [*keys, person, "frame_idx"]).withColumn("kind", F.lit("matched"))
    turned = orientation.withColumn("_p", F.col(person)).withColumn(person, F.pmod(F.col(person) + 1, F.col(people)))
    other = turned.join(gyro, [*keys, person, "frame_idx"]).withColumn(person, F.col("_p")).drop("_p").withColumn("kind", F.lit("shuffled"))
    return same.unionByName(other)


def paired_difference(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, sample deviation and Cohen's dz of left - right; a key on one side only is an error."""
    a, b = left.select(*keys, F.col(value).alias("_l")), right.select(*keys, F.col(value).alias("_r"))
    both = a.join(b, keys, "full_outer")
    check = F.assert_true(F.col("_l").isNotNull() & F.col("_r").isNotNull(), F.lit("a key has no partner"))
    out = both.withColumn("_d", F.when(check.isNull(), F.col("_l") - F.col("_r"))).agg(F.count(F.lit(1)).alias("n"), F.avg("_d").alias("mean_difference"), F.stddev_samp("_d").alias("std_difference"))
    return out.withColumn("cohen_dz", F.when(F.col("std_difference") > 0, F.try_divide("mean_difference", "std_difference")))
