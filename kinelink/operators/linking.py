"""Linking broken tracks: ends of tracklets, candidate links, groups and merged series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinelink.operators.graphs import connected_components, spanning_forest
from kinelink.operators.joins import gap_pairs, interpolate_join

EPS = 1e-6


def tracklet_stats(detections: DataFrame, video: list[str], head: int = 5, tail: int = 5) -> DataFrame:
    """Per tracklet: start, end, length; mean centre and size and the velocity over its first and last rows.

    detections(video, track_id, frame_id, cx, cy, w, h). The velocity is per frame, from the first to the last row of
    the slice; 0 for one row.
    """
    keys = [*video, "track_id"]
    w = Window.partitionBy(*keys)
    order = ["frame_id", "cx", "cy", "w", "h"]
    ranked = detections.withColumn("_a", F.row_number().over(w.orderBy(*order))).withColumn("_z", F.row_number().over(w.orderBy(*(F.desc(c) for c in order))))
    out = []
    for name, limit, rank in (("head", head, "_a"), ("tail", tail, "_z")):
        inside = F.col(rank) <= limit
        pick = lambda c: F.when(inside, F.col(c))
        out += [F.avg(pick(c)).alias(f"{name}_{c}") for c in ("cx", "cy", "w", "h")]
        span = F.max(pick("frame_id")) - F.min(pick("frame_id"))
        first = "_a" if name == "head" else "_z"
        for c in ("cx", "cy"):
            low = F.min_by(pick(c), F.when(inside, F.col("_a")))
            high = F.max_by(pick(c), F.when(inside, F.col("_a")))
            out.append(F.when(span > 0, F.try_divide(high - low, span)).otherwise(0.0).alias(f"{name}_v{c[-1]}"))
    return ranked.groupBy(*keys).agg(F.min("frame_id").alias("start"), F.max("frame_id").alias("end"), F.count(F.lit(1)).alias("length"), *out)


def tracklet_candidates(stats: DataFrame, video: list[str], max_gap: int, weights: tuple[float, float, float, float] = (1.0, 1.0, 1.0, 0.1), fps: float = 30.0) -> DataFrame:
    """(video, src, dst, gap, norm_dist, size_diff, vel_residual, gap_penalty, score) of links across gaps of 1 to max_gap frames."""
    a = stats.select(*video, F.col("track_id").alias("src"), "end", *(F.col(f"tail_{c}") for c in ("cx", "cy", "w", "h", "vx", "vy")))
    b = stats.select(*video, F.col("track_id").alias("dst"), "start", *(F.col(f"head_{c}") for c in ("cx", "cy", "w", "h")))
    both = gap_pairs(a, b, video, max_gap).filter("src <> dst").withColumn("gap", F.col("start") - F.col("end"))
    hyp = lambda x, y: F.sqrt(x * x + y * y)
    dx, dy = F.col("head_cx") - F.col("tail_cx"), F.col("head_cy") - F.col("tail_cy")
    size = hyp((F.col("tail_w") + F.col("head_w")) / 2, (F.col("tail_h") + F.col("head_h")) / 2) + EPS
    ratio = lambda c: F.log((F.col(f"head_{c}") + EPS) / (F.col(f"tail_{c}") + EPS))
    dt = F.col("gap") / fps
    out = both.withColumn("norm_dist", hyp(dx, dy) / size).withColumn("size_diff", hyp(ratio("w"), ratio("h"))).withColumn("vel_residual", hyp(dx - F.col("tail_vx") * dt, dy - F.col("tail_vy") * dt) / size).withColumn("gap_penalty", F.log(1.0 + F.col("gap")))
    score = sum((w * F.col(c) for w, c in zip(weights, ("norm_dist", "size_diff", "vel_residual", "gap_penalty"))), F.lit(0.0))
    return out.withColumn("score", score).select(*video, "src", "dst", "gap", "norm_dist", "size_diff", "vel_residual", "gap_penalty", "score")


def accepted_links(candidates: DataFrame, score: float, norm_dist: float, size_diff: float) -> DataFrame:
    return candidates.filter((F.col("score") <= score) & (F.col("norm_dist") <= norm_dist) & (F.col("size_diff") <= size_diff))


def link_tracklets(stats: DataFrame, links: DataFrame, video: list[str], known_people: int | None = None) -> DataFrame:
    """(video, track_id, new_id): groups numbered by their smallest member.

    Without a known number of people every accepted link counts. With one, links count in order of (score, src, dst) until so few groups
    are left, one link at least. Those that join two groups are the links of the minimum spanning forest in this order, so the
    forest's first links of a video, as many as it has tracklets too many, give the same groups.
    """
    tracks = stats.select(*video, "track_id")
    node = lambda end: F.struct(*video, F.col(end).alias("track_id"))
    edges = links.select(node("src").alias("a"), node("dst").alias("b"), "score", "src", "dst")
    if known_people is not None:
        surplus = tracks.groupBy(*video).agg(F.greatest(F.count(F.lit(1)) - known_people, F.lit(1)).alias("_surplus"))
        forest = spanning_forest(edges, ["score", "src", "dst"]).select(*(F.col("a")[v].alias(v) for v in video), "*")
        place = F.row_number().over(Window.partitionBy(*video).orderBy("score", "src", "dst"))
        edges = forest.withColumn("_place", place).join(surplus, video).filter("_place <= _surplus")
    roots = connected_components(edges)
    least = roots.groupBy("root").agg(F.min("node.track_id").alias("label"))
    named = roots.join(least, "root").select("node.*", "label")
    labels = tracks.join(named, [*video, "track_id"], "left").withColumn("label", F.coalesce("label", "track_id"))
    return labels.withColumn("new_id", F.dense_rank().over(Window.partitionBy(*video).orderBy("label")) - 1).select(*video, "track_id", "new_id")


def merge_track_series(series: DataFrame, groups: DataFrame, video: list[str], values: list[str], fill_gaps: bool = False) -> DataFrame:
    """(video, new_id, frame_id, values): members' rows under the new id.

    With fill_gaps every frame of the range is there, interpolated; of rows of one frame the later member's counts.
    A group of one frame is not filled.
    """
    named = series.join(groups, [*video, "track_id"])
    if not fill_gaps:
        return named.select(*video, "new_id", "frame_id", "track_id", *values)
    keys = [*video, "new_id"]
    last = named.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "frame_id").orderBy(F.desc("track_id")))).filter("_k = 1")
    span = last.groupBy(*keys).agg(F.min("frame_id").alias("_lo"), F.max("frame_id").alias("_hi"))
    grid = span.select(*keys, F.explode(F.sequence("_lo", "_hi")).alias("frame_id"))
    return interpolate_join(last.select(*keys, "frame_id", *values), grid, keys, "frame_id", values)
