"""Matching accuracy over candidate groups, retrieval and its diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinelink.functions.vectors import cosine
from kinelink.operators.assignment import assign
from kinelink.operators.sampling import permuted_place
from kinelink.operators.stats import numbered
from kinelink.operators.storage import checkpointed


def candidate_scores(rows: DataFrame, group: str, index: str, left: str = "imu_emb", right: str = "video_emb") -> DataFrame:
    """(group, row, col, score): cosine of every left with every right vector of a group."""
    a = rows.select(group, F.col(index).alias("row"), F.col(left).alias("_l"))
    b = rows.select(group, F.col(index).alias("col"), F.col(right).alias("_r"))
    return a.join(b, group).select(group, "row", "col", cosine("_l", "_r").alias("score"))


def group_accuracy(scores: DataFrame, group: str, method: str = "hungarian") -> DataFrame:
    """(group, n_correct, n_total) of the groups' assignments."""
    return assign(scores, [group], method=method).groupBy(group).agg(F.count_if(F.col("row") == F.col("col")).alias("n_correct"), F.count(F.lit(1)).alias("n_total"))


def frame_acc(rows: DataFrame, group: str, index: str, singletons: str = "exclude", method: str = "hungarian") -> DataFrame:
    """One row of accuracy figures; singletons: 'error', 'exclude' or 'count_as_correct'."""
    if singletons not in ("error", "exclude", "count_as_correct"):
        raise ValueError(f"unknown singleton policy {singletons!r}")
    counted = group_accuracy(candidate_scores(rows, group, index), group, method)
    single = F.col("n_total") < 2
    if singletons == "error":
        counted = counted.withColumn("n_total", F.when(F.assert_true(~single, F.lit("a candidate group has a single item")).isNull(), F.col("n_total")))
    used = counted.withColumn("_use", F.lit(True) if singletons == "count_as_correct" else ~single)
    pick = lambda c: F.when(F.col("_use"), c)
    window = pick(F.col("n_correct") / F.col("n_total"))
    return used.agg(
        F.count(F.lit(1)).alias("n_groups"), F.count_if("_use").alias("n_evaluated"), F.count_if(single).alias("n_singletons"),
        F.min("n_total").alias("group_size_min"), F.avg("n_total").alias("group_size_mean"),
        F.coalesce(F.sum(pick(F.col("n_correct"))), F.lit(0)).cast("long").alias("n_correct"), F.coalesce(F.sum(pick(F.col("n_total"))), F.lit(0)).cast("long").alias("n_total"),
        F.coalesce(F.avg(window), F.lit(0.0)).alias("mean_window_acc"), F.coalesce(F.stddev_pop(window), F.lit(0.0)).alias("std_window_acc"),
    ).withColumn("frame_acc", F.coalesce(F.try_divide("n_correct", "n_total"), F.lit(0.0)))


def retrieval_top1(scores: DataFrame, group: str) -> DataFrame:
    """(group, n, row_top1, col_top1, top1) for groups of two or more: share of rows and columns whose best partner is their own."""
    r = scores.groupBy(group, "row").agg(F.max_by("col", F.struct("score", -F.col("col"))).alias("best")).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("best") == F.col("row")).cast("double")).alias("row_top1"))
    c = scores.groupBy(group, "col").agg(F.max_by("row", F.struct("score", -F.col("row"))).alias("best")).groupBy(group).agg(F.avg((F.col("best") == F.col("col")).cast("double")).alias("col_top1"))
    return r.filter("n >= 2").join(c, group).withColumn("top1", (F.col("row_top1") + F.col("col_top1")) / 2)


def query_diagnostics(scores: DataFrame, group: str, identity: str = "id") -> DataFrame:
    """One row per query: prediction, margin, softmax confidence, normalised entropy, tie and outcome.

    scores carries row, col, score and row_id, col_id: a hit is on identity, not on the row.
    """
    w = Window.partitionBy(group, "row")
    ranked = scores.withColumn("_k", F.row_number().over(w.orderBy(F.desc("score"), "col"))).withColumn("_top", F.max("score").over(w))
    p = F.exp(F.col("score") - F.col("_top"))
    each = ranked.withColumn("_p", p / F.sum(p).over(w))
    best = lambda c, k=1: F.max(F.when(F.col("_k") == k, F.col(c)))
    out = each.groupBy(group, "row").agg(F.count(F.lit(1)).alias("n"), best("col").alias("predicted"), (best("score") - best("score", 2)).alias("margin"), F.max("_p").alias("confidence"), (-F.sum(F.col("_p") * F.log(F.greatest("_p", F.lit(1e-12))))).alias("_h"), F.max(F.when(F.col("_k") == 1, F.col("row_id") == F.col("col_id"))).alias("hit")).filter("n >= 2")
    return out.withColumn("entropy", F.col("_h") / F.log(F.col("n").cast("double"))).withColumn("tie", F.col("margin") <= 1e-6).drop("_h")


def retrieval_diagnostics(queries: DataFrame, by: list[str], group: str, bins: int = 10, coverages: tuple = (1.0, 0.8, 0.5)) -> DataFrame:
    """Per domain (or over all with by=[]): accuracy, chance, margins, entropy, ties, calibration error and accuracy of the surest share.

    The kept share is rounded half to even, one at least; equal margins are ordered by group and row.
    """
    q = queries.withColumn("_all", F.lit(1))
    keys = by or ["_all"]
    w = Window.partitionBy(*keys)
    q = q.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_rank", F.row_number().over(w.orderBy(F.desc("margin"), F.desc(group), F.desc("row"))))
    q = q.withColumn("_bin", F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)))
    kept = lambda c: F.greatest(F.lit(1), F.bround(F.col("_n") * c))
    hit = F.col("hit").cast("double")
    shares = [F.avg(F.when(F.col("_rank") <= kept(c), hit)).alias(f"acc_at_{int(100 * c)}") for c in coverages]
    main = q.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count_if("hit").alias("correct"), F.count_distinct(group).alias("groups"), F.avg("margin").alias("mean_margin"), F.avg("entropy").alias("mean_entropy"), F.avg(F.col("tie").cast("double")).alias("tie_rate"), *shares)
    binned = q.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_m"), F.avg("confidence").alias("_c"), F.avg(hit).alias("_h"), F.max("_n").alias("_n"))
    ece = binned.groupBy(*keys).agg(F.sum(F.col("_m") / F.col("_n") * F.abs(F.col("_c") - F.col("_h"))).alias("calibration_error"))
    return main.join(ece, keys).withColumn("frame_acc", F.col("correct") / F.col("total")).withColumn("chance", F.col("groups") / F.col("total")).drop("_all")


def group_test(units: DataFrame, sizes: list[int], trials: int, seed: int) -> DataFrame:
    """Sampled groups of chunks: units(unit_id, imu array of vectors, video array of vectors).

    Units are numbered by id, and a trial's group is where a permutation keyed by seed, size and trial puts the first places, so a draw
    costs the group's size, not the number of units, and results don't depend on partitions. Vectors join the drawn ids only. Sizes above the
    number of units give no groups.
    """
    spark = units.sparkSession
    ids = checkpointed(numbered(units.select("unit_id"), ["unit_id"], "_place"))
    n = ids.count()
    wanted = [(size, trial, k) for size in sizes if size <= n for trial in range(trials) for k in range(size)]  # the parameters' size
    lots = spark.createDataFrame(wanted, "size int, trial long, k int")
    places = lots.withColumn("_place", permuted_place(F.col("k").cast("long"), F.xxhash64(F.lit(seed), "size", "trial"), F.lit(n)))
    drawn = ids.join(F.broadcast(places), "_place").select("size", "trial", "k", "unit_id")
    both = drawn.join(units, "unit_id")
    a = both.select("size", "trial", F.col("k").alias("row"), "imu")
    b = both.select("size", "trial", F.col("k").alias("col"), "video")
    pairs = F.arrays_zip("imu", "video")
    shorter = F.slice(pairs, 1, F.least(F.size("imu"), F.size("video")))
    score = F.aggregate(F.transform(shorter, lambda x: cosine(x["imu"], x["video"])), F.lit(0.0), lambda s, x: s + x) / F.size(shorter)
    scores = a.join(b, ["size", "trial"]).select("size", "trial", "row", "col", score.alias("score"))
    hits = assign(scores, ["size", "trial"]).groupBy("size", "trial").agg(F.avg((F.col("row") == F.col("col")).cast("double")).alias("acc"))
    sims = scores.groupBy("size").agg(F.avg(F.when(F.col("row") == F.col("col"), F.col("score"))).alias("mean_diag_sim"), F.avg(F.when(F.col("row") != F.col("col"), F.col("score"))).alias("mean_offdiag_sim"))
    return hits.groupBy("size").agg(F.count(F.lit(1)).alias("trials"), F.avg("acc").alias("mean_acc"), F.stddev_pop("acc").alias("std_acc")).join(sims, "size")


def chunk_units(rows: DataFrame, sequence: list[str], order: list[str], windows: int = 30, least: int = 15) -> DataFrame:
    """units for group_test: chunks of consecutive windows of a sequence; a last chunk stays if it has `least`."""
    n = F.row_number().over(Window.partitionBy(*sequence).orderBy(*order)) - 1
    chunked = rows.withColumn("_n", n).withColumn("chunk", F.floor(F.col("_n") / windows))
    cell = F.array_sort(F.collect_list(F.struct("_n", "imu_emb", "video_emb")))
    grouped = chunked.groupBy(*sequence, "chunk").agg(cell.alias("_c")).filter(F.size("_c") >= least)
    number = F.col("chunk").cast("string")  # lpad alone would cut numbers of four digits, and ids would meet
    name = F.concat(F.concat_ws("_", *(F.col(c).cast("string") for c in sequence)), F.lit("_c"), F.lpad(number, F.greatest(F.lit(3), F.length(number)), F.lit("0")))
    return grouped.select(name.alias("unit_id"), F.split(F.col(sequence[0]).cast("string"), "_")[0].alias("subject"), F.transform("_c", lambda x: x["imu_emb"]).alias("imu"), F.transform("_c", lambda x: x["video_emb"]).alias("video"))


def frame_assignment_counts(gt_map: DataFrame, assigned: DataFrame, clip: list[str]) -> DataFrame:
    """(clip, correct, total): gt_map(clip, frame_idx, gt_id, track, visible), assigned(clip, frame_idx, imu_id, track).

    A visible person with a track counts; it is right if exactly one sensor took that track and it is theirs.
    """
    seen = gt_map.filter(F.col("visible") & F.col("track").isNotNull())
    took = assigned.filter("track is not null").groupBy(*clip, "frame_idx", "track").agg(F.count(F.lit(1)).alias("_n"), F.min("imu_id").alias("_imu"))
    hit = F.coalesce((F.col("_n") == 1) & (F.col("_imu") == F.col("gt_id")), F.lit(False))
    return seen.join(took, [*clip, "frame_idx", "track"], "left").groupBy(*clip).agg(F.count_if(hit).alias("correct"), F.count(F.lit(1)).alias("total"))


def session_rollup(clips: DataFrame, session: str = "session") -> DataFrame:
    """Per session and over all (null session): counts, weighted accuracy and mean accuracy of the clips."""
    acc = F.coalesce(F.try_divide("correct", "total"), F.lit(0.0))
    rolled = clips.withColumn("_acc", acc).rollup(session).agg(F.count(F.lit(1)).alias("clips"), F.sum("correct").alias("correct"), F.sum("total").alias("total"), F.avg("_acc").alias("mean_clip_acc"))
    return rolled.withColumn("frame_acc", F.coalesce(F.try_divide("correct", "total"), F.lit(0.0)))
