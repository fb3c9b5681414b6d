"""Statistics: channels, quantiles, strata, tracking, experiments."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelink.functions.vectors import gcd
from kinelink.operators.joins import split_overlap
from kinelink.operators.kernels import kernel_gap
from kinelink.operators.sampling import bootstrap_sums
from kinelink.operators.series import run_summary, runs
from kinelink.operators.storage import checkpointed


def imu_channel_stats(windows: DataFrame, frames: DataFrame, keys: list[str], channels: list[str], floor: float = 1e-12) -> DataFrame:
    """(channel, n, mean, std) over each source once, however many windows use it; population, with a variance floor."""
    used = windows.select(*keys).distinct()
    long = frames.join(used, keys, "left_semi").select(F.explode(F.array(*(F.struct(F.lit(c).alias("channel"), F.col(c).cast("double").alias("v")) for c in channels))).alias("_x")).select("_x.*")
    sums = long.groupBy("channel").agg(F.count("v").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("ss"))
    mean = F.col("s") / F.col("n")
    return sums.select("channel", "n", mean.alias("mean"), F.sqrt(F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(floor))).alias("std"))


def feature_stats(rows: DataFrame, features: list[str], floor: float = 1e-6) -> DataFrame:
    """(feature, mean, std) over windows, sample deviation with a floor."""
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in features))).alias("_x")).select("_x.*")
    return long.groupBy("feature").agg(F.avg("v").alias("mean"), F.greatest(F.stddev_samp("v"), F.lit(floor)).alias("std"))


def standardize(rows: DataFrame, values: list[str], session_stats: DataFrame, global_stats: DataFrame, session: str = "session", floor: float = 1e-6) -> DataFrame:
    """Values by the session's statistics if it has any, else by the global ones; tables with <value>_mean and <value>_std."""
    joined = rows.join(session_stats.select(session, *(F.col(f"{v}_{s}").alias(f"_s_{v}_{s}") for v in values for s in ("mean", "std"))), session, "left").crossJoin(F.broadcast(global_stats.select(*(F.col(f"{v}_{s}").alias(f"_g_{v}_{s}") for v in values for s in ("mean", "std")))))
    out = joined.withColumns({v: (F.col(v) - F.coalesce(f"_s_{v}_mean", f"_g_{v}_mean")) / F.greatest(F.coalesce(f"_s_{v}_std", f"_g_{v}_std"), F.lit(floor)) for v in values})
    return out.drop(*(f"_{k}_{v}_{s}" for k in "sg" for v in values for s in ("mean", "std")))


def finite(c: str) -> Column:
    return F.when(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(c) < float("inf")), F.col(c))


def quantile_summary(df: DataFrame, by: list[str], columns: list[str], probs: tuple = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """Exact quantiles of the finite values, as q05_<column> and so on; null where there are none."""
    return df.groupBy(*by).agg(*(F.percentile(finite(c), p).alias(f"q{round(100 * p):02d}_{c}") for c in columns for p in probs), *(F.count(finite(c)).alias(f"n_{c}") for c in columns))


def tertile_strata(df: DataFrame, value: str, by: list[str] | None = None, name: str = "stratum") -> DataFrame:
    """Adds low, mid or high by the thirds, pooled or within `by`; bounds belong to the lower stratum."""
    limits = df.groupBy(*(by or [])).agg(F.percentile(value, 1 / 3).alias("_q1"), F.percentile(value, 2 / 3).alias("_q2"))
    joined = df.join(limits, by) if by else df.crossJoin(F.broadcast(limits))
    return joined.withColumn(name, F.when(F.col(value).isNull(), None).when(F.col(value) <= F.col("_q1"), "low").when(F.col(value) <= F.col("_q2"), "mid").otherwise("high")).drop("_q1", "_q2")


def turning_strata(rows: DataFrame, group: list[str], value: str, domain: str, threshold: float | None = None, q: float = 0.75, eps: float = 1e-7) -> DataFrame:
    """Adds high or low by the group's mean against a fixed threshold or the domain's quantile of group means."""
    means = rows.groupBy(domain, *group).agg(F.avg(value).alias("group_mean"))
    limited = means.withColumn("_t", F.lit(threshold)) if threshold is not None else means.join(means.groupBy(domain).agg(F.percentile("group_mean", q).alias("_t")), domain)
    marked = limited.withColumn("stratum", F.when(F.col("group_mean") >= F.col("_t") - eps, "high").otherwise("low")).drop("_t")
    return rows.join(marked, [domain, *group])


def stratified_accuracy(rows: DataFrame, sets: list[list[str]], hits: list[str]) -> DataFrame:
    """Counts and accuracies of each hit column over each grouping set, in one scan and shuffle."""
    dims = sorted({c for s in sets for c in s})
    expressions = [F.count(F.lit(1)).alias("total"), *(F.avg(F.col(h).cast("double")).alias(f"{h}_acc") for h in hits)]
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *(F.col(c) for c in dims)).agg(*expressions, F.grouping_id().alias("level"))


def tracking_quality(visibility: DataFrame, sequence: list[str], person: str, frame: str, visible: str) -> DataFrame:
    """Per sequence: coverage, all-visible share, run lengths and fragmentation of its persons."""
    per_frame = visibility.groupBy(*sequence, frame).agg(F.avg(F.col(visible).cast("double")).alias("_share"), F.bool_and(visible).alias("_all"), F.count(F.lit(1)).alias("_n"))
    cover = per_frame.groupBy(*sequence).agg(F.count(F.lit(1)).alias("frames"), (F.sum(F.col("_share") * F.col("_n")) / F.sum("_n")).alias("coverage"), F.avg(F.col("_all").cast("double")).alias("all_visible_share"))
    keys = [*sequence, person]
    lengths = runs(visibility, keys, [frame], F.col(visible)).groupBy(*sequence).agg(F.count(F.lit(1)).alias("runs"), F.avg("length").alias("run_mean"), F.median("length").alias("run_q50"))
    broken = run_summary(visibility, keys, [frame], F.col(visible)).groupBy(*sequence).agg(F.avg("fragmentation").alias("fragmentation_mean"), F.count(F.lit(1)).alias("people"))
    return cover.join(broken, sequence).join(lengths, sequence, "left")


def group_size_histogram(visibility: DataFrame, sequence: list[str], frame: str, visible: str) -> DataFrame:
    """(sequence, group_size, frames): how many people are visible at once."""
    return visibility.groupBy(*sequence, frame).agg(F.count_if(visible).alias("group_size")).groupBy(*sequence, "group_size").agg(F.count(F.lit(1)).alias("frames"))


def visibility_delta(output: DataFrame, baseline: DataFrame, keys: list[str], sequence: list[str], visible: str) -> DataFrame:
    """Per sequence over the shared part: whether all is equal, and the mean absolute difference."""
    both = output.select(*keys, F.col(visible).alias("_a")).join(baseline.select(*keys, F.col(visible).alias("_b")), keys)
    return both.groupBy(*sequence).agg(F.bool_and(F.col("_a") == F.col("_b")).alias("equal"), F.avg((F.col("_a") != F.col("_b")).cast("double")).alias("delta"))


def detector_id_audit(matches: DataFrame, sequence: list[str], frame: str, track: str, person: str) -> DataFrame:
    """Per sequence: matched rows, and how often a track changes person or a person changes track."""
    def changes(own: str, other: str, name: str) -> DataFrame:
        w = Window.partitionBy(*sequence, own).orderBy(frame, other)
        moved = F.coalesce((F.col(other) != F.lag(other).over(w)).cast("int"), F.lit(0))
        return matches.withColumn("_c", moved).groupBy(*sequence).agg(F.sum("_c").alias(name))

    total = matches.groupBy(*sequence).agg(F.count(F.lit(1)).alias("matched"))
    return total.join(changes(track, person, "id_to_person_changes"), sequence).join(changes(person, track, "person_to_id_changes"), sequence)


def seed_summary(runs_: DataFrame, by: list[str], value: str, population: bool = False) -> DataFrame:
    """n, mean and deviation (sample or population; 0 for one run) over seeds."""
    std = F.stddev_pop(value) if population else F.coalesce(F.stddev_samp(value), F.lit(0.0))
    return runs_.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), std.alias("std"))


def leaderboard(runs_: DataFrame, by: list[str], value: str) -> DataFrame:
    """seed_summary with population deviation and rank by mean; equals by name."""
    w = Window.orderBy(F.desc(F.round("mean", 12)), *by)
    # one row per variant: the window sees the summary, not the runs
    return seed_summary(runs_, by, value, True).withColumn("rank", F.row_number().over(w))


def aggregate_runs(records: DataFrame) -> DataFrame:
    """Per condition and source: mean over seeds of macro (mean over sessions) and micro (sum over sum) accuracy and of the sessions' spread."""
    per_seed = records.groupBy("condition", "source", "seed").agg(F.avg(F.try_divide("correct", "total")).alias("macro"), F.try_divide(F.sum("correct"), F.sum("total")).alias("micro"), F.stddev_samp(F.try_divide("correct", "total")).alias("spread"))
    out = [a for c in ("macro", "micro", "spread") for a in (F.avg(c).alias(f"{c}_mean"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{c}_std"))]
    return per_seed.groupBy("condition", "source").agg(F.count(F.lit(1)).alias("seeds"), *out)


def bootstrap_interval(differences: DataFrame, order: list[str], value: str, trials: int = 10_000, seed: int = 42) -> DataFrame:
    """n, mean, Cohen's dz (null without deviation) and the central 95 % of bootstrap means.

    Draws depend on seed, trial and the rows' order only, so the result does not depend on partitions; see `bootstrap_sums`.
    """
    placed = checkpointed(numbered(differences.select(*order, F.col(value).alias("_v")), order, "_place").select("_place", "_v"))
    whole = placed.agg(F.count(F.lit(1)).alias("n"), F.avg("_v").alias("mean"), F.when(F.stddev_samp("_v") > 0, F.try_divide(F.avg("_v"), F.stddev_samp("_v"))).alias("cohen_dz")).filter("n > 0")
    n = placed.count()
    means = bootstrap_sums(placed, "_place", "_v", n, trials, seed).select((F.col("total") / n).alias("_m"))
    bounds = means.agg(F.percentile("_m", 0.025).alias("low"), F.percentile("_m", 0.975).alias("high"))
    return whole.crossJoin(F.broadcast(bounds))


def compare_results(base: DataFrame, variant: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Differences in points of percent."""
    return base.select(*keys, F.col(value).alias("base")).join(variant.select(*keys, F.col(value).alias("variant")), keys).withColumn("points", 100 * (F.col("variant") - F.col("base")))


def dataset_manifest(windows: DataFrame, identity: str = "session") -> DataFrame:
    """One row per split: rows, sessions, lengths, stride, groups and a content hash that no path enters; leaks over all splits."""
    w = Window.partitionBy("split", "source_sequence", "person_idx").orderBy("window_start")
    steps = windows.select("split", "source_sequence", "person_idx", "window_start").distinct().withColumn("_d", F.col("window_start") - F.lag("window_start").over(w)).filter("_d > 0").groupBy("split").agg(gcd(F.array_sort(F.collect_set("_d"))).alias("stride"))
    # an order-free hash: the sum of row hashes modulo 2**61 - 1, so nothing is gathered
    row = F.pmod(F.conv(F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(set(windows.columns) - {"npz_path"}))), 256), 1, 15), 16, 10).cast("long"), F.lit((1 << 61) - 1))
    base = windows.withColumn("_h", row).groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(identity).alias("identities"), F.count_distinct("source_sequence").alias("sequences"), F.min("window_len").alias("len_min"), F.max("window_len").alias("len_max"), F.pmod(F.sum(F.col("_h").cast("decimal(38,0)")), F.lit((1 << 61) - 1).cast("decimal(38,0)")).cast("string").alias("content"))
    leaks = split_overlap(windows, identity).agg(F.count(F.lit(1)).alias("leaking_identities"))
    return base.join(steps, "split", "left").crossJoin(F.broadcast(leaks))


def source_inventory(files: DataFrame) -> DataFrame:
    """(source, suffix, files, bytes) from files(source, path, length)."""
    suffix = F.coalesce(F.nullif(F.regexp_extract("path", r"(\.[^./]+)$", 1), F.lit("")), F.lit("<none>"))
    return files.withColumn("suffix", suffix).groupBy("source", "suffix").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def duplicate_fingerprints(frames: DataFrame, source: str, sequence: str, order: str, values: list[str], first: int | None = 32) -> DataFrame:
    """(fingerprint, sources, sequences) of recordings in several sources whose first `first` frames are equal, or with None all of them."""
    k = F.row_number().over(Window.partitionBy(source, sequence).orderBy(order))
    head = frames.withColumn("_k", k).filter(F.lit(True) if first is None else F.col("_k") <= first)
    cells = F.array_sort(F.collect_list(F.struct("_k", *values)))
    prints = head.groupBy(source, sequence).agg(F.sha2(F.to_json(cells).cast("binary"), 256).alias("fingerprint"))
    return prints.groupBy("fingerprint").agg(F.array_sort(F.collect_set(source)).alias("sources"), F.count(F.lit(1)).alias("sequences")).filter(F.size("sources") > 1)


def source_target_matrix(records: DataFrame, motion: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells with mean and deviation over seeds, association of accuracy and target motion; null below 3 cells or without variance)."""
    cells = records.groupBy("source", "target").agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"), F.count(F.lit(1)).alias("seeds"))
    both = cells.join(motion, "target")
    x, y = F.col("mean"), F.col("motion")
    sums = both.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"))
    vx, vy = F.col("n") * F.col("sxx") - F.col("sx") ** 2, F.col("n") * F.col("syy") - F.col("sy") ** 2
    corr = F.when((F.col("n") >= 3) & (vx > 1e-12) & (vy > 1e-12), F.try_divide(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.sqrt(vx) * F.sqrt(vy)))
    return cells, sums.select("source", "n", corr.alias("corr"))


def sweep_deltas(runs_: DataFrame, keys: list[str], method: str, value: str, base: str) -> DataFrame:
    """Each method's value minus the base method's, per key."""
    b = runs_.filter(F.col(method) == base).select(*keys, F.col(value).alias("_base"))
    return runs_.join(b, keys).withColumn("delta", F.col(value) - F.col("_base")).drop("_base")


def expected_cells(spark, sources: list[str], seeds: list[int], folds: dict[str, str]) -> DataFrame:
    """The runs a full study has: source training and evaluation, then zero-shot, fine-tune and direct per fold."""
    # a study's dimensions: few rows, so one partition each keeps the products small
    s = spark.createDataFrame([(x,) for x in sources], "source string").coalesce(1)
    k = spark.createDataFrame([(x,) for x in seeds], "seed int").coalesce(1)
    f = spark.createDataFrame(list(folds.items()), "fold string, test_session string").coalesce(1)
    sk = s.crossJoin(k)
    skf = sk.crossJoin(f)
    kf = k.crossJoin(f).withColumn("source", F.lit(None).cast("string"))

    def cells(df: DataFrame, phase: str, condition: str) -> DataFrame:
        name = F.concat_ws(".", F.lit(phase), F.lit(condition), F.coalesce("source", F.lit("none")), F.concat(F.lit("seed"), F.col("seed").cast("string")), *([F.col("fold")] if "fold" in df.columns else []))
        have = df if "fold" in df.columns else df.withColumn("fold", F.lit(None).cast("string")).withColumn("test_session", F.lit(None).cast("string"))
        return have.select(name.alias("job_id"), F.lit(phase).alias("phase"), F.lit(condition).alias("condition"), "source", "seed", "fold", "test_session")

    parts = [cells(sk, "train", "source"), cells(skf, "train", "finetune"), cells(kf, "train", "direct"), cells(sk, "evaluate", "source"), cells(skf, "evaluate", "zero_shot"), cells(skf, "evaluate", "finetune"), cells(kf, "evaluate", "direct")]
    return reduce(DataFrame.unionByName, parts)


def coral_gap(a: DataFrame, b: DataFrame, vector: str, size: int) -> DataFrame:
    """Squared distance of the two covariance matrices over 4 * size**2; sums of centred products, one matrix for each task."""
    covariance = lambda df, name: covariances(df, vector, size).withColumnRenamed("covariance", name)
    both = covariance(a, "_a").join(covariance(b, "_b"), ["i", "j"])
    return both.agg((F.sum((F.col("_a") - F.col("_b")) ** 2) / (4 * size * size)).alias("coral"))


def covariances(df: DataFrame, vector: str, size: int) -> DataFrame:
    """(i, j, covariance) of the first `size` components, sample covariance; a vector that is null, shorter or holds nulls takes no part."""
    whole = F.slice(F.col(vector).cast("array<double>"), 1, size)
    rows = df.select(whole.alias("v")).filter((F.size("v") == size) & F.forall("v", lambda x: x.isNotNull()))
    first = rows.agg(F.count(F.lit(1)), *(F.avg(F.get("v", F.lit(i))) for i in range(size))).first()
    n, middle = first[0], np.array(first[1:], float)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, size) - middle
            total += x.T @ x
        i, j = np.divmod(np.arange(size * size), size)
        yield pa.RecordBatch.from_pydict({"i": i, "j": j, "s": total.ravel()})

    return rows.mapInArrow(products, "i long, j long, s double").groupBy("i", "j").agg(F.try_divide(F.sum("s"), F.lit(float(n - 1))).alias("covariance"))


def mmd_gap(a: DataFrame, b: DataFrame, vector: str, key: str, sample: int | None = 256, seed: int = 7) -> DataFrame:
    """Kernel distance of two sets with the median bandwidth, not below 0, on `sample` vectors of each chosen by hash, or with None on all.

    See `kernel_gap`: the distances of (2 * sample)**2 pairs, or of all, are made block by block.
    """
    chosen = lambda df: df if sample is None else df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(sample)
    return kernel_gap(chosen(a), chosen(b), vector, key)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds the rows' number in order, from 0: rows are dealt by ranges, numbered inside them and moved by the sizes of the ranges before."""
    dealt = checkpointed(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").count()
    # one row per range
    before = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return dealt.withColumn("_i", inside).join(F.broadcast(before), "_part").withColumn(name, (F.col("_i") + F.col("_before")).cast("long")).drop("_part", "_i", "_before")


def label_map(df: DataFrame, column: str, name: str = "label") -> DataFrame:
    """(value, label): non-blank values numbered in order from 0."""
    value = F.nullif(F.trim(F.col(column).cast("string")), F.lit(""))
    return numbered(df.select(value.alias("value")).filter("value is not null").distinct(), ["value"], name)


def turning_moe(scores: DataFrame, counts: DataFrame, group: list[str], threshold: float = 19 / 48, persistent: DataFrame | None = None) -> DataFrame:
    """Correct and total of four rules: baseline, physical alone, physical for high-turning groups, and for persistent ones.

    scores(group, row, col, baseline, physical), counts(group, turning_count), persistent(group) the high groups
    with another high one near. Each row takes its best column, the first of equals.
    """
    high = counts.withColumn("_high", F.col("turning_count") >= F.round(F.lit(threshold * 48))).select(*group, "_high")
    last = (persistent.select(*group).distinct().withColumn("_last", F.lit(True)) if persistent is not None else high.filter("_high").select(*group).withColumn("_last", F.lit(True)))
    joined = scores.join(high, group).join(last, group, "left").withColumn("_size", F.count_if(F.col("row") == F.col("col")).over(Window.partitionBy(*group))).filter("_size >= 2")
    rules = {"baseline": F.col("baseline"), "physical_only": F.col("physical"), "turning_moe": F.when(F.col("_high"), F.col("physical")).otherwise(F.col("baseline")), "turning_moe_persistent": F.when(F.coalesce("_last", F.lit(False)), F.col("physical")).otherwise(F.col("baseline"))}
    long = joined.select(*group, "row", "col", F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), e.cast("double").alias("s")) for n, e in rules.items()))).alias("_x")).select(*group, "row", "col", "_x.rule", "_x.s")
    best = long.groupBy("rule", *group, "row").agg(F.max_by("col", F.struct("s", -F.col("col"))).alias("_b"))
    return best.groupBy("rule").agg(F.count_if(F.col("_b") == F.col("row")).alias("correct"), F.count(F.lit(1)).alias("total")).withColumn("accuracy", F.try_divide("correct", "total"))
