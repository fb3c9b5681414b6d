"""Quality gates: each gives a table of violations (rule, key, detail); assert_clean raises on the first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelink.functions.vectors import gcd
from kinelink.operators.joins import split_overlap


def violation(df: DataFrame, rule: str, key: str | Column, detail: Column | None = None) -> DataFrame:
    name = F.col(key) if isinstance(key, str) else key
    return df.select(F.lit(rule).alias("rule"), name.cast("string").alias("key"), (detail if detail is not None else F.lit("")).cast("string").alias("detail"))


def together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def assert_clean(violations: DataFrame) -> None:
    """Raises with the first violation by rule and key."""
    first = violations.orderBy("rule", "key", "detail").first()
    if first is not None:
        raise ValueError(f"{first.rule}: {first.key} {first.detail}".strip())


def validate_sequences(sequences: DataFrame, frames: DataFrame, datasets: list[str], channels: str = "imu_channels") -> DataFrame:
    """Checks recordings: names, frame order, equal lengths, finite and non-zero data, unique channels.

    sequences(sequence_id, dataset, n_frames, imu_channels array), frames(sequence_id, source 'imu'|'gt'|'extract',
    frame_id, values array). A skeleton is good if the annotated or the extracted one is not all zero.
    """
    w = Window.partitionBy("sequence_id", "source", "stream").orderBy("frame_id") if "stream" in frames.columns else Window.partitionBy("sequence_id", "source").orderBy("frame_id")
    step = frames.withColumn("_bad", F.coalesce(F.col("frame_id") <= F.lag("frame_id").over(w), F.lit(False)))
    finite = F.forall("values", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    zero = F.forall("values", lambda v: v == 0)
    per = step.groupBy("sequence_id", "source").agg(F.bool_or("_bad").alias("order"), F.bool_and(finite).alias("finite"), F.bool_and(zero).alias("zero"), F.min(F.size("values")).alias("w0"), F.max(F.size("values")).alias("w1"), F.count_distinct("frame_id").alias("n"))
    skeleton = per.filter("source in ('gt', 'extract')").groupBy("sequence_id").agg(F.bool_and("zero").alias("zero"))
    known = sequences.select("sequence_id", "n_frames", F.size(channels).alias("_c"))
    return together([
        violation(sequences.filter(F.col("sequence_id").isNull() | F.col("dataset").isNull()), "missing_field", F.coalesce("sequence_id", F.lit("?"))),
        violation(sequences.filter(~F.col("dataset").isin(datasets)), "dataset", "sequence_id", F.col("dataset")),
        violation(sequences.filter(F.size(F.array_distinct(channels)) < F.size(channels)), "channel_names", "sequence_id"),
        violation(per.filter("order"), "frame_order", "sequence_id", F.col("source")),
        violation(per.filter("not finite"), "not_finite", "sequence_id", F.col("source")),
        violation(per.filter("w0 <> w1"), "width", "sequence_id", F.col("source")),
        violation(per.join(known, "sequence_id").filter("n <> n_frames"), "length", "sequence_id", F.col("source")),
        violation(per.join(known, "sequence_id").filter("source = 'imu' and w1 <> _c"), "channel_count", "sequence_id"),
        violation(per.filter("source = 'imu' and zero"), "zero_imu", "sequence_id"),
        violation(skeleton.filter("zero"), "zero_skeleton", "sequence_id"),
        violation(sequences.join(per.select("sequence_id").distinct(), "sequence_id", "left_anti"), "no_frames", "sequence_id"),
    ])


def stride_of(windows: DataFrame, stream: list[str], start: str = "window_start") -> DataFrame:
    """(split, stride): greatest common divisor of the distinct steps between starts of a stream."""
    w = Window.partitionBy("split", *stream).orderBy(start)
    steps = windows.select("split", *stream, start).distinct().withColumn("_d", F.col(start) - F.lag(start).over(w)).filter("_d > 0")
    return steps.groupBy("split").agg(gcd(F.array_sort(F.collect_set("_d"))).alias("stride"))


def validate_prepared(windows: DataFrame, files: DataFrame, identity: str, length: int, stride: int, may_lack_val: bool = False, stream: tuple = ("npz_path", "person_idx", "imu_idx")) -> DataFrame:
    """Checks a window index: splits, lengths, stride, leaks, missing files, groups of one."""
    spark = windows.sparkSession
    needed = spark.createDataFrame([(s,) for s in ("train", "val", "test") if not (s == "val" and may_lack_val)], "split string")
    groups = windows.filter("split = 'test' and coalesce(trim(candidate_group_id), '') <> ''").groupBy("candidate_group_id").count()
    return together([
        violation(needed.join(windows.select("split").distinct(), "split", "left_anti"), "empty_split", "split"),
        violation(windows.filter((F.col("window_end") - F.col("window_start") != length) | (F.col("window_len") != length)), "window_length", F.concat_ws(":", "npz_path", F.col("window_start").cast("string"))),
        violation(stride_of(windows, list(stream)).filter(F.col("stride") != stride), "stride", "split", F.col("stride")),
        violation(split_overlap(windows, identity), "identity_leak", "value", F.array_join("splits", "/")),
        violation(split_overlap(windows, "source_sequence"), "sequence_leak", "value", F.array_join("splits", "/")),
        violation(windows.select("npz_path").distinct().join(files.select("npz_path").distinct(), "npz_path", "left_anti"), "missing_file", "npz_path"),
        violation(groups.filter("count < 2"), "singleton_group", "candidate_group_id"),
    ])


def check_timestamps(df: DataFrame, keys: list[str], order: list[str], ts: str) -> DataFrame:
    """Violations where times are not finite or do not increase; one sample is fine."""
    w = Window.partitionBy(*keys).orderBy(*order)
    name = F.concat_ws(":", *(F.col(k).cast("string") for k in keys))
    bad = df.withColumn("_bad", F.coalesce(F.col(ts) <= F.lag(ts).over(w), F.lit(False)) | F.col(ts).isNull() | F.isnan(F.col(ts).cast("double")))
    return violation(bad.filter("_bad").groupBy(name.alias("k")).count(), "timestamps", "k", F.col("count"))


def check_finite(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return together([violation(df.filter(F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(c) == float("inf"))), "not_finite", key, F.lit(c)) for c in columns])


def pose_artifact_quality(detections: DataFrame, key: str, keypoints: str, joints: int = 17) -> DataFrame:
    """(key, entries, usable): usable ones have all numbers of all joints, finite. usable = 0 is a violation."""
    good = (F.size(keypoints) >= 3 * joints) & F.forall(keypoints, lambda v: F.coalesce(~F.isnan(v), F.lit(False)))
    return detections.groupBy(key).agg(F.count(F.lit(1)).alias("entries"), F.count_if(good).alias("usable"))


def quaternion_quality(df: DataFrame, keys: list[str], quat: list[str], low: float = 0.9, high: float = 1.1) -> DataFrame:
    """Per key: frames, norms outside [low, high], zero norms and the bad share."""
    size = F.sqrt(sum((F.col(q) ** 2 for q in quat), F.lit(0.0)))
    marked = df.withColumn("_n", size).withColumn("_bad", ~F.col("_n").between(low, high))
    return marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("frames"), F.count_if("_bad").alias("invalid"), F.count_if(F.col("_n") <= 1e-12).alias("zero"), F.avg(F.col("_bad").cast("double")).alias("invalid_share"))


def extreme_coordinates(df: DataFrame, record: str, order: list[str], joints: str, threshold: float = 10.0, examples: int = 20) -> tuple[DataFrame, DataFrame]:
    """(counts by joint and dimension, the first `examples` seen, by size)."""
    each = df.select(record, *order, F.posexplode(joints).alias("joint", "_p")).select(record, *order, "joint", F.posexplode(F.array("_p.x", "_p.y", "_p.z")).alias("dim", "value")).filter(F.abs("value") > threshold)
    counts = each.groupBy("joint", "dim").agg(F.count(F.lit(1)).alias("n"), F.max(F.abs("value")).alias("largest"))
    first = each.orderBy(record, *order, "joint", "dim").limit(examples)
    return counts, first.orderBy(F.desc(F.abs("value")), record, *order, "joint", "dim")


def flagged(df: DataFrame, key: Column, rules: dict[str, Column]) -> DataFrame:
    """Violations of row rules in one pass: each row's broken rules are listed and exploded."""
    broken = F.filter(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(rule)) for rule, bad in rules.items())), lambda r: r.isNotNull())
    return df.select(F.explode(broken).alias("rule"), F.coalesce(key.cast("string"), F.lit("?")).alias("key"), F.lit("").alias("detail"))


def validate_run_records(records: DataFrame, expected: DataFrame) -> DataFrame:
    """Checks run records against the expected cells (job_id, condition, dataset, source, seed, test_session, train_job_id).

    One full outer join by job finds what is missing, extra or different and checks every record's fields; two small
    aggregates find duplicates and mixtures.
    """
    cells = ["condition", "dataset", "source", "seed", "test_session", "train_job_id"]
    needed = ["config_hash", "resolved_config", "data_manifest_hash", "checkpoint", "checkpoint_sha256", "raw_results", "raw_results_sha256", "git_commit", "protocol_hash"]
    r = records.withColumn("_r", F.lit(True))
    e = expected.select("job_id", F.struct(*cells).alias("_e"))
    both = r.join(e, "job_id", "full_outer")
    have, known, m, g = F.coalesce("_r", F.lit(False)), F.col("_e").isNotNull(), F.col("frame_acc"), F.col("candidate_groups")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    counts_bad = (m["total"] <= 0) | (m["correct"] < 0) | (m["correct"] > m["total"])
    source = F.col("condition") == "source"
    rules = {
        "no_job_id": have & blank("job_id"),
        "missing": ~have,
        "extra": have & ~known,
        "not_completed": F.coalesce(F.col("status"), F.lit("")) != "completed",
        **{f"{c}_mismatch": known & ~F.col(c).eqNullSafe(F.col(f"_e.{c}")) for c in cells},
        **{f"no_{c}": blank(c) for c in needed},
        "dirty": F.coalesce("git_dirty", F.lit(True)),
        **{f"bad_{c}": ~F.coalesce(F.lower(F.col(c)).rlike("^[0-9a-f]{64}$"), F.lit(False)) for c in ("checkpoint_sha256", "raw_results_sha256")},
        "config_hash_mismatch": F.sha2(F.col("resolved_config").cast("binary"), 256) != F.col("config_hash"),
        "counts": m.isNull() | counts_bad,
        "value": ~counts_bad & (F.abs(m["value"] - F.try_divide(m["correct"], m["total"])) > 1e-12),
        "source_singletons": source & (F.coalesce(g["singleton_rate"], F.lit(-1.0)) != 0),
        "source_group_size": source & (F.coalesce(g["candidate_group_size_min"], F.lit(0)) < 2),
    }
    # a cell without a record only misses one
    rules = {k: bad if k in ("missing", "no_job_id", "extra") else have & bad for k, bad in rules.items()}
    jobs = records.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"))
    whole = records.agg(F.count_distinct("protocol_hash").alias("p"), F.count_distinct("git_commit").alias("c"))
    manifests = records.groupBy("dataset", "test_session").agg(F.count_distinct("data_manifest_hash").alias("n"))
    return together([
        flagged(both, F.col("job_id"), rules),
        violation(jobs.filter("n > 1"), "duplicate", "job_id"),
        flagged(whole, F.lit("*"), {"mixed_protocol": F.col("p") > 1, "mixed_commit": F.col("c") > 1}),
        violation(manifests.filter("n > 1"), "mixed_manifest", F.concat_ws(":", "dataset", "test_session")),
    ])


def audit_person_imu_mapping(windows: DataFrame, sequences: DataFrame, files: DataFrame) -> DataFrame:
    """Per sequence: whether sensor and person ids are the same set, rows whose indices differ, blank ones, missing files.

    sequences(sequence_id, imu_ids array, person_ids array), windows(sequence_id, npz_path, person_idx, imu_idx).
    """
    same = F.array_sort(F.array_distinct("imu_ids")) == F.array_sort(F.array_distinct("person_ids"))
    blank = F.col("person_idx").isNull() | F.col("imu_idx").isNull()
    gone = windows.join(files.select("npz_path").distinct(), "npz_path", "left_anti").groupBy("sequence_id").agg(F.count(F.lit(1)).alias("missing_refs"))
    rows = windows.groupBy("sequence_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(blank).alias("blank"), F.count_if(~blank & (F.col("person_idx") != F.col("imu_idx"))).alias("mismatched"))
    return sequences.select("sequence_id", same.alias("same_ids")).join(rows, "sequence_id", "left").join(gone, "sequence_id", "left").fillna(0, ["rows", "blank", "mismatched", "missing_refs"])


def gate_sources(audits: DataFrame) -> DataFrame:
    """status of each source: included if present, finite and mapped; conditional if only the mapping is open; else pending."""
    ok = F.col("present") & (F.col("finite_share") >= 1.0)
    return audits.withColumn("status", F.when(ok & F.col("mapped"), "included").when(ok, "conditional").otherwise("pending"))
