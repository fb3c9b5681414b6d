"""Sinks: tables partitioned for pruning, manifests, records and rewritten detections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_frames(frames: DataFrame, path: str, metadata: DataFrame | None = None, mode: str = "errorifexists") -> None:
    """Frame tables by dataset and variant, each sequence's rows together; metadata beside them."""
    frames.repartition("dataset", "variant", "sequence_id").sortWithinPartitions("sequence_id", "frame_idx").write.mode(mode).partitionBy("dataset", "variant").parquet(f"{path}/frames")
    if metadata is not None:
        metadata.write.mode(mode).parquet(f"{path}/sequences")


def write_windows(windows: DataFrame, path: str, csv: bool = False, mode: str = "errorifexists") -> None:
    """The window index by split; as CSV on request."""
    windows.write.mode(mode).partitionBy("split").parquet(f"{path}/windows")
    if csv:
        windows.write.mode(mode).option("header", True).csv(f"{path}/windows_csv")


def write_texts(texts: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """(path, value): whole texts under their names, many in a file; the readers of text files take the table in place of a folder."""
    texts.select("path", "value").write.mode(mode).parquet(path)


def window_summary(windows: DataFrame) -> DataFrame:
    """One row: windows, sequences, groups, rows in groups and without, and rows per split."""
    grouped = F.nullif(F.trim(F.col("candidate_group_id").cast("string")), F.lit(""))
    splits = windows.groupBy("split").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("split", "n")))).alias("per_split"))
    return windows.agg(F.count(F.lit(1)).alias("windows"), F.count_distinct("source_sequence").alias("sequences"), F.count_distinct(grouped).alias("candidate_groups"), F.count(grouped).alias("candidate_rows"), F.count_if(grouped.isNull()).alias("singleton_rows")).crossJoin(F.broadcast(splits))


def write_summary(windows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    window_summary(windows).coalesce(1).write.mode(mode).json(f"{path}/summary")


def video_manifest(paths: DataFrame, column: str = "video_path", order: str = "ord") -> DataFrame:
    """(video_path, ord): trimmed, without blanks, each once, where it was first seen."""
    text = F.nullif(F.trim(F.col(column).cast("string")), F.lit(""))
    return paths.select(text.alias("video_path"), order).filter("video_path is not null").groupBy("video_path").agg(F.min(order).alias("ord"))


def run_record(predictions: DataFrame, metrics: DataFrame, config_json: str, job: dict[str, str]) -> DataFrame:
    """One nested record: job fields, metrics, and hashes of the configuration and of all predictions.

    The predictions' hash is the sum of row hashes, so no order or gathering is needed.
    """
    row = F.conv(F.substring(F.sha2(F.to_json(F.struct(*sorted(predictions.columns))).cast("binary"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    digest = predictions.select(row.alias("_h")).agg(F.sha2(F.coalesce(F.sum("_h"), F.lit(0).cast("decimal(38,0)")).cast("string").cast("binary"), 256).alias("raw_results_sha256"), F.count(F.lit(1)).alias("n_predictions"))
    fields = [F.lit(v).alias(k) for k, v in sorted(job.items())]
    return metrics.select(F.struct(*metrics.columns).alias("frame_acc")).crossJoin(F.broadcast(digest)).select(*fields, F.lit(config_json).alias("resolved_config"), F.sha2(F.lit(config_json).cast("binary"), 256).alias("config_hash"), "raw_results_sha256", "n_predictions", "frame_acc")


def rewrite_track_ids(entries: DataFrame, mapping: DataFrame) -> DataFrame:
    """Detections with new ids where the mapping (track_id, new_id) has one."""
    return entries.join(mapping.select("track_id", "new_id"), "track_id", "left").withColumn("track_id", F.coalesce("new_id", "track_id")).drop("new_id")


def id_mapping(mapping: DataFrame) -> DataFrame:
    """(new_id, members) in order."""
    return mapping.groupBy("new_id").agg(F.array_sort(F.collect_set("track_id")).alias("members"))
