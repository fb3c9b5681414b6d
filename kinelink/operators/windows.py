"""Windows over sequences, candidate groups and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fixed_windows(sequences: DataFrame, length: int, stride: int, n_frames: str = "n_frames", tail: bool = False) -> DataFrame:
    """Adds window_start and window_end: one row for each window of each sequence.

    A sequence shorter than the window has none. With tail, a last window ends at the last frame
    unless the grid already has it.
    """
    last = F.col(n_frames) - length
    starts = F.sequence(F.lit(0).cast("long"), last.cast("long"), F.lit(stride).cast("long"))
    if tail:
        starts = F.array_union(starts, F.array(last.cast("long")))
    return sequences.filter(last >= 0).withColumn("window_start", F.explode(starts)).withColumn("window_end", F.col("window_start") + length)


def duration_windows(sequences: DataFrame, seconds: float, stride_seconds: float, fps: str = "fps_hz", n_frames: str = "n_frames") -> DataFrame:
    """Windows given in seconds; frame counts are rounded half to even for each sequence's rate."""
    length, stride = F.bround(F.lit(seconds) * F.col(fps)).cast("long"), F.bround(F.lit(stride_seconds) * F.col(fps)).cast("long")
    sized = sequences.withColumn("_len", length).withColumn("_stride", stride).filter((F.col("_len") > 0) & (F.col("_stride") > 0) & (F.col(n_frames) >= F.col("_len")))
    return sized.withColumn("window_start", F.explode(F.expr(f"sequence(0L, {n_frames} - _len, _stride)"))).withColumn("window_end", F.col("window_start") + F.col("_len")).drop("_len", "_stride")


def pair_persons(windows: DataFrame, multi_person: bool, n_people: str = "n_people", n_imu: str = "n_imu") -> DataFrame:
    """Adds person_idx and imu_idx: one-to-one for several people, else every pair; one person row at least."""
    people = windows.withColumn("person_idx", F.explode(F.sequence(F.lit(0), F.greatest(F.col(n_people), F.lit(1)).cast("int") - 1)))
    if multi_person:
        return people.withColumn("imu_idx", F.col("person_idx")).filter(F.col("imu_idx") < F.col(n_imu))
    return people.filter(F.col(n_imu) > 0).withColumn("imu_idx", F.explode(F.sequence(F.lit(0), F.col(n_imu).cast("int") - 1)))


def blank_to_null(name: str) -> Column:
    return F.nullif(F.trim(F.col(name).cast("string")), F.lit(""))


def window_group_key(df: DataFrame) -> Column:
    """The candidate group if given, else source sequence and range, else path, session and range."""
    have = set(df.columns)
    col = lambda n: blank_to_null(n) if n in have else F.lit(None).cast("string")
    source = F.when(col("source_sequence").isNotNull() & col("source_window_start").isNotNull(), F.concat_ws("|", F.lit("source"), col("source_sequence"), col("source_window_start"), col("window_end")))
    path = F.concat_ws("|", F.lit("path"), F.coalesce(col("npz_path"), F.lit("")), F.coalesce(col("session"), F.lit("")), col("window_start"), col("window_end"))
    return F.coalesce(F.concat(F.lit("candidate|"), col("candidate_group_id")), source, path)


def window_identity(df: DataFrame) -> Column:
    """Who a row is inside its group: the candidate index of explicit groups, else person or sensor."""
    have = set(df.columns)
    col = lambda n: blank_to_null(n) if n in have else F.lit(None).cast("string")
    explicit = F.coalesce(col("candidate_index"), col("source_sequence"), col("npz_path"), F.lit("0"))
    return F.when(col("candidate_group_id").isNotNull(), explicit).otherwise(F.coalesce(col("source_person"), col("imu_idx"), col("person_idx"), F.lit("0")))


def parse_sequence_id(sequence_id: Column | str) -> Column:
    """struct(subject, session, segment) from names like s1_walking2, custom_s06_seg3; an unknown name is its own session."""
    s = F.col(sequence_id) if isinstance(sequence_id, str) else sequence_id
    subject = F.regexp_extract(s, r"^([sS][0-9]+)_", 1)
    custom = F.regexp_extract(s, r"^custom_(.+?)(?:_seg[0-9]+)?$", 1)
    segment = F.nullif(F.regexp_extract(s, r"_seg([0-9]+)$", 1), F.lit("")).cast("int")
    session = F.when(custom != "", custom).when(subject != "", F.regexp_replace(s, r"^[sS][0-9]+_", "")).otherwise(s)
    return F.struct(F.when(subject != "", subject).otherwise("all").alias("subject"), session.alias("session"), segment.alias("segment"))


def assign_candidate_groups(windows: DataFrame, size: int, position: list[str], native: list[str], order: list[str]) -> DataFrame:
    """Adds candidate_group_id and candidate_index.

    Rows that share the native key with another row form that group. The others are put in groups of
    `size` among rows at the same position, in the given order; a last one alone stays without.
    """
    nat, pos = Window.partitionBy(*native), Window.partitionBy(*position, "_single")
    counted = windows.withColumn("_n", F.count(F.lit(1)).over(nat)).withColumn("_single", F.col("_n") < 2).withColumn("_k", F.row_number().over(nat.orderBy(*order)) - 1)
    ranked = counted.withColumn("_r", F.row_number().over(pos.orderBy(*order)) - 1).withColumn("_m", F.count(F.lit(1)).over(pos))
    chunk = F.floor(F.col("_r") / size)
    in_chunk = F.least(F.lit(size), F.col("_m") - chunk * size)
    name = lambda kind, cols, *more: F.concat_ws(":", F.lit(kind), *(F.col(c).cast("string") for c in cols), *more)
    cross = F.when(in_chunk >= 2, name("cross", position, chunk.cast("string"))) if size >= 2 else F.lit(None).cast("string")
    group = F.when(~F.col("_single"), name("native", native)).otherwise(cross)
    index = F.when(~F.col("_single"), F.col("_k")).otherwise(F.col("_r") % max(size, 1))
    return ranked.withColumn("candidate_group_id", group).withColumn("candidate_index", F.when(group.isNotNull(), index).cast("long")).drop("_n", "_single", "_k", "_r", "_m")


def assign_splits(sequences: DataFrame, splits: DataFrame) -> DataFrame:
    """One row per sequence and split. splits(split, kind 'session'|'subject', value); sessions rule if any is given.

    A sequence may be in several splits; one that is in none comes with a null split.
    """
    by_session = sequences.sparkSession.createDataFrame([(bool(splits.filter("kind = 'session'").take(1)),)], "_by boolean")
    key = F.when(F.col("_by"), F.col("session")).otherwise(F.col("subject"))
    keyed = sequences.crossJoin(F.broadcast(by_session)).withColumn("_value", key).withColumn("_kind", F.when(F.col("_by"), "session").otherwise("subject"))
    lists = splits.withColumnsRenamed({"kind": "_kind", "value": "_value"}).select("_kind", "_value", "split").distinct()
    return keyed.join(lists, ["_kind", "_value"], "left").drop("_by", "_kind", "_value")


def leave_one_session_out(windows: DataFrame, sessions: DataFrame) -> DataFrame:
    """Each window once per held-out session: split is test there and train elsewhere; blind windows go."""
    held = sessions.select(F.col("session").alias("fold")).distinct()
    seen = windows.filter("visible_frames > 0") if "visible_frames" in windows.columns else windows
    folds = F.array_sort(F.collect_set("fold"))
    every = seen.crossJoin(F.broadcast(held.agg(folds.alias("_folds")))).withColumn("fold", F.explode("_folds")).drop("_folds")
    return every.withColumn("split", F.when(F.col("session") == F.col("fold"), "test").otherwise("train")).withColumn("source_window_start", F.col("window_start")).withColumn("window_end", F.col("window_end") - F.col("window_start")).withColumn("window_start", F.lit(0).cast("long"))


def holdout_last_sessions(sequences: DataFrame, k: int, by: list[str], session: str = "session") -> DataFrame:
    """split = test for each group's last k sessions, else train."""
    rank = F.dense_rank().over(Window.partitionBy(*by).orderBy(F.desc(session)))
    return sequences.withColumn("split", F.when(rank <= k, "test").otherwise("train"))


def multi_candidate_only(windows: DataFrame, split: str = "test") -> DataFrame:
    """Rows of the split that have a candidate group, and all rows of other splits."""
    return windows.filter((F.col("split") != split) | blank_to_null("candidate_group_id").isNotNull())


def every_nth_frame(frames: DataFrame, n: int, frame: str = "frame_idx") -> DataFrame:
    return frames.filter(F.col(frame) % n == 0)


def duration_ok(start_s: Column, end_s: Column, seconds: float, fps: Column) -> Column:
    """Whether a window lasts `seconds`, within one frame; seconds must lie in (0, 10]."""
    if not 0 < seconds <= 10:
        raise ValueError("a window lasts more than 0 and at most 10 seconds")
    return F.abs(end_s - start_s - seconds) <= 1.0 / fps + 1e-6


def window_frames(windows: DataFrame, frames: DataFrame, keys: list[str], frame: str = "frame_idx") -> DataFrame:
    """The frames of each window: windows are expanded to frame numbers and joined by equality."""
    wide = windows.withColumn(frame, F.explode(F.expr("sequence(window_start, window_end - 1)")))
    return wide.join(frames, [*keys, frame])
