"""Readers of raw recordings, detections, annotations and records into typed tables.

Text and CSV files are parsed by column expressions. Archives of arrays are a data source of their own (`archives`). Every table carries `path`, the file a row is from.
"""

from __future__ import annotations

import io
import json
import pickle
import zipfile
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinelink.sources.archives import ARRAYS, archive_reader

# Headers of the device's CSV files, gravity, box joints.
CSV_HEADERS = {"epoch_ms": "ts_ms", "四元数0()": "quat_w", "四元数1()": "quat_x", "四元数2()": "quat_y", "四元数3()": "quat_z", "加速度X(g)": "acc_x", "加速度Y(g)": "acc_y", "加速度Z(g)": "acc_z"}
GYRO_PREFIXES = {"gyro_x": ("角速度x", "gyro_x", "gyrox"), "gyro_y": ("角速度y", "gyro_y", "gyroy"), "gyro_z": ("角速度z", "gyro_z", "gyroz")}
GRAVITY = 9.80665
KEYPOINTS = 51


def whole_texts(spark: SparkSession, path) -> DataFrame:
    """(path, value): the whole text of every file. `path` may be such a table itself (`sinks.write_texts`): files too many to be listed and opened one by one are gathered once."""
    if isinstance(path, DataFrame):
        return path.select("path", "value")
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value"))


def _kept(value: str) -> Column:
    """A text's non-blank lines, trimmed."""
    return F.filter(F.transform(F.split(value, "\r\n|\n|\r"), lambda x: F.trim(x)), lambda x: x != "")


def _lines(spark: SparkSession, path) -> DataFrame:
    """(path, n, line): non-blank lines, trimmed, numbered from 0."""
    return whole_texts(spark, path).select("path", F.posexplode(_kept("value")).alias("n", "line"))


def _number(c: Column) -> Column:
    return c.try_cast("double")


def _sensor_blocks(spark: SparkSession, path) -> DataFrame:
    """(path, frame, tokens) of sensor rows: blocks of a heading and as many rows as the first line says; a cut last block goes."""
    lines = _lines(spark, path)
    head = lines.filter("n = 0").select("path", F.split("line", r"\s+")[0].cast("int").alias("k"))
    size = lines.groupBy("path").agg(F.count(F.lit(1)).alias("total"))
    block = lines.filter("n > 0").join(head, "path").join(size, "path").withColumn("frame", F.floor((F.col("n") - 1) / (F.col("k") + 1))).withColumn("at", (F.col("n") - 1) % (F.col("k") + 1))
    return block.filter("at > 0 and 1 + (frame + 1) * (k + 1) <= total").select("path", "frame", "at", F.split("line", r"\s+").alias("tokens"))


def read_xsens_sensors(spark: SparkSession, path, sensors: list[str]) -> DataFrame:
    """(path, frame_idx, sensor, quat array, acc array): frames that lack a chosen sensor are left out and later ones move up."""
    rows = _sensor_blocks(spark, path).filter(F.size("tokens") >= 8).withColumn("sensor", F.col("tokens")[0]).filter(F.col("sensor").isin(sensors))
    last = rows.groupBy("path", "frame", "sensor").agg(F.max_by("tokens", "at").alias("tokens"))
    whole = last.groupBy("path", "frame").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == len(set(sensors)))
    placed = whole.withColumn("frame_idx", (F.row_number().over(Window.partitionBy("path").orderBy("frame")) - 1).cast("long"))
    value = lambda a, n: F.transform(F.slice("tokens", a, n), lambda t: t.cast("double"))
    return last.join(placed, ["path", "frame"]).select("path", "frame_idx", "sensor", value(2, 4).alias("quat"), value(6, 3).alias("acc"))


def read_xsens_aux(spark: SparkSession, path, sensor: str = "L_LowArm", rate: float = 60.0) -> DataFrame:
    """(path, frame_idx, ts_s, acc array, gyro array) of one sensor; a frame without it is an error."""
    rows = _sensor_blocks(spark, path)
    frames = rows.select("path", "frame").distinct()
    own = rows.filter(F.col("tokens")[0] == sensor).select("path", "frame", "tokens")
    both = frames.join(own, ["path", "frame"], "left")
    checked = both.withColumn("tokens", F.when(F.assert_true(F.coalesce(F.size("tokens"), F.lit(0)) >= 14, F.concat(F.lit(f"a frame lacks {sensor}: "), "path", F.lit(" "), F.col("frame").cast("string"))).isNull(), F.col("tokens")))
    value = lambda a: F.transform(F.slice("tokens", a, 3), lambda t: t.cast("double"))
    return checked.select("path", F.col("frame").cast("long").alias("frame_idx"), (F.col("frame") / rate).alias("ts_s"), value(6).alias("acc"), value(9).alias("gyro"))


def read_vicon_positions(spark: SparkSession, path) -> DataFrame:
    """(path, frame_idx, joint, name, x, y, z): rows that don't hold three numbers for each joint vanish and later ones move up."""
    lines = _lines(spark, path)
    cells = lambda c: F.filter(F.split(c, "\t"), lambda x: x != "")
    head = lines.filter("n = 0").select("path", cells("line").alias("names"))
    rows = lines.filter("n > 0").join(head, "path").withColumn("cells", F.slice(cells("line"), 1, F.size("names"))).filter(F.size("cells") == F.size("names"))
    parts = rows.withColumn("parts", F.transform("cells", lambda c: F.split(F.trim(c), r"\s+"))).filter(F.forall("parts", lambda p: F.size(p) == 3))
    placed = parts.withColumn("frame_idx", (F.row_number().over(Window.partitionBy("path").orderBy("n")) - 1).cast("long"))
    each = placed.select("path", "frame_idx", F.posexplode(F.arrays_zip("names", "parts")).alias("joint", "_z"))
    return each.select("path", "frame_idx", "joint", F.col("_z.names").alias("name"), *(F.col("_z.parts")[i].cast("double").alias(a) for i, a in enumerate("xyz")))


def _csv(spark: SparkSession, path) -> DataFrame:
    """A CSV with header, all strings, byte-order marks off the names, and the file and row order."""
    raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(path).withColumn("path", F.col("_metadata.file_path"))
    return raw.withColumnsRenamed({c: c.lstrip("﻿") for c in raw.columns})


def read_imu_csv(spark: SparkSession, path, with_gyro: bool = False) -> DataFrame:
    """(path, ts_ms, quat_*, acc_* in m/s2, gyro_* in rad/s): exact headers, but gyro columns by prefix in any case."""
    raw = _csv(spark, path)
    missing = [h for h in CSV_HEADERS if h not in raw.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing; there are {raw.columns}")
    scale = lambda n: GRAVITY if n.startswith("acc") else 1.0
    columns = [(F.col(f"`{h}`").cast("double") * scale(n)).alias(n) for h, n in CSV_HEADERS.items()]
    for name, prefixes in GYRO_PREFIXES.items() if with_gyro else ():
        found = next((c for c in raw.columns if c.strip().lower().startswith(prefixes)), None)
        if found is None:
            raise ValueError(f"no column starts with {prefixes}; there are {raw.columns}")
        columns.append(F.radians(F.col(f"`{found}`").cast("double")).alias(name))
    return raw.select("path", *columns)


def read_imu_csv_series(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Segment files on one time line: sorted by epoch, the first row of equal times in order of files; ts_s counts from the first sample."""
    parts = [read_imu_csv(spark, p, True).withColumn("_file", F.lit(i)).withColumn("_row", F.monotonically_increasing_id()) for i, p in enumerate(paths)]
    every = reduce(DataFrame.unionByName, parts)
    first = every.withColumn("_k", F.row_number().over(Window.partitionBy("ts_ms").orderBy("_file", "_row"))).filter("_k = 1")
    span = first.agg(F.min("ts_ms").alias("_t0"), F.count(F.lit(1)).alias("_n"))
    based = first.crossJoin(F.broadcast(span))
    enough = F.assert_true(F.col("_n") >= 2, F.lit("a series needs two samples"))
    return based.withColumn("ts_s", F.when(enough.isNull(), (F.col("ts_ms") - F.col("_t0")) / 1000)).drop("_file", "_row", "_k", "_t0", "_n")


def read_frame_timestamps(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(session, frame_id, ts_ms) of <session>_frame_timestamps files, the retimed one where there are both; frames count from 0."""
    raw = _csv(spark, paths)
    # a CSV that Spark wrote is a folder of parts
    file = lambda g: F.regexp_extract("path", r"([^/=]+?)_frame_timestamps(_retimed)?\.csv(?:/[^/]*)?$", g)
    ranked = raw.withColumn("session", file(1)).withColumn("_k", F.dense_rank().over(Window.partitionBy("session").orderBy(F.when(file(2) != "", 0).otherwise(1))))
    return ranked.filter("_k = 1").select("session", (F.col("frame_index").cast("long") - 1).alias("frame_id"), F.col("timestamp_ms").cast("double").alias("ts_ms"))


def frame_times(frames: DataFrame, times: DataFrame) -> DataFrame:
    """Frames with their times; one that is missing is an error."""
    joined = frames.join(times, ["session", "frame_id"], "left")
    return joined.withColumn("ts_ms", F.when(F.assert_true(F.col("ts_ms").isNotNull(), F.concat(F.lit("no time for frame "), F.col("frame_id").cast("string"))).isNull(), F.col("ts_ms")))


def read_box_annotations(spark: SparkSession, path, people: int = 2) -> DataFrame:
    """(path, ts_ms, person_idx, bbox, visible) from one row per time with columns p1_, p2_ and so on."""
    raw = _csv(spark, path)

    def person(p: int) -> Column:
        v = lambda n: F.col(f"p{p + 1}_{n}")
        x, y, w, h = (v(f"bbox_{n}").cast("double") for n in "xywh")
        box = F.struct(x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + h).alias("y2"))
        return F.struct(F.lit(p).alias("person_idx"), box.alias("bbox"), (~F.trim(v("is_absent")).isin("1", "true", "True")).alias("visible"))

    each = raw.select("path", F.col("timestamp_ms").cast("double").alias("ts_ms"), F.explode(F.array(*map(person, range(people)))).alias("_p"))
    return each.select("path", "ts_ms", "_p.*")


_ENTRY = "image_id STRING, imgname STRING, idx STRING, box ARRAY<DOUBLE>, keypoints ARRAY<DOUBLE>, score DOUBLE"


def _entries(spark: SparkSession, path, nested: bool = False) -> DataFrame:
    """(path, ord, fields) of JSON lists of detections; idx is its JSON text. With nested, lists under result are opened."""
    whole = whole_texts(spark, path).select("path", F.posexplode(F.from_json("value", "array<string>")).alias("ord", "text"))
    if nested:
        parts = F.from_json("text", "struct<imgname:string,image_id:string,result:array<string>>")
        opened = whole.withColumn("_n", parts)
        image = F.coalesce("_n.imgname", "_n.image_id", F.col("ord").cast("string"))
        each = opened.select("path", "ord", F.when(F.col("_n.result").isNotNull(), image).alias("outer_image"), F.explode(F.coalesce("_n.result", F.array("text"))).alias("text"), F.monotonically_increasing_id().alias("_i"))
        whole = each.withColumn("ord", F.row_number().over(Window.partitionBy("path").orderBy("ord", "_i")) - 1).drop("_i")
    fields = F.from_json("text", _ENTRY)
    out = whole.withColumn("_e", fields)
    image = F.coalesce(F.col("outer_image"), F.col("_e.image_id")) if nested else F.col("_e.image_id")
    return out.select("path", "ord", image.alias("image_id"), F.coalesce(F.get_json_object("text", "$.idx"), F.lit("0")).alias("idx"), "_e.box", "_e.keypoints", F.coalesce("_e.score", F.lit(0.0)).alias("score"), F.col("text"))


def _stem(c: str) -> Column:
    return F.regexp_replace(F.regexp_extract(c, r"([^/\\]+)$", 1), r"\.[^.]*$", "")


def _xywh(c: str) -> Column:
    b = F.when(F.size(c) >= 4, F.col(c)).otherwise(F.array_repeat(F.lit(0.0), 4))
    return F.struct(b[0].alias("x1"), b[1].alias("y1"), (b[0] + b[2]).alias("x2"), (b[1] + b[3]).alias("y2"))


def _joints(c: str = "keypoints") -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(16)), lambda i: F.struct(F.get(c, 3 * i).alias("x"), F.get(c, 3 * i + 1).alias("y"), F.get(c, 3 * i + 2).alias("z")))


def _first_id(c: str) -> Column:
    """First id of a list, or the id itself."""
    return F.regexp_extract(c, r"-?\d+", 0).try_cast("long")


def read_pose_tracks(spark: SparkSession, path, policy: str = "expand") -> DataFrame:
    """Detections from JSON by one of four policies.

    expand: a row for each id of a list; a frame name that is no number is frame 0; of an id's rows in a frame the last counts.
    atomic: the id's JSON text is the label; other frame names are passed over; of a label's rows in a frame the
        best score counts, then the first; first_ord tells where the label was first seen.
    first: the first id of a list, nested lists opened; the frame is the last number in the name, else the row's; corner boxes.
    sized: the first id; boxes must be larger than one pixel.
    """
    if policy not in ("expand", "atomic", "first", "sized"):
        raise ValueError(f"unknown policy {policy!r}")
    e = _entries(spark, path, nested=policy == "first")
    whole = F.size("keypoints") >= KEYPOINTS
    number = _stem("image_id").try_cast("long")
    if policy == "expand":
        ids = F.from_json(F.when(F.startswith("idx", F.lit("[")), F.col("idx")).otherwise(F.concat(F.lit("["), "idx", F.lit("]"))), "array<bigint>")
        # the joints are made first: beside an explode the names inside a lambda's struct are lost
        made = e.filter(whole).select("path", "ord", F.coalesce(number, F.lit(0)).alias("frame_id"), ids.alias("_ids"), _xywh("box").alias("bbox"), "score", _joints().alias("joints"))
        rows = made.select("path", "ord", "frame_id", F.explode("_ids").alias("track_id"), "bbox", "score", "joints")
        w = Window.partitionBy("path", "frame_id", "track_id").orderBy(F.desc("ord"))
        return rows.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
    if policy == "atomic":
        rows = e.filter(whole & number.isNotNull()).withColumn("track_label", F.regexp_replace("idx", r"\s+", "")).withColumn("first_ord", F.min("ord").over(Window.partitionBy("path", "track_label")))
        finite = F.forall(F.slice("keypoints", 1, KEYPOINTS), lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
        w = Window.partitionBy("path", "frame_id", "track_label").orderBy(F.desc("score"), "ord")
        good = rows.filter(finite).withColumn("frame_id", number).withColumn("_k", F.row_number().over(w)).filter("_k = 1")
        return good.select("path", "ord", "frame_id", "track_label", "first_ord", _xywh("box").alias("bbox"), "score", _joints().alias("joints"))
    if policy == "first":
        digits = F.regexp_extract_all(_stem("image_id"), F.lit(r"(\d+)"), F.lit(1))
        frame = F.coalesce(F.element_at(F.when(F.size(digits) > 0, digits), -1).try_cast("long"), F.col("ord").cast("long"))
        b = F.col("box")
        rows = e.filter((F.size("box") == 4) & _first_id("idx").isNotNull())
        return rows.select("path", "ord", frame.alias("frame_id"), _first_id("idx").alias("track_id"), ((b[0] + b[2]) / 2).alias("cx"), ((b[1] + b[3]) / 2).alias("cy"), F.abs(b[2] - b[0]).alias("w"), F.abs(b[3] - b[1]).alias("h"))
    b = F.col("box")
    ok = (F.size("box") >= 4) & (b[2] > 1) & (b[3] > 1) & number.isNotNull()
    return e.filter(ok).select("path", "ord", number.alias("frame_id"), _first_id("idx").alias("track_id"), _xywh("box").alias("bbox"), "score")


def read_mot_tracks(spark: SparkSession, path) -> DataFrame:
    """(path, frame_idx, track_id, bbox, score): comma-separated rows of seven fields or more, frames counted from the first one of the text."""
    v = lambda p, i: F.trim(p[i]).cast("double")
    rows = F.filter(F.transform(_kept("value"), lambda x: F.split(x, ",")), lambda p: F.size(p) >= 7)
    held = whole_texts(spark, path).select("path", rows.alias("_rows")).withColumn("_first", F.array_min(F.transform("_rows", lambda p: v(p, 0).cast("long"))))
    each, p = held.select("path", "_first", F.explode("_rows").alias("_p")), F.col("_p")
    box = F.struct(v(p, 2).alias("x1"), v(p, 3).alias("y1"), (v(p, 2) + v(p, 4)).alias("x2"), (v(p, 3) + v(p, 5)).alias("y2"))
    return each.select("path", v(p, 1).cast("long").alias("track_id"), box.alias("bbox"), v(p, 6).alias("score"), (v(p, 0).cast("long") - F.col("_first")).alias("frame_idx"))


WINDOW_SCHEMA = "subject STRING, session STRING, split STRING, npz_path STRING, window_start LONG, window_end LONG, window_len LONG, skeleton_source STRING, person_idx INT, imu_idx INT, source_sequence STRING, source_person INT, source_window_start LONG, candidate_group_id STRING, candidate_index INT"


def read_windows(spark: SparkSession, path) -> DataFrame:
    """The window index, typed by column name; blank cells and columns that are not there are null."""
    raw = _csv(spark, path)
    cell = lambda n: F.nullif(F.trim(f"`{n}`"), F.lit("")) if n in raw.columns else F.lit(None).cast("string")
    return raw.select("path", *(cell(n).cast(t).alias(n) for n, t in (f.strip().split() for f in WINDOW_SCHEMA.split(","))))


def union_domains(parts: list[tuple[str, float, list[str] | None, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """(rows, audit) of several datasets: (name, fps, sessions or None for all, windows); the audit counts kept and passed rows."""
    kept, audits = [], []
    for name, fps, sessions, df in parts:
        keep = F.lit(True) if sessions is None else F.col("session").isin(sessions)
        marked = df.withColumn("_keep", F.coalesce(keep, F.lit(False)))
        kept.append(marked.filter("_keep").drop("_keep").withColumn("dataset", F.lit(name)).withColumn("fps_hz", F.lit(float(fps))))
        audits.append(marked.agg(F.count_if("_keep").alias("kept"), F.count_if(~F.col("_keep")).alias("skipped")).withColumn("dataset", F.lit(name)))
    union = lambda xs: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), xs)
    return union(kept), union(audits)


def attach_gyro_sidecar(frames: DataFrame, sidecar: DataFrame, skip_missing: bool = False) -> DataFrame:
    """Frames with acceleration and gyro by file name, else by sequence id; missing ones are an error unless skipped.

    frames(file, sequence_id, imu_idx, frame_idx), sidecar(name, imu_idx, frame_idx, acc array, gyro array).
    """
    names = sidecar.select("name").distinct()
    by_file = frames.select("file", "sequence_id").distinct().join(names.withColumn("file", F.col("name")).withColumnRenamed("name", "_f"), "file", "left").join(names.withColumn("sequence_id", F.col("name")).withColumnRenamed("name", "_s"), "sequence_id", "left")
    chosen = by_file.select("file", "sequence_id", F.coalesce("_f", "_s").alias("name"))
    joined = frames.join(chosen, ["file", "sequence_id"]).join(sidecar, ["name", "imu_idx", "frame_idx"], "left")
    if skip_missing:
        return joined.filter("acc is not null")
    return joined.withColumn("acc", F.when(F.assert_true(F.col("acc").isNotNull(), F.concat(F.lit("no sidecar for "), "file")).isNull(), F.col("acc")))


def read_run_records(spark: SparkSession, path, schema: str, completed_only: bool = False, multi_line: bool = True) -> DataFrame:
    """Run records from JSON files in any depth, one a file, or one a line without multi_line; none at all is an error.

    completed_only also asks for a total above 0.
    """
    records = spark.read.schema(schema).option("recursiveFileLookup", True).option("multiLine", multi_line).option("pathGlobFilter", "*.json").json(path).withColumn("path", F.col("_metadata.file_path"))
    if records.isEmpty():
        raise ValueError(f"no run records under {path}")
    return records.filter("status = 'completed' and frame_acc.total > 0") if completed_only else records


def inventory_files(spark: SparkSession, roots: dict[str, str], sample: str = "all", k: int = 3) -> DataFrame:
    """(source, path, length, modified, sha256, status): a root without files is one row 'missing'; empty files are not listed.

    sample: all, first (k by name), ends (first, middle, last) or even (k evenly spaced).
    """
    parts = []
    for name, root in roots.items():
        try:
            files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
            files = files.select(F.lit(name).alias("source"), "path", "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"), F.lit("present").alias("status"))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            files = spark.createDataFrame([(name, None, None, None, None, "missing")], "source string, path string, length long, modified timestamp, sha256 string, status string")
        parts.append(files)
    every = reduce(DataFrame.unionByName, parts)
    if sample == "all":
        return every
    w = Window.partitionBy("source")
    placed = every.withColumn("_i", F.row_number().over(w.orderBy("path")) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    keep = {"first": F.col("_i") < k, "ends": F.col("_i").isin(0) | (F.col("_i") == F.floor(F.col("_n") / 2)) | (F.col("_i") == F.col("_n") - 1), "even": F.array_contains(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.floor(j * (F.col("_n") - 1) / max(k - 1, 1))), F.col("_i").cast("long"))}[sample]
    return placed.filter(keep).drop("_i", "_n")


class _Plain(pickle.Unpickler):
    """Opens object arrays of plain values only."""

    _ALLOWED = {("numpy", "ndarray"), ("numpy", "dtype"), *((f"numpy.{c}.multiarray", n) for c in ("core", "_core") for n in ("_reconstruct", "scalar"))}

    def find_class(self, module: str, name: str):
        if (module, name) not in self._ALLOWED:
            raise pickle.UnpicklingError(f"{module}.{name} is not opened")
        return super().find_class(module, name)


def open_array(raw: bytes) -> np.ndarray:
    """A .npy file; object arrays may hold plain values only."""
    f = io.BytesIO(raw)
    version = np.lib.format.read_magic(f)
    shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    if dtype.hasobject:
        return _Plain(f).load()
    out = np.frombuffer(f.read(), dtype, count=int(np.prod(shape, dtype=np.int64)))
    return out.reshape(shape[::-1]).T if fortran else out.reshape(shape)


def open_archive(raw: bytes) -> dict[str, np.ndarray]:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        return {n.removesuffix(".npy"): open_array(z.read(n)) for n in z.namelist()}


def _contents(spark: SparkSession, path) -> DataFrame:
    """(path, content) of files; a DataFrame with these columns stands for files that were read already."""
    return path.select("path", "content") if isinstance(path, DataFrame) else spark.read.format("binaryFile").load(path).select("path", "content")


def import_array_archive(spark: SparkSession, path: str, arrays: tuple[str, ...] = ARRAYS) -> DataFrame:
    """(path, array, person_idx, frame_idx, frame_id, values) of recordings' arrays, axis 0 time and axis 1 persons.

    A two-dimensional array belongs to person 0. Files are read through `archives`, by ranges of an array's rows.
    """
    return archive_reader(spark).option("arrays", ",".join(arrays)).load(path)


def import_archive_metadata(spark: SparkSession, path) -> DataFrame:
    """(path, key, value): each archive's texts and short lists as JSON."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, raw in zip(batch["path"], batch["content"]):
                data = open_archive(raw)
                plain = {k: v for k, v in data.items() if v.dtype.kind in "OUS" or v.ndim == 0 or v.ndim == 1 and v.size <= 64}
                yield pd.DataFrame({"path": name, "key": list(plain), "value": [json.dumps(v.tolist(), ensure_ascii=False, default=str) for v in plain.values()]}, columns=["path", "key", "value"])

    return _contents(spark, path).mapInPandas(decode, "path string, key string, value string")


def read_person_cache(spark: SparkSession, path: str, sensor: str, sessions: list[str] | None = None) -> DataFrame:
    """(session, person_id, frame_idx, acc, quat, pose2d, visible) of archives named <session>_aria<id>.npz with sensor_names.

    All persons of a session are cut to the shortest; the sensor must exist.
    """
    members = "acc array<float>, quat array<float>, pose2d array<float>, pose2d_mask array<float>, sensor_names array<string>"
    cached = archive_reader(spark).schema(f"path string, frame_idx long, {members}").load(path)
    k = F.array_position("sensor_names", sensor)
    known = F.when(k > 0, k).otherwise(F.raise_error(F.concat("path", F.lit(f" has no sensor {sensor}; it has "), F.array_join("sensor_names", ", "))).cast("long"))
    part = lambda c, width: F.slice(c, ((F.col("_k") - 1) * width + 1).cast("int"), width)
    name = F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1)
    session, person = F.regexp_extract(name, r"^(.*)_aria([^_]*)$", 1), F.regexp_extract(name, r"^(.*)_aria([^_]*)$", 2)
    rows = cached.withColumn("_k", known).select(session.alias("session"), person.cast("int").alias("person_id"), "frame_idx", part("acc", 3).alias("acc"), part("quat", 4).alias("quat"), "pose2d", F.transform("pose2d_mask", lambda v: v > 0).alias("visible"))
    rows = rows if sessions is None else rows.filter(F.col("session").isin(sessions))
    ends = rows.groupBy("session", "person_id").agg(F.max("frame_idx").alias("_e")).groupBy("session").agg(F.min("_e").alias("_e"))
    return rows.join(ends, "session").filter("frame_idx <= _e").drop("_e")


def concat_split_series(parts: DataFrame, keys: list[str], target: int | None = None, mode: str = "full") -> DataFrame:
    """Series that were saved as train, val and test parts, joined in time; rows(keys, split, frame_idx, values array).

    Without all three parts only test counts. target cuts or pads with zeros: at the end for 'full', at the front
    for 'test', which takes the test part alone.
    """
    have = F.size(F.collect_set("split").over(Window.partitionBy(*keys)))
    use = (F.col("split") == "test") if mode == "test" else (F.col("split") == "test") | (F.col("_have") == 3)
    kept = parts.withColumn("_have", have).filter(use)
    order = F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1).otherwise(2)
    placed = kept.withColumn("frame_idx", F.row_number().over(Window.partitionBy(*keys).orderBy(order, "frame_idx")) - 1).select(*keys, F.col("frame_idx").cast("long").alias("frame_idx"), "values")
    if target is None:
        return placed
    size = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(F.size("values")).alias("_w"))
    shift = F.greatest(F.lit(target) - F.col("_n"), F.lit(0)) if mode == "test" else F.lit(0)
    moved = placed.join(size, keys).withColumn("frame_idx", (F.col("frame_idx") + shift).cast("long")).select(*keys, "frame_idx", "values")
    grid = size.select(*keys, "_w", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(target - 1).cast("long"))).alias("frame_idx"))
    return grid.join(moved, [*keys, "frame_idx"], "left").select(*keys, "frame_idx", F.coalesce("values", F.array_repeat(F.lit(0.0), F.col("_w"))).alias("values"))
