"""Archives of arrays as a Spark data source: partitions are ranges of rows of an archive's members.

archive_reader(spark).load(path) gives one of two layouts.

* long (the default): a row for each frame and person of each member named in `arrays`.
* wide: the schema given names the members: `path string, frame_idx long, acc array<float>, ...`. A row holds each member's
  frame, flattened; what is not declared is not read. A column of array<string> or of a plain type holds the whole member.

Only headers are read to plan, and a task reads the bytes of its rows (after unpacking what comes before them in a packed
member). Filters on `array` keep the other members from being planned. Files are opened through pyarrow's file systems.
"""

from __future__ import annotations

import fnmatch
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrameReader, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

#: Rows of a partition.
ROWS = 1 << 16
ARRAYS = ("imu", "gt_skeleton", "gt_skeleton_meters", "extract_skeleton", "gt_bboxes")
LONG = "path string, array string, person_idx int, frame_idx long, frame_id long, values array<float>"


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """A path's file system and its name there."""
    scheme = path.partition(":")[0] if ":" in path.partition("/")[0] else ""
    if scheme in ("", "file"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/") if scheme else path
    return pafs.FileSystem.from_uri(path)


def listed(path: str) -> list[str]:
    """The files of a folder, of a pattern in the last part of a path, or the file itself, in order."""
    system, name = located(path)
    prefix = path[: -len(name)] if path.endswith(name) else ""
    folder, _, last = name.rpartition("/")
    if any(c in last for c in "*?["):
        found = [f.path for f in system.get_file_info(pafs.FileSelector(folder or "/")) if f.is_file and fnmatch.fnmatch(f.base_name, last)]
    else:
        info = system.get_file_info(name)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [name] if info.is_file else [f.path for f in system.get_file_info(pafs.FileSelector(name, recursive=True)) if f.is_file and f.path.endswith(".npz")]
    return [prefix + f for f in sorted(found)]


@dataclass
class Member:
    """What the header of an archive's member says; rows of one kind of number in C order can be read by range."""

    shape: tuple[int, ...]
    dtype: np.dtype
    by_rows: bool

    @property
    def width(self) -> int:
        return int(np.prod(self.shape[1:], dtype=np.int64))


def _header(f) -> Member:
    version = np.lib.format.read_magic(f)
    shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    return Member(shape, dtype, bool(shape) and not dtype.hasobject and (not fortran or len(shape) == 1))


class Archive:
    """One open archive."""

    def __init__(self, path: str):
        system, name = located(path)
        self.zip = zipfile.ZipFile(system.open_input_file(name))
        self.names = {n.removesuffix(".npy"): n for n in self.zip.namelist()}

    def header(self, name: str) -> Member:
        with self.zip.open(self.names[name]) as f:
            return _header(f)

    def rows(self, name: str, start: int, end: int) -> np.ndarray:
        """Rows from start to before end, flattened, as floats."""
        with self.zip.open(self.names[name]) as f:
            member = _header(f)
            if not member.by_rows:
                return np.asarray(self.whole(name)[start:end], np.float32).reshape(end - start, -1)
            size = member.width * member.dtype.itemsize
            f.seek(start * size, 1)
            return np.frombuffer(f.read((end - start) * size), member.dtype).reshape(end - start, member.width)

    def whole(self, name: str) -> np.ndarray:
        from kinelink.sources.readers import open_array

        return open_array(self.zip.read(self.names[name]))


@dataclass
class Rows(InputPartition):
    path: str
    member: str | None
    start: int
    end: int


def _floats(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(values, np.float32).ravel()))


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "array_archive"

    def schema(self) -> str:
        return LONG

    def reader(self, schema: T.StructType) -> DataSourceReader:
        rows = int(self.options.get("rows", ROWS))
        if {f.name for f in schema.fields} == {c.split()[0] for c in LONG.split(", ")}:
            return _LongReader(self.options["path"], rows, tuple(a for a in self.options.get("arrays", ",".join(ARRAYS)).split(",") if a))
        return _WideReader(self.options["path"], rows, schema)


def archive_reader(spark: SparkSession) -> DataFrameReader:
    """A reader of archives; the session must let Python sources see filters, which is set here."""
    spark.dataSource.register(ArchiveSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(ArchiveSource.name())


class _LongReader(DataSourceReader):
    def __init__(self, path: str, rows: int, arrays: tuple[str, ...]):
        self.path, self.size, self.arrays = path, rows, arrays

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("array",):
                self.arrays = tuple(a for a in self.arrays if a == f.value)
            elif isinstance(f, In) and f.attribute == ("array",):
                self.arrays = tuple(a for a in self.arrays if a in f.value)
            else:
                yield f

    def partitions(self) -> list[Rows]:
        out = []
        for path in listed(self.path):
            archive = Archive(path)
            for name in self.arrays:
                if name in archive.names:
                    n = archive.header(name).shape[0]
                    out += [Rows(path, name, a, min(a + self.size, n)) for a in range(0, n, self.size)]
        return out or [Rows("", None, 0, 0)]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        if part.member is None:
            return
        archive = Archive(part.path)
        shape = archive.header(part.member).shape
        n, persons = part.end - part.start, shape[1] if len(shape) > 2 else 1
        values = archive.rows(part.member, part.start, part.end).reshape(n * persons, -1)
        ids = archive.rows("frame_ids", part.start, part.end)[:, 0].astype(np.int64) if "frame_ids" in archive.names else np.arange(part.start, part.end)
        yield pa.RecordBatch.from_arrays(
            [pa.array([part.path] * len(values), pa.string()), pa.array([part.member] * len(values), pa.string()), pa.array(np.tile(np.arange(persons, dtype=np.int32), n)), pa.array(np.repeat(np.arange(part.start, part.end), persons)), pa.array(np.repeat(ids, persons)), _floats(values)],
            ["path", "array", "person_idx", "frame_idx", "frame_id", "values"],
        )


class _WideReader(DataSourceReader):
    def __init__(self, path: str, rows: int, schema: T.StructType):
        self.path, self.size, self.fields = path, rows, schema.fields
        floats = T.ArrayType(T.FloatType())
        self.framed = [f.name for f in self.fields if f.dataType == floats]
        if not self.framed:
            raise ValueError("a wide schema names at least one member as array<float>")

    def partitions(self) -> list[Rows]:
        out = []
        for path in listed(self.path):
            archive = Archive(path)
            n = min(archive.header(name).shape[0] for name in self.framed)
            out += [Rows(path, "", a, min(a + self.size, n)) for a in range(0, n, self.size)]
        return out or [Rows("", None, 0, 0)]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        if part.member is None:
            return
        archive, n = Archive(part.path), part.end - part.start
        columns = []
        for f in self.fields:
            if f.name == "path":
                columns.append(pa.array([part.path] * n, pa.string()))
            elif f.name == "frame_idx":
                columns.append(pa.array(np.arange(part.start, part.end)))
            elif f.name in self.framed:
                columns.append(_floats(archive.rows(f.name, part.start, part.end)))
            else:
                value = archive.whole(f.name).tolist()
                value = [str(v) for v in value] if isinstance(f.dataType, T.ArrayType) else value
                columns.append(pa.array([value] * n))
        yield pa.RecordBatch.from_arrays(columns, [f.name for f in self.fields])
