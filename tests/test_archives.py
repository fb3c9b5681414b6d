"""The archive source: row ranges, packed and column-ordered members, declared columns, filters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelink.sources import archives, readers


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("archives")
    rng = np.random.default_rng(1)
    made = {}
    for i, save in enumerate((np.savez, np.savez_compressed)):
        made[f"a{i}.npz"] = {
            "imu": rng.normal(size=(11 + i, 3, 7)), "gt_bboxes": np.asfortranarray(rng.normal(size=(11 + i, 4))).astype(np.float32), "frame_ids": np.arange(11 + i) * 5,
            "names": np.array(["x", "y"]), "kind": np.array("walk"), "other": np.arange(4),
        }
        save(at / f"a{i}.npz", **made[f"a{i}.npz"])
    (at / "notes.txt").write_text("no archive")
    return at, made


@pytest.mark.parametrize("rows", [1, 4, 1000])
def test_long_rows(spark, folder, rows):
    at, made = folder
    got = archives.archive_reader(spark).option("rows", rows).load(str(at)).collect()
    want = {}
    for name, data in made.items():
        for key in ("imu", "gt_bboxes"):
            a = data[key] if data[key].ndim == 3 else data[key][:, None]
            want |= {(name, key, p, t): (5 * t, a[t, p]) for t in range(len(a)) for p in range(a.shape[1])}
    assert len(got) == len(want)
    for r in got:
        frame_id, values = want[r.path.rsplit("/", 1)[-1], r.array, r.person_idx, r.frame_idx]
        assert r.frame_id == frame_id and np.allclose(r["values"], values, atol=1e-6)


def test_partitions_follow_rows_and_filters(spark, folder):
    at, _ = folder
    reader = archives._LongReader(str(at), 4, archives.ARRAYS)
    assert len(reader.partitions()) == 2 * 3 * 2
    assert list(reader.pushFilters([archives.EqualTo(("array",), "imu"), archives.EqualTo(("person_idx",), 1)])) == [archives.EqualTo(("person_idx",), 1)]
    assert {p.member for p in reader.partitions()} == {"imu"}
    only = readers.import_array_archive(spark, str(at)).filter("array = 'imu' and person_idx = 2")
    assert only.count() == 23
    assert readers.import_array_archive(spark, str(at)).filter(F.col("array").isin("nothing")).count() == 0
    assert readers.import_array_archive(spark, str(at), ()).count() == 0


def test_wide_rows_read_what_is_declared(spark, folder):
    at, made = folder
    schema = "path string, frame_idx long, imu array<float>, names array<string>, kind string"
    got = archives.archive_reader(spark).schema(schema).option("rows", 5).load(str(at / "a*.npz")).collect()
    assert len(got) == 23 and {(tuple(r["names"]), r.kind) for r in got} == {(("x", "y"), "walk")}
    for r in got:
        assert np.allclose(r.imu, made[r.path.rsplit("/", 1)[-1]]["imu"][r.frame_idx].ravel(), atol=1e-6)
    with pytest.raises(Exception, match="no sensor|array<float>|KeyError"):
        archives.archive_reader(spark).schema("path string, frame_idx long").load(str(at)).count()


def test_missing_files_and_sensors_are_told(spark, tmp_path):
    with pytest.raises(Exception, match="nothing"):
        readers.import_array_archive(spark, str(tmp_path / "nothing.npz")).count()
    assert archives.listed(str(tmp_path / "*.npz")) == []
    np.savez(tmp_path / "s_aria1.npz", sensor_names=np.array(["L"]), acc=np.ones((2, 1, 3)), quat=np.ones((2, 1, 4)), pose2d=np.ones((2, 17, 2)), pose2d_mask=np.ones((2, 17)))
    with pytest.raises(Exception, match="no sensor R"):
        readers.read_person_cache(spark, str(tmp_path / "s_aria1.npz"), "R").collect()
