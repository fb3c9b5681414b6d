"""Readers of text files over a folder of files and over a table of the same texts."""

import json

import pytest

from kinelink.plans import catalog
from kinelink.sources import readers, sinks

SF = "/root/testdata/sf0.001"
MOT = {"a": "12, 1, 5, 6, 2, 3, 0.5, -1\n\n10,2,1,2,3,4,0.25,-1\r\n11,9,9,9,9,9\n", "b": "7,3,1,1,1,1,1", "c": ""}
ENTRIES = {n: json.dumps([{"image_id": f"d/{k}.jpg", "idx": k % 2, "box": [k, 1.5, 20, 30], "keypoints": [0.5 * k] * 51, "score": 0.5} for k in ks]) for n, ks in (("a", range(4)), ("b", (9, 8)))}


@pytest.mark.parametrize("texts, read", [(MOT, readers.read_mot_tracks), (ENTRIES, readers.read_pose_tracks), (ENTRIES, lambda s, p: readers.read_pose_tracks(s, p, "first"))])
def test_a_table_of_texts_reads_like_its_files(spark, tmp_path, texts, read):
    (tmp_path / "files").mkdir()
    for name, text in texts.items():
        (tmp_path / "files" / name).write_text(text, newline="")
    sinks.write_texts(spark.createDataFrame(list(texts.items()), "path string, value string").coalesce(1), str(tmp_path / "table"))
    own = lambda df: sorted(repr(r.asDict(True) | {"path": r.path.rsplit("/", 1)[-1]}) for r in df.collect())
    got = own(read(spark, spark.read.parquet(str(tmp_path / "table"))))
    assert got and got == own(read(spark, str(tmp_path / "files")))


def test_mot_frames_count_from_the_first_of_each_text(spark):
    df = spark.createDataFrame(list(MOT.items()), "path string, value string")
    assert sorted((r.path, r.frame_idx, r.track_id, r.score) for r in readers.read_mot_tracks(spark, df).collect()) == [("a", 0, 2, 0.25), ("a", 2, 1, 0.5), ("b", 0, 3, 1.0)]


def test_query_writes_no_file_for_each_sequence(spark):
    """Texts of many sequences share a file, and reading them needs no shuffle."""
    df = catalog.QUERIES["read_mot_tracks"](spark, SF)
    assert len(df.inputFiles()) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
