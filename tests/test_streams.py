"""Streams against their batch folds over several batches, and the end of idle state."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinelink.functions import layouts
from kinelink.operators import history, scans
from kinelink.streaming import matching


def run(spark, frames, tmp_path, build, schema):
    """What the stream emits when each pandas frame is one batch, and where it keeps its state."""
    for i, pdf in enumerate(frames):
        spark.createDataFrame(pdf, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out = build(stream)
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(str(tmp_path / "out")), str(tmp_path / "state")


def kept(spark, state, variable, key):
    return {getattr(r.key, key) for r in spark.read.format("statestore").option("stateVarName", variable).load(state).collect()}


SCORES = "session string, window_end timestamp, imu_idx long, track string, score double"


def score_rows(session, seconds, rng):
    return [(session, pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=s), i, f"t{t}", float(rng.uniform())) for s in seconds for i in range(3) for t in range(3) if (s + t) % 4]


def test_matching_over_batches_equals_the_fold_and_idle_sessions_end(spark, tmp_path):
    rng = np.random.default_rng(5)
    columns = [c.split()[0] for c in SCORES.split(", ")]
    batches = [score_rows("a", range(0, 20), rng) + score_rows("b", range(5, 9), rng), score_rows("a", range(20, 40), rng), score_rows("a", range(200, 210), rng), score_rows("a", range(400, 410), rng)]
    frames = [pd.DataFrame(b, columns=columns).sample(frac=1, random_state=1) for b in batches]
    out, state = run(spark, frames, tmp_path, lambda s: matching.realtime_match(s, "2 seconds", decay=0.1, threshold=0.2, idle="100 seconds"), SCORES)
    every = spark.createDataFrame(pd.concat(frames), SCORES).withColumn("w", F.unix_millis("window_end"))
    # the watermark moves on by more than the idle time between batches, so the evidence of "a" starts anew at 200 s and at 400 s
    spells = every.withColumn("spell", F.when(F.col("w") % 86400000 < 100000, 0).when(F.col("w") % 86400000 < 300000, 1).otherwise(2))
    want = {(r.session, r.w, r.track, r.imu_idx): r.accumulated for r in history.history_scores(spells, ["session", "spell"], "w", decay=0.1, threshold=0.2).collect()}
    got = out.collect()
    assert {(r.session, r.window_end_ms % 86400000) for r in got} == {("a", 1000 * s) for s in [*range(40), *range(200, 210), *range(400, 408)]} | {("b", 1000 * s) for s in range(5, 9)}
    first = [r for r in got if r.window_end_ms % 86400000 < 100000]
    assert first and all(r.accumulated == pytest.approx(want[r.session, r.window_end_ms, r.track, r.imu_idx]) for r in first if r.track)
    assert kept(spark, state, "waiting", "session") == {"a"} and kept(spark, state, "timer", "session") == {"a"}
    assert {r.key.session for r in spark.read.format("statestore").option("stateVarName", "history").load(state).collect()} == {"a"}


def test_attitude_state_of_an_idle_device_ends(spark, tmp_path):
    rng = np.random.default_rng(6)
    names = [*layouts.ACC, *layouts.GYRO, *layouts.QUAT]
    rows = lambda device, seconds: [(device, pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=s), *map(float, rng.normal(size=10))) for s in seconds]
    schema = f"device string, ts timestamp, {', '.join(f'{n} double' for n in names)}"
    frames = [pd.DataFrame(b, columns=["device", "ts", *names]) for b in (rows("x", range(10)) + rows("y", range(10)), rows("x", range(10, 20)), rows("x", range(90, 95)), rows("x", range(95, 100)))]
    build = lambda s: matching.madgwick_stream(s, "device", "ts", list(layouts.ACC), list(layouts.GYRO), list(layouts.QUAT), delay="1 second", idle="30 seconds")
    out, state = run(spark, frames, tmp_path, build, schema)
    assert out.filter("device = 'y'").count() == 10 and out.filter("device = 'x'").count() >= 25
    norm = out.select(F.sqrt(sum(F.col(q) ** 2 for q in layouts.QUAT)).alias("n")).collect()
    assert all(r.n == pytest.approx(1) for r in norm)
    assert kept(spark, state, "attitude", "device") == {"x"}


def test_affine_scan_equals_a_loop_whatever_the_segments(spark):
    rng = np.random.default_rng(7)
    rows = [(k, int(o), float(rng.choice([0.0, 0.5, 1.0])), float(rng.normal())) for k, n in ((1, 300), (2, 1), (None, 40)) for o in rng.permutation(n * 3)[:n] - 50]
    df = spark.createDataFrame(rows, "k int, o long, a double, b double").repartition(5)
    want = {}
    for k in (1, 2, None):
        h = 0.0
        for _, o, a, b in sorted(r for r in rows if r[0] == k) if k else sorted((0, *r[1:]) for r in rows if r[0] is None):
            h = a * h + b
            want[k, o] = h
    for segment in (1, 7, 64, 1000):
        got = scans.affine_scan(df, ["k"], "o", F.col("a"), F.col("b"), "h", segment).collect()
        assert len(got) == len(rows) and all(r.h == pytest.approx(want[r.k, r.o], abs=1e-12) for r in got)
    assert scans.affine_scan(df.limit(0), ["k"], "o", F.col("a"), F.col("b"), "h").collect() == []


def test_a_row_of_many_cells_is_decided_like_a_row_for_each(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = pd.DataFrame(score_rows("a", range(0, 12), rng) + score_rows("b", range(3, 9), rng), columns=[c.split()[0] for c in SCORES.split(", ")])
    packed = rows.groupby(["session", "window_end"]).agg(list).reset_index()
    found = []
    for name, frame, schema in (("rows", rows, SCORES), ("packed", packed, "session string, window_end timestamp, imu_idx array<long>, track array<string>, score array<double>")):
        (tmp_path / name).mkdir()
        out, _ = run(spark, [frame], tmp_path / name, lambda s: matching.realtime_match(s, "2 seconds", threshold=0.2), schema)
        found.append(sorted(map(repr, out.collect())))
    assert len(found[0]) == 3 * (10 + 6) and found[0] == found[1]
