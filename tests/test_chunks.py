"""Chunks of long sequences."""

from pyspark.sql import functions as F

from kinelink.operators import accuracy


def test_chunks_beyond_a_thousand_have_ids_of_their_own(spark):
    rows = spark.range(1003).select(F.lit("s").alias("subject"), F.col("id").alias("k"), F.array(F.lit(1.0)).alias("imu_emb"), F.array(F.lit(1.0)).alias("video_emb"))
    units = accuracy.chunk_units(rows, ["subject"], ["k"], windows=1, least=1)
    ids = [r.unit_id for r in units.select("unit_id").collect()]
    assert len(set(ids)) == 1003 and "s_c007" in ids and "s_c1002" in ids
    assert accuracy.group_test(units, [2], 3, 1).count() == 1
