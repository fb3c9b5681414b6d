"""Evidence of segments meets once."""

from pyspark.sql import functions as F

from kinelink.operators import history


def test_one_row_for_each_segment(spark):
    cells = spark.range(400).select((F.col("id") % 4).alias("k"), F.floor(F.col("id") / 4).alias("centre"))
    scores = cells.withColumn("row", F.explode(F.expr("sequence(0L, 1L)"))).withColumn("col", F.explode(F.expr("sequence(0L, 1L)"))).withColumn("score", F.col("centre") * (1 + F.col("row")) * (2 + F.col("col")) % 7 / 7)
    out = history.segment_evidence(scores, ["k"], "centre", 10, 2)
    assert out.count() == 4 * 10 * 4
    want = scores.withColumn("segment", F.floor(F.col("centre") / 10)).groupBy("k", "segment", "row", "col").agg(F.avg("score").alias("m"))
    assert out.join(want, ["k", "segment", "row", "col"]).filter(F.abs(F.col("mean") - F.col("m")) < 1e-12).count() == 160
    assert history._segments(scores, ["k"], "centre", 10, 2, "row", "col", "score")[0].count() == 40
