"""The given tables read as frame tables: which table stands for which sensor data.

`events`: a user is a sequence, its events are frames, `value` is a signal and an event type a mask.
`embeddings`: a label's vectors of each thousand are a recording with a frame per vector, so recordings are bounded and
their number grows with the table; a vector's numbers are joints, sensor channels or
the two sides of a matched pair. `lineitem`: an order is a video frame, odd lines are annotated boxes and even lines
are detections. The SQL strings define the same tables for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, frame_idx, ts_s, x, y, kind, ok: a two-dimensional signal per sequence."""
    e = table(spark, sf_dir, "events").withColumnRenamed("user_id", "seq")
    # by the name that later steps group by, so that they find the rows together
    k = F.row_number().over(Window.partitionBy("seq").orderBy("ts", "event_id")) - 1
    return e.withColumn("_k", k).select("seq", F.col("_k").cast("long").alias("frame_idx"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts_s"), F.col("value").alias("x"), (F.col("event_id") * 37 % 101 / 10.0).alias("y"), F.col("event_type").alias("kind"), (F.col("event_type") != "error").alias("ok"))


FRAMES = """f AS (SELECT user_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx, epoch_us(ts) / 1e6 AS ts_s,
  value AS x, (event_id * 37 % 101) / 10.0::DOUBLE AS y, event_type AS kind, event_type <> 'error' AS ok FROM events)"""


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, n_frames, session and split-like subject."""
    return frames(spark, sf_dir).groupBy("seq").agg(F.count(F.lit(1)).alias("n_frames")).withColumn("session", F.concat(F.lit("s"), (F.col("seq") % 7).cast("string"))).withColumn("subject", F.concat(F.lit("p"), (F.col("seq") % 5).cast("string")))


SEQUENCES = f"""{FRAMES}, q AS (SELECT seq, count(*) AS n_frames, 's' || (seq % 7) AS session, 'p' || (seq % 5) AS subject FROM f GROUP BY seq)"""


def pairs(spark: SparkSession, sf_dir: str, size: int = 4) -> DataFrame:
    """Candidate groups of up to `size` vectors in a row: grp, idx, label, imu_emb and video_emb (two halves that mean about the same)."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    other = F.concat(F.slice("e", 2, 63), F.slice("e", 1, 1))
    mixed = F.zip_with("e", other, lambda a, b: a + 0.9 * b)
    return v.select((F.floor(F.col("vec_id") / size)).alias("grp"), (F.col("vec_id") % size).alias("idx"), "label", F.slice("e", 1, 64).alias("imu_emb"), mixed.alias("video_emb"))


def full_groups(pairs: DataFrame, size: int = 4) -> DataFrame:
    """The pairs whose group has all its `size` vectors; the last group of a table may have fewer, and `best_of_four_sql` assigns full ones alone."""
    return pairs.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("grp"))).filter(F.col("_n") == size).drop("_n")


def pairs_sql(size: int = 4) -> str:
    return f"""p AS (SELECT vec_id // {size} AS grp, vec_id % {size} AS idx, label, e AS imu_emb, list_transform(list_zip(e, list_concat(e[2:64], e[1:1])), lambda z: z[1] + 0.9 * z[2]) AS video_emb
  FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)),
s AS (SELECT a.grp, a.idx AS "row", b.idx AS col, a.label AS row_id, b.label AS col_id,
  list_dot_product(a.imu_emb, b.video_emb) / (greatest(sqrt(list_dot_product(a.imu_emb, a.imu_emb)), 1e-12) * greatest(sqrt(list_dot_product(b.video_emb, b.video_emb)), 1e-12)) AS score
  FROM p a JOIN p b ON a.grp = b.grp)"""


def best_of_four_sql() -> str:
    """The assignment of each group of four by trying all permutations."""
    return """perms AS (SELECT a.i AS a, b.i AS b, c.i AS c, d.i AS d FROM range(4) a(i), range(4) b(i), range(4) c(i), range(4) d(i) WHERE a.i NOT IN (b.i, c.i, d.i) AND b.i NOT IN (c.i, d.i) AND c.i <> d.i),
full4 AS (SELECT grp FROM s GROUP BY grp HAVING count(*) = 16),
sums AS (SELECT grp, a, b, c, d, round(sum(CASE WHEN ("row" = 0 AND col = a) OR ("row" = 1 AND col = b) OR ("row" = 2 AND col = c) OR ("row" = 3 AND col = d) THEN score END), 9) AS v FROM s JOIN full4 USING (grp), perms GROUP BY 1, 2, 3, 4, 5),
best AS (SELECT * FROM sums QUALIFY row_number() OVER (PARTITION BY grp ORDER BY v DESC, a, b, c, d) = 1),
m AS (SELECT grp, unnest([0, 1, 2, 3]) AS "row", unnest([a, b, c, d]) AS col FROM best)"""


def boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Annotated boxes (frame, gt_idx, bbox, visible) and detections (frame, track_idx, bbox)."""
    li = table(spark, sf_dir, "lineitem")
    x, y, w = F.col("l_partkey") % 40, F.col("l_suppkey") % 30, 20 + F.col("l_quantity")
    box = F.struct(x.cast("double").alias("x1"), y.cast("double").alias("y1"), (x + w).cast("double").alias("x2"), (y + w).cast("double").alias("y2"))
    row = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice"))
    li = li.withColumn("_k", row).filter("_k = 1").withColumn("bbox", box)
    gt = li.filter("l_linenumber % 2 = 1").select(F.col("l_orderkey").alias("frame"), F.floor(F.col("l_linenumber") / 2).cast("long").alias("gt_idx"), "bbox", (F.col("l_returnflag") != "R").alias("visible"))
    det = li.filter("l_linenumber % 2 = 0").select(F.col("l_orderkey").alias("frame"), (F.floor(F.col("l_linenumber") / 2) - 1).cast("long").alias("track_idx"), "bbox")
    return gt, det


BOXES = """li AS (SELECT l_orderkey AS frame, l_linenumber AS n, l_returnflag, (l_partkey % 40)::DOUBLE AS x1, (l_suppkey % 30)::DOUBLE AS y1, 20 + l_quantity AS w FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) = 1),
gt AS (SELECT frame, n // 2 AS gt_idx, x1, y1, x1 + w AS x2, y1 + w AS y2, l_returnflag <> 'R' AS visible FROM li WHERE n % 2 = 1),
det AS (SELECT frame, n // 2 - 1 AS track_idx, x1, y1, x1 + w AS x2, y1 + w AS y2 FROM li WHERE n % 2 = 0),
o AS (SELECT gt.frame, gt_idx, track_idx, visible, greatest(0, least(gt.x2, det.x2) - greatest(gt.x1, det.x1)) * greatest(0, least(gt.y2, det.y2) - greatest(gt.y1, det.y1)) AS i,
  (gt.x2 - gt.x1) * (gt.y2 - gt.y1) + (det.x2 - det.x1) * (det.y2 - det.y1) AS a FROM gt JOIN det ON gt.frame = det.frame),
ov AS (SELECT frame, gt_idx, track_idx, visible, CASE WHEN a - i > 0 THEN i / (a - i) ELSE 0 END AS iou FROM o)"""


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq (ten for each thousand vectors), frame_idx, ts_s at 30 frames a second, e: 64 numbers."""
    v = table(spark, sf_dir, "embeddings").withColumn("seq", (F.col("label") + 10 * F.floor(F.col("vec_id") / 1000)).cast("long"))
    k = (F.row_number().over(Window.partitionBy("seq").orderBy("vec_id")) - 1).cast("long")
    # widened to doubles behind the window, so that the vectors travel as they are
    return v.select("seq", "vec_id", "embedding").withColumn("frame_idx", k).select("seq", "frame_idx", F.transform("embedding", lambda x: x.cast("double")).alias("e"), (F.col("frame_idx") / 30.0).alias("ts_s"))


RECORDINGS = """r0 AS (SELECT (label + 10 * (vec_id // 1000))::BIGINT AS seq, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
r AS (SELECT seq, row_number() OVER (PARTITION BY seq ORDER BY vec_id) - 1 AS frame_idx, e, (row_number() OVER (PARTITION BY seq ORDER BY vec_id) - 1) / 30.0::DOUBLE AS ts_s FROM r0)"""


def skeletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recordings with joints: 17 structs x, y, z from the first 51 numbers."""
    joint = lambda i: F.struct(F.get("e", 3 * i).alias("x"), F.get("e", 3 * i + 1).alias("y"), F.get("e", 3 * i + 2).alias("z"))
    return recordings(spark, sf_dir).withColumn("joints", F.transform(F.sequence(F.lit(0), F.lit(16)), joint)).drop("e")


def sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recordings with acceleration, rotation rate and quaternion channels from the last numbers."""
    names = [*(f"acc_{a}" for a in "xyz"), *(f"gyro_{a}" for a in "xyz"), *(f"quat_{a}" for a in "wxyz")]
    return recordings(spark, sf_dir).select("seq", "frame_idx", "ts_s", *(F.get("e", F.lit(51 + i)).alias(n) for i, n in enumerate(names)))


SENSORS = f"""{RECORDINGS}, im AS (SELECT seq, frame_idx, ts_s, e[52] AS acc_x, e[53] AS acc_y, e[54] AS acc_z, e[55] AS gyro_x, e[56] AS gyro_y, e[57] AS gyro_z, e[58] AS quat_w, e[59] AS quat_x, e[60] AS quat_y, e[61] AS quat_z FROM r)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, without negative zeros, and counts as longs."""
    out = {c: F.round(c, digits) + F.lit(0.0) for c, t in df.dtypes if t == "double"} | {c: F.col(c).cast("long") for c, t in df.dtypes if t in ("int", "smallint", "tinyint")}
    return df.withColumns(out) if out else df
