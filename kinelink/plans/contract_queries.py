"""Layouts, channels, gates, decisions on frames and other contracts on the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelink.functions import channels as C
from kinelink.functions import layouts as L
from kinelink.functions import pose as P
from kinelink.functions import quaternions as Q
from kinelink.operators import features, history, joins, orientation, quality, series, stats, variants, windows
from kinelink.operators.accuracy import session_rollup
from kinelink.plans import standins as S
from kinelink.plans.registry import query


def _points(spark, sf, n: int) -> DataFrame:
    """seq, frame_idx and n points from the vector's numbers, repeated as far as needed."""
    wide = F.concat("e", "e")
    point = lambda i: F.struct(F.get("_w", 3 * i).alias("x"), F.get("_w", 3 * i + 1).alias("y"), F.get("_w", 3 * i + 2).alias("z"))
    made = S.recordings(spark, sf).withColumn("_w", wide).withColumn("joints", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), point))
    return made.select("seq", "frame_idx", "joints")


_NAMES21 = ["x0", *reversed(L.CAPTURE21), "x1", "x2", "x3"]
_AT21 = [_NAMES21.index(n) for n in L.CAPTURE21]


@query(f"WITH {S.RECORDINGS}, w AS (SELECT seq, frame_idx, list_concat(e, e) AS w FROM r) SELECT seq, frame_idx, j AS joint, round(w[3 * ({_AT21})[j + 1] + 1], 6) + 0.0 AS x, round(w[3 * ({_AT21})[j + 1] + 3], 6) + 0.0 AS z FROM w, range(17) t(j)")
def capture21_to_h36m17(spark, sf):
    p = _points(spark, sf, 21).withColumn("h", P.capture21_to_h36m17("joints", _NAMES21))
    return S.rounded(p.select("seq", "frame_idx", F.posexplode("h").alias("joint", "q")).select("seq", "frame_idx", "joint", "q.x", "q.z"))


_SM = lambda i, a: f"w[{3 * i + 1 + a}]"


@query(f"""WITH {S.RECORDINGS}, w AS (SELECT seq, frame_idx, list_concat(e, e) AS w FROM r) SELECT seq, frame_idx, round(({_SM(8, 0)} + {_SM(9, 0)}) / 2, 6) + 0.0 AS thorax_x, round(({_SM(0, 1)} + ({_SM(8, 1)} + {_SM(9, 1)}) / 2) / 2, 6) + 0.0 AS spine_y,
round({_SM(24, 2)}, 6) + 0.0 AS neck_z, round({_SM(24, 0)} + 0.5 * ({_SM(24, 0)} - {_SM(7, 0)}), 6) + 0.0 AS head_x, round({_SM(13, 1)}, 6) + 0.0 AS wrist_y FROM w""")
def smplx25_to_h36m17(spark, sf):
    p = _points(spark, sf, 25).withColumn("h", P.smplx25_to_h36m17("joints"))
    at = lambda n: P.joint("h", L.H36M17.index(n))
    return S.rounded(p.select("seq", "frame_idx", at("thorax")["x"].alias("thorax_x"), at("spine")["y"].alias("spine_y"), at("neck")["z"].alias("neck_z"), at("head")["x"].alias("head_x"), at("right_wrist")["y"].alias("wrist_y")))


@query(f"""WITH {S.RECORDINGS}, n AS (SELECT *, sqrt(({_SM(8, 0).replace("w", "e")} - e[1]) ** 2 + ({_SM(8, 1).replace("w", "e")} - e[2]) ** 2 + ({_SM(8, 2).replace("w", "e")} - e[3]) ** 2) AS s FROM r)
SELECT seq, frame_idx, s > 0.3 AS valid, round((e[40] - e[1]) / CASE WHEN s > 0.3 THEN s ELSE 1 END, 6) + 0.0 AS wrist_x FROM n""")
def torso_audit(spark, sf):
    p = S.skeletons(spark, sf).withColumn("t", P.torso_audit("joints", floor=0.3))
    return S.rounded(p.select("seq", "frame_idx", "t.valid", P.joint("t.joints", 13)["x"].alias("wrist_x")))


@query(f"""WITH {S.SENSORS}, n AS (SELECT *, sqrt(quat_w ** 2 + quat_x ** 2 + quat_y ** 2 + quat_z ** 2) AS s FROM im)
SELECT seq, frame_idx, 48 AS width, 7 AS seven, round(acc_y, 6) + 0.0 AS acc_y, round(abs(quat_w / s), 5) AS w, round(quat_z / s * sign(quat_w), 5) + 0.0 AS z FROM n""")
def pack_48d(spark, sf):
    """Seven channels into 48 numbers and one sensor out of them again; the quaternion's sign is made positive."""
    s = S.sensors(spark, sf).withColumn("seven", C.pack_7d(F.array(*L.ACC), Q.normalize(F.array(*L.QUAT)))).withColumn("wide", C.repeat_sensor_48d("seven"))
    back = s.withColumn("b", C.unpack_48d("wide", "R_LowLeg"))
    sign = F.when(F.get("b", F.lit(3)) < 0, -1.0).otherwise(1.0)
    out = back.select("seq", "frame_idx", F.size("wide").alias("width"), F.size("b").alias("seven"), F.get("b", F.lit(1)).alias("acc_y"), F.round(F.get("b", F.lit(3)) * sign, 5).alias("w"), F.round(F.get("b", F.lit(6)) * sign, 5).alias("z"))
    return S.rounded(out)


_CHANNELS = (*L.GYRO, *L.QUAT, *L.ACC)
_VIEWS = ["acc", "gyro", "acc_quat", "acc_gyro", "gyro_quat", "acc_gyro_quat", "auto"]


@query("SELECT seq, frame_idx, v AS view, n AS width, round(first, 6) + 0.0 AS first, round(last, 6) + 0.0 AS last FROM (" + f"WITH {S.SENSORS} SELECT seq, frame_idx, " + f"unnest({_VIEWS}) AS v, unnest([3, 3, 7, 6, 7, 10, 7]) AS n, unnest([acc_x, gyro_x, acc_x, acc_x, gyro_x, acc_x, acc_x]) AS first, unnest([acc_z, gyro_z, quat_z, gyro_z, quat_z, quat_z, quat_z]) AS last FROM im)")
def select_imu_view(spark, sf):
    s = S.sensors(spark, sf).withColumn("values", F.array(*_CHANNELS))
    made = F.array(*(F.struct(F.lit(v).alias("view"), C.select_view("values", _CHANNELS, v).alias("a")) for v in _VIEWS))
    each = s.select("seq", "frame_idx", F.explode(made).alias("_v")).select("seq", "frame_idx", "_v.view", "_v.a")
    return S.rounded(each.select("seq", "frame_idx", "view", F.size("a").alias("width"), F.get("a", F.lit(0)).alias("first"), F.element_at("a", -1).alias("last")))


@query("""SELECT DISTINCT CASE o_orderkey % 4 WHEN 0 THEN 'acc_x' WHEN 1 THEN 'gyro_y' WHEN 2 THEN 'quat_w' ELSE lower(o_orderpriority) END AS name, CASE o_orderkey % 4 WHEN 0 THEN 'm/s^2' WHEN 1 THEN 'rad/s' WHEN 2 THEN '1' ELSE 'unknown' END AS unit,
CASE o_orderkey % 4 WHEN 0 THEN 'acceleration' WHEN 1 THEN 'angular_velocity' WHEN 2 THEN 'orientation' ELSE 'unknown' END AS kind FROM orders""")
def infer_channel_metadata(spark, sf):
    k = F.col("o_orderkey") % 4
    name = F.when(k == 0, "acc_x").when(k == 1, "gyro_y").when(k == 2, "quat_w").otherwise(F.lower("o_orderpriority"))
    return S.table(spark, sf, "orders").select(name.alias("name")).distinct().withColumn("_m", C.infer_metadata("name")).select("name", "_m.unit", "_m.kind")


_BB = f"""{S.RECORDINGS}, jt AS (SELECT seq, frame_idx, j, CASE WHEN (frame_idx + j) % 4 = 0 THEN 0 ELSE e[3 * j + 1] END AS x, CASE WHEN (frame_idx + j) % 4 = 0 THEN 0 ELSE e[3 * j + 2] END AS y FROM r, range(17) t(j)), bb AS (SELECT seq, frame_idx, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2 FROM jt WHERE NOT (x = 0 AND y = 0) GROUP BY 1, 2)"""


def _boxed(spark, sf) -> DataFrame:
    """Joints of which every fourth stands at 0, 0, and their box."""
    j = S.skeletons(spark, sf).withColumn("joints", F.transform("joints", lambda p, i: F.when((F.col("frame_idx") + i) % 4 == 0, P.xyz(0.0, 0.0, 0.0)).otherwise(p)))
    return j.withColumn("bbox", P.pose_bbox("joints"))


@query(f"WITH {_BB} SELECT seq, frame_idx, round(x1, 6) + 0.0 AS x1, round(y2, 6) + 0.0 AS y2 FROM bb")
def pose_bbox(spark, sf):
    return S.rounded(_boxed(spark, sf).select("seq", "frame_idx", F.col("bbox.x1").alias("x1"), F.col("bbox.y2").alias("y2")))


@query(f"""WITH {_BB}, c AS (SELECT bb.seq, bb.frame_idx, CASE WHEN bb.frame_idx % 4 = 0 THEN 0 ELSE e[1] END AS root_x, (x1 + x2) / 2 AS cx, x2 - x1 AS w FROM bb JOIN r ON r.seq = bb.seq AND r.frame_idx = bb.frame_idx)
SELECT seq, frame_idx, round(root_x, 6) + 0.0 AS root_x, round(cx, 6) + 0.0 AS center_x, round(w, 6) + 0.0 AS full_width, round(root_x, 6) + 0.0 AS auto_x, round(coalesce(cx - lag(cx) OVER (PARTITION BY seq ORDER BY frame_idx), 0), 6) + 0.0 AS velocity_x FROM c""")
def root_trajectory(spark, sf):
    b, j, box = _boxed(spark, sf), F.col("joints"), F.col("bbox")
    t = b.select("seq", "frame_idx", P.root_trajectory("root3d", j, box)["x"].alias("root_x"), P.root_trajectory("center", j, box)["x"].alias("center_x"), P.root_trajectory("full", j, box)["width"].alias("full_width"), P.root_trajectory("auto", j, box)["x"].alias("auto_x"))
    return S.rounded(series.diff_zero(t, ["seq"], ["frame_idx"], "center_x", name="velocity_x"))


@query(f"""WITH {S.RECORDINGS}, jt AS (SELECT seq, frame_idx, j, e[3 * j + 3] AS c, (frame_idx + j) % 9 = 2 AS bad FROM r, range(17) t(j))
SELECT seq, frame_idx, count(*) FILTER (NOT bad) AS finite, count(*) FILTER (NOT bad AND c > 0) AS valid FROM jt GROUP BY 1, 2""")
def valid_joints(spark, sf):
    nan = F.lit(float("nan"))
    j = S.skeletons(spark, sf).withColumn("c", F.transform("joints", lambda p: p["z"])).withColumn("joints", F.transform("joints", lambda p, i: F.when((F.col("frame_idx") + i) % 9 == 2, P.xyz(nan, nan, nan)).otherwise(p)))
    count = lambda v: F.size(F.filter(v, lambda x: x)).cast("long")
    return j.select("seq", "frame_idx", count(P.valid_joints("joints")).alias("finite"), count(P.valid_joints("joints", F.col("c"))).alias("valid"))


@query(f"WITH {S.RECORDINGS} SELECT seq % 3 AS source, count(*) AS entries, count(*) FILTER (frame_idx % 5 <> 1 AND frame_idx % 7 <> 3) AS usable FROM r GROUP BY 1")
def pose_artifact_quality(spark, sf):
    """Every fifth entry lacks numbers, every seventh has one that is none."""
    k = F.col("frame_idx")
    points = F.transform(F.slice("e", 1, 51), lambda v, i: F.when((k % 7 == 3) & (i == 4), F.lit(float("nan"))).otherwise(v))
    d = S.recordings(spark, sf).select((F.col("seq") % 3).alias("source"), F.when(k % 5 == 1, F.slice(points, 1, 50)).otherwise(points).alias("keypoints"))
    return quality.pose_artifact_quality(d, "source", "keypoints")


@query(f"WITH {S.RECORDINGS}, b AS (SELECT seq, unnest(['x', 'y']) AS c, unnest([frame_idx % 50 = 3, frame_idx % 60 = 4]) AS bad FROM r) SELECT 'not_finite' AS rule, seq::VARCHAR AS key, c AS detail, count(*) AS n FROM b WHERE bad GROUP BY 1, 2, 3")
def check_finite(spark, sf):
    k = F.col("frame_idx")
    d = S.recordings(spark, sf).select("seq", F.when(k % 50 == 3, F.lit(float("inf"))).otherwise(F.lit(1.0)).alias("x"), F.when(k % 60 == 4, F.lit(None).cast("double")).otherwise(F.lit(1.0)).alias("y"))
    return quality.check_finite(d, "seq", ["x", "y"]).groupBy("rule", "key", "detail").agg(F.count(F.lit(1)).alias("n"))


_W = f"{S.SEQUENCES}, w AS (SELECT seq, session, subject, unnest(range(0, n_frames - 23, 16)) AS s FROM q WHERE n_frames >= 24)"


def _windows(spark, sf) -> DataFrame:
    return windows.fixed_windows(S.sequences(spark, sf), 24, 16)


@query(f"WITH {_W}, m AS (SELECT seq, s AS window_start, CASE WHEN seq % 2 = 0 THEN 'test' ELSE 'train' END AS split, CASE WHEN seq % 3 = 0 THEN ' ' WHEN seq % 3 = 1 THEN 'g' END AS g FROM w) SELECT seq, window_start, split FROM m WHERE split <> 'test' OR trim(g) <> ''")
def multi_candidate_only(spark, sf):
    w = _windows(spark, sf).select("seq", "window_start", F.when(F.col("seq") % 2 == 0, "test").otherwise("train").alias("split"), F.when(F.col("seq") % 3 == 0, " ").when(F.col("seq") % 3 == 1, "g").alias("candidate_group_id"))
    return windows.multi_candidate_only(w).select("seq", "window_start", "split")


@query(f"WITH {S.FRAMES} SELECT seq, frame_idx FROM f WHERE frame_idx % 3 = 0")
def every_nth_frame(spark, sf):
    return windows.every_nth_frame(S.frames(spark, sf), 3).select("seq", "frame_idx")


@query(f"WITH {_W}, d AS (SELECT seq, s AS window_start, CASE WHEN seq % 3 = 0 THEN 30.0 ELSE 10.0 END AS fps FROM w) SELECT seq, window_start, abs(24 / fps - 0.8) <= 1 / fps + 1e-6 AS lasts FROM d")
def window_duration(spark, sf):
    fps = F.when(F.col("seq") % 3 == 0, 30.0).otherwise(10.0)
    return _windows(spark, sf).select("seq", "window_start", windows.duration_ok(F.col("window_start") / fps, F.col("window_end") / fps, 0.8, fps).alias("lasts"))


@query(f"""WITH {S.SENSORS}, g AS (SELECT seq, frame_idx, 'imu' AS source, CASE WHEN seq % 10 = 1 THEN 0 ELSE acc_x END AS v, CASE WHEN seq % 10 = 2 AND frame_idx = 5 THEN 4 ELSE frame_idx END AS frame_id FROM im),
n AS (SELECT seq, count(DISTINCT frame_id) AS n, count(*) AS m FROM g GROUP BY seq)
SELECT 'zero_imu' AS rule, seq::VARCHAR AS key, '' AS detail FROM n WHERE seq % 10 = 1 UNION ALL SELECT 'zero_skeleton', seq::VARCHAR, '' FROM n WHERE seq % 10 = 7
UNION ALL SELECT 'frame_order', seq::VARCHAR, 'imu' FROM n WHERE seq % 10 = 2 UNION ALL SELECT 'length', seq::VARCHAR, 'imu' FROM n WHERE n <> m
UNION ALL SELECT 'not_finite', seq::VARCHAR, 'imu' FROM n WHERE seq % 10 = 3 UNION ALL SELECT 'channel_names', seq::VARCHAR, '' FROM n WHERE seq % 10 = 4
UNION ALL SELECT 'channel_count', seq::VARCHAR, '' FROM n WHERE seq % 10 = 5 UNION ALL SELECT 'dataset', seq::VARCHAR, 'other' FROM n WHERE seq % 10 = 6 UNION ALL SELECT 'no_frames', 'q' || o_custkey, '' FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey % 50 = 0)""")
def validate_sequences(spark, sf):
    """A flaw for each last digit of the recording's number; a sequence of each fiftieth customer has no frames."""
    s, d = S.sensors(spark, sf), F.col("seq") % 10
    first = F.when(d == 1, 0.0).when((d == 3) & (F.col("frame_idx") == 2), float("nan")).otherwise(F.col("acc_x"))
    other = F.when(d == 1, 0.0).otherwise(F.col("acc_y"))
    imu = s.select(F.col("seq").cast("string").alias("sequence_id"), F.lit("imu").alias("source"), F.when((d == 2) & (F.col("frame_idx") == 5), 4).otherwise(F.col("frame_idx")).alias("frame_id"), F.array(first, other).alias("values"))
    gt = s.select(F.col("seq").cast("string").alias("sequence_id"), F.lit("gt").alias("source"), F.col("frame_idx").alias("frame_id"), F.array(F.when(d == 7, 0.0).otherwise(1.0)).alias("values"))
    names = F.when(d == 4, F.array(F.lit("a"), F.lit("a"))).when(d == 5, F.array(F.lit("a"), F.lit("b"), F.lit("c"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    seqs = s.groupBy("seq").agg(F.count(F.lit(1)).alias("n_frames")).select(F.col("seq").cast("string").alias("sequence_id"), F.when(d == 6, "other").otherwise("known").alias("dataset"), "n_frames", names.alias("imu_channels"))
    bare = S.table(spark, sf, "orders").filter("o_custkey % 50 = 0").select(F.concat(F.lit("q"), F.col("o_custkey").cast("string")).alias("sequence_id")).distinct().select("sequence_id", F.lit("known").alias("dataset"), F.lit(1).cast("long").alias("n_frames"), F.array(F.lit("a"), F.lit("b")).alias("imu_channels"))
    return quality.validate_sequences(seqs.unionByName(bare), imu.unionByName(gt), ["known"])


@query("""WITH p AS (SELECT c_custkey AS k FROM customer) SELECT 'j' || k AS key, r AS rule FROM (
SELECT k, unnest([CASE WHEN k % 11 = 1 THEN 'missing' END, CASE WHEN k % 11 = 2 THEN 'extra' END, CASE WHEN k % 11 = 3 THEN 'not_completed' END, CASE WHEN k % 11 = 4 THEN 'seed_mismatch' END, CASE WHEN k % 11 = 5 THEN 'counts' END, CASE WHEN k % 11 = 6 THEN 'value' END, CASE WHEN k % 11 = 7 THEN 'dirty' END, CASE WHEN k % 11 = 8 THEN 'duplicate' END, CASE WHEN k % 11 = 9 THEN 'bad_checkpoint_sha256' END, CASE WHEN k % 11 = 10 THEN 'config_hash_mismatch' END]) AS r FROM p) WHERE r IS NOT NULL""")
def validate_run_records(spark, sf):
    """A run for each customer, with a flaw for each remainder of its number by eleven."""
    k, m = F.col("c_custkey"), F.col("c_custkey") % 11
    base = S.table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("j"), k.cast("string")).alias("job_id"), F.lit("zero_shot").alias("condition"), F.lit("d").alias("dataset"), F.lit("s").alias("source"), (k % 3).cast("int").alias("seed"), F.lit("t").alias("test_session"), F.lit("p").alias("train_job_id"))
    expected = base.filter(m != 2).drop("c_custkey")
    digest = F.sha2(F.col("job_id").cast("binary"), 256)
    r = base.filter(m != 1).withColumns({
        "status": F.when(m == 3, "failed").otherwise("completed"), "seed": F.when(m == 4, 9).otherwise(F.col("seed")), "protocol_hash": F.lit("h"), "config_hash": F.sha2(F.when(m == 10, "other").otherwise("{}").cast("binary"), 256), "resolved_config": F.lit("{}"),
        "data_manifest_hash": F.lit("m"), "checkpoint": F.lit("c"), "checkpoint_sha256": F.when(m == 9, "short").otherwise(digest), "raw_results": F.lit("r"), "raw_results_sha256": digest, "git_commit": F.lit("g"), "git_dirty": m == 7,
        "frame_acc": F.struct(F.when(m == 5, 9).otherwise(1).alias("correct"), F.lit(4).alias("total"), F.when(m == 6, 0.5).otherwise(0.25).alias("value")), "candidate_groups": F.struct(F.lit(0.0).alias("singleton_rate"), F.lit(2).alias("candidate_group_size_min")),
    })
    r = r.unionByName(r.filter(m == 8)).drop("c_custkey")
    return quality.validate_run_records(r, expected).select("rule", "key").distinct()


@query("""WITH q AS (SELECT o_custkey AS k, count(*) AS rows, count(*) FILTER (o_orderkey % 7 = 0) AS blank, count(*) FILTER (o_orderkey % 7 <> 0 AND o_orderkey % 5 = 0) AS mismatched, count(*) FILTER (o_orderkey % 11 = 0) AS missing_refs FROM orders GROUP BY 1)
SELECT c_custkey::VARCHAR AS sequence_id, c_custkey % 4 <> 0 AS same_ids, coalesce(rows, 0) AS rows, coalesce(blank, 0) AS blank, coalesce(mismatched, 0) AS mismatched, coalesce(missing_refs, 0) AS missing_refs FROM customer LEFT JOIN q ON q.k = c_custkey""")
def audit_person_imu_mapping(spark, sf):
    o, c = S.table(spark, sf, "orders"), S.table(spark, sf, "customer")
    k = F.col("o_orderkey")
    rows = o.select(F.col("o_custkey").cast("string").alias("sequence_id"), F.concat(F.lit("f"), k.cast("string")).alias("npz_path"), F.when(k % 7 != 0, 1).alias("person_idx"), F.when(k % 5 == 0, 2).otherwise(1).alias("imu_idx"))
    files = o.filter(k % 11 != 0).select(F.concat(F.lit("f"), k.cast("string")).alias("npz_path"))
    sequences = c.select(F.col("c_custkey").cast("string").alias("sequence_id"), F.array(F.lit(2), F.lit(1)).alias("imu_ids"), F.when(F.col("c_custkey") % 4 == 0, F.array(F.lit(1), F.lit(3))).otherwise(F.array(F.lit(1), F.lit(2), F.lit(2))).alias("person_ids"))
    return quality.audit_person_imu_mapping(rows, sequences, files)


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'included' ELSE 'conditional' END ELSE 'pending' END AS status FROM customer")
def gate_sources(spark, sf):
    k = F.col("c_custkey")
    return quality.gate_sources(S.table(spark, sf, "customer").select("c_custkey", (k % 3 != 0).alias("present"), F.when(k % 5 == 0, 0.9).otherwise(1.0).alias("finite_share"), (k % 2 == 0).alias("mapped"))).select("c_custkey", "status")


@query(f"""WITH {S.FRAMES}, g AS (SELECT seq, frame_idx, p AS person_idx FROM f, range(2) t(p)) SELECT seq, frame_idx, person_idx, (frame_idx + person_idx) % 3 <> 0 AND seq % 4 <> 0 AS tracked, CASE WHEN (frame_idx + person_idx) % 3 <> 0 AND seq % 4 <> 0 THEN ((frame_idx + person_idx) % 3)::DOUBLE ELSE 0 END AS x, 17 AS joints FROM g""")
def mapped_skeleton(spark, sf):
    """Persons mapped to one of two tracks or none; recordings in four have no tracks."""
    f = S.frames(spark, sf)
    people = f.select("seq", "frame_idx", F.explode(F.expr("sequence(0, 1)")).alias("person_idx"))
    place = (F.col("frame_idx") + F.col("person_idx")) % 3
    gt_map = people.filter(place != 0).withColumn("track_idx", place)
    tracks = f.filter("seq % 4 <> 0").select("seq", "frame_idx", F.explode(F.expr("sequence(1, 2)")).alias("track_idx")).withColumn("joints", F.array_repeat(P.xyz(F.col("track_idx").cast("double"), 0.0, 0.0), 17))
    out = joins.mapped_skeleton(people, gt_map, tracks, ["seq"])
    return S.rounded(out.select("seq", "frame_idx", "person_idx", "tracked", P.joint("joints", 3)["x"].alias("x"), F.size("joints").alias("joints")))


@query("SELECT c_nationkey AS session, c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN max(k) OVER (PARTITION BY c_nationkey) - k ELSE k END AS person_idx FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS k FROM customer)")
def swap_order(spark, sf):
    c = S.table(spark, sf, "customer").select(F.col("c_nationkey").alias("session"), "c_custkey").withColumn("person_idx", F.row_number().over(Window.partitionBy("session").orderBy("c_custkey")) - 1)
    swapped = S.table(spark, sf, "nation").filter("n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("session"))
    return S.rounded(joins.swap_order(c, swapped))


@query(f"WITH {S.FRAMES} SELECT seq, bool_and(frame_idx % 3 <> 0 OR ok) AS equal, round(avg((frame_idx % 3 = 0 AND NOT ok)::INT), 6) AS delta FROM f WHERE frame_idx % 5 <> 0 GROUP BY seq")
def visibility_delta(spark, sf):
    """Every third frame is shown in one of the two; every fifth is in one only and not compared."""
    f = S.frames(spark, sf)
    return S.rounded(stats.visibility_delta(f.withColumn("ok", (F.col("frame_idx") % 3 == 0) | F.col("ok")), f.filter("frame_idx % 5 <> 0"), ["seq", "frame_idx"], ["seq"], "ok"))


@query(f"WITH {S.SENSORS} SELECT seq::VARCHAR AS sequence_id, frame_idx, round(acc_x, 6) + 0.0 AS acc_x, round(quat_w, 6) + 0.0 AS quat_w FROM im")
def variant_identity(spark, sf):
    s = S.sensors(spark, sf).select(F.col("seq").cast("string").alias("sequence_id"), F.lit(0).alias("person_idx"), "frame_idx", *L.ACC, *L.QUAT)
    imu, _ = variants.apply_variant(s, s, ["Identity"])
    return S.rounded(imu.select("sequence_id", "frame_idx", "acc_x", "quat_w"))


@query(f"WITH {S.SENSORS} SELECT DISTINCT seq, frame_idx // 24 AS w, true AS channels_whole, true AS joints_whole, true AS noisy FROM im")
def augment_window(spark, sf):
    """What no draw changes: a dropped channel or joint is 0 over its whole window, what stays is moved in every frame."""
    s = S.sensors(spark, sf).select("seq", F.floor(F.col("frame_idx") / 24).alias("w"), "frame_idx", F.array(*L.ACC).alias("imu"))
    both = s.join(S.skeletons(spark, sf).select("seq", "frame_idx", "joints"), ["seq", "frame_idx"]).withColumn("before", F.col("imu"))
    out = features.augment_window(both, ["seq", "w"], "frame_idx", "imu", "joints", 7, imu_noise=0.1, channel_dropout=0.3, joint_noise=0.1, joint_dropout=0.3)
    whole = lambda c, n: F.forall(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.size(F.array_distinct(F.transform(c, lambda x: F.get(x, i)))) == 1)
    zero = out.select("seq", "w", F.transform("imu", lambda v: v == 0).alias("z"), F.transform("joints", lambda p: (p["x"] == 0) & (p["y"] == 0)).alias("j"), F.exists(F.zip_with("imu", "before", lambda a, b: (a != 0) & (a == b)), lambda x: x).alias("same"))
    each = zero.groupBy("seq", "w").agg(F.collect_list("z").alias("z"), F.collect_list("j").alias("j"), F.bool_or("same").alias("same"))
    return each.select("seq", "w", whole("z", 3).alias("channels_whole"), whole("j", 17).alias("joints_whole"), (~F.col("same")).alias("noisy"))


@query("SELECT unnest(['l_quantity', 'l_discount', 'flat']) AS feature, round(unnest([avg(l_quantity), avg(l_discount), 2.0]), 6) AS mean, round(unnest([stddev_samp(l_quantity), stddev_samp(l_discount), 1e-6]), 6) AS std FROM lineitem")
def feature_stats(spark, sf):
    return S.rounded(stats.feature_stats(S.table(spark, sf, "lineitem").withColumn("flat", F.lit(2.0)), ["l_quantity", "l_discount", "flat"]))


@query("""WITH g AS (SELECT avg(l_quantity) AS m, stddev_samp(l_quantity) AS s FROM lineitem), h AS (SELECT l_suppkey, avg(l_quantity) AS m, stddev_samp(l_quantity) AS s FROM lineitem WHERE l_suppkey % 2 = 0 GROUP BY 1)
SELECT l_suppkey, count(*) AS n, round(avg((l_quantity - coalesce(h.m, g.m)) / greatest(coalesce(h.s, g.s), 1e-6)), 5) + 0.0 AS mean, round(max((l_quantity - coalesce(h.m, g.m)) / greatest(coalesce(h.s, g.s), 1e-6)), 5) AS most FROM lineitem LEFT JOIN h USING (l_suppkey), g GROUP BY 1""")
def standardize(spark, sf):
    """Even suppliers have statistics of their own."""
    li = S.table(spark, sf, "lineitem").select("l_suppkey", F.col("l_quantity").cast("double").alias("q"))
    both = [F.avg("q").alias("q_mean"), F.stddev_samp("q").alias("q_std")]
    out = stats.standardize(li, ["q"], li.filter("l_suppkey % 2 = 0").groupBy("l_suppkey").agg(*both), li.agg(*both), "l_suppkey")
    return S.rounded(out.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("q"), 5).alias("mean"), F.round(F.max("q"), 5).alias("most")))


@query("""WITH p AS (SELECT o_orderstatus AS source, CASE WHEN o_orderkey % 3 = 0 THEN '<none>' WHEN o_orderkey % 3 = 1 THEN '.npz' ELSE '.csv' END AS suffix, o_custkey AS n FROM orders) SELECT source, suffix, count(*) AS files, sum(n)::BIGINT AS bytes FROM p GROUP BY 1, 2""")
def source_inventory(spark, sf):
    k = F.col("o_orderkey")
    suffix = F.when(k % 3 == 0, "").when(k % 3 == 1, ".npz").otherwise(".csv")
    return stats.source_inventory(S.table(spark, sf, "orders").select(F.col("o_orderstatus").alias("source"), F.concat(F.lit("/d.x/f"), k.cast("string"), suffix).alias("path"), F.col("o_custkey").cast("long").alias("length")))


@query("""WITH s AS (SELECT DISTINCT c_mktsegment AS source FROM customer), n AS (SELECT DISTINCT r_name AS fold FROM region), k AS (SELECT unnest([1, 2, 3]) AS seed)
SELECT 'train' AS phase, 'source' AS condition, count(*) AS n FROM s, k UNION ALL SELECT 'evaluate', 'source', count(*) FROM s, k UNION ALL SELECT unnest(['train', 'evaluate', 'evaluate']), unnest(['finetune', 'finetune', 'zero_shot']), (SELECT count(*) FROM s, k, n) UNION ALL SELECT unnest(['train', 'evaluate']), 'direct', (SELECT count(*) FROM k, n)""")
def expected_cells(spark, sf):
    """The study over the market segments as sources and the regions as folds: both are dimensions of few rows."""
    sources = [r[0] for r in S.table(spark, sf, "customer").select("c_mktsegment").distinct().collect()]
    folds = {r[0]: f"s_{r[0]}" for r in S.table(spark, sf, "region").select("r_name").distinct().collect()}
    cells = stats.expected_cells(spark, sources, [1, 2, 3], folds)
    return cells.groupBy("phase", "condition").agg(F.count_distinct("job_id").alias("n"))


@query(f"""WITH {S.SENSORS}, n AS (SELECT *, sqrt(quat_w ** 2 + quat_x ** 2 + quat_y ** 2 + quat_z ** 2) AS s, sqrt(acc_x ** 2 + acc_y ** 2 + acc_z ** 2) AS m FROM im), u AS (SELECT *, quat_w / s AS w, quat_x / s AS x, quat_y / s AS y, quat_z / s AS z FROM n),
l AS (SELECT *, lag(acc_y) OVER k AS py, lag(w) OVER k AS pw, lag(x) OVER k AS px, lag(y) OVER k AS pyq, lag(z) OVER k AS pz, ts_s - lag(ts_s) OVER k AS dt, avg(m) OVER (PARTITION BY seq) AS mm FROM u WINDOW k AS (PARTITION BY seq ORDER BY ts_s))
SELECT seq, frame_idx, round(m, 6) AS acc_magnitude, round(m - mm, 6) + 0.0 AS acc_magnitude_centered, round(coalesce((acc_y - py) / dt, 0), 6) + 0.0 AS acc_dy, round(gyro_z, 6) + 0.0 AS gyro_z, true AS gyro_valid, round(y, 6) + 0.0 AS quat_y, true AS quat_valid,
round(coalesce(2 * acos(least(abs(w * pw + x * px + y * pyq + z * pz), 1)) / dt, 0), 4) AS angular_speed FROM l""")
def imu_views_all(spark, sf):
    """All sensor views at once."""
    v = series.imu_views(S.sensors(spark, sf), ["seq"], "ts_s").withColumn("angular_speed", F.round("angular_speed", 4))
    return S.rounded(v.select("seq", "frame_idx", "acc_magnitude", "acc_magnitude_centered", "acc_dy", "gyro_z", "gyro_valid", "quat_y", "quat_valid", "angular_speed"))


@query(f"""WITH {S.RECORDINGS}, s AS (SELECT seq, frame_idx, j, abs(e[3 * j + 1]) AS v FROM r, range(17) t(j)), q AS (SELECT seq, quantile_cont(v, 0.75) AS q, avg(v) AS motion_energy, max(v) AS max_speed FROM s GROUP BY seq),
p AS (SELECT s.seq, frame_idx, avg((v > q)::INT) AS share FROM s JOIN q USING (seq) GROUP BY 1, 2) SELECT seq, round(any_value(motion_energy), 6) AS motion_energy, round(any_value(max_speed), 6) AS max_speed, round(avg(share), 6) AS active_ratio, round(avg((share >= 0.5)::INT), 6) AS simultaneous_ratio FROM p JOIN q USING (seq) GROUP BY seq""")
def activity_ratios(spark, sf):
    s = S.skeletons(spark, sf).select("seq", "frame_idx", F.explode("joints").alias("p")).select("seq", "frame_idx", F.abs("p.x").alias("speed"))
    return S.rounded(series.activity_ratios(s, ["seq"], "frame_idx", "speed"))


_AS = f"""{S.SENSORS}, pr AS (SELECT a.seq, k AS kind, a.frame_idx, a.quat_x AS rate, a.frame_idx % 6 <> 1 AS ok, b.gyro_x, b.gyro_y, b.gyro_z FROM im a, (VALUES ('matched', 0), ('shuffled', 1)) t(k, d) JOIN im b ON b.seq // 10 = a.seq // 10 AND b.seq % 10 = (a.seq + d) % 10 AND b.frame_idx = a.frame_idx),
ax AS (SELECT seq, kind, frame_idx, rate, ok, unnest([0, 1, 2]) AS axis, unnest([gyro_x, gyro_y, gyro_z]) AS g FROM pr),
rw AS (SELECT seq, kind, axis, corr(rate, g) FILTER (ok) AS c FROM ax GROUP BY 1, 2, 3), rb AS (SELECT seq, kind, arg_max(c, round(abs(c), 9) + axis * 1e-12) AS raw_r, arg_max(axis, round(abs(c), 9) + axis * 1e-12) AS raw_axis FROM rw GROUP BY 1, 2),
sm AS (SELECT seq, kind, axis, frame_idx, CASE WHEN count(*) FILTER (ok) OVER k >= 3 THEN avg(rate) FILTER (ok) OVER k END AS x, CASE WHEN count(*) FILTER (ok) OVER k >= 3 THEN avg(g) FILTER (ok) OVER k END AS y FROM ax WINDOW k AS (PARTITION BY seq, kind, axis ORDER BY frame_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
lg AS (SELECT a.seq, a.kind, a.axis, l AS lag, count(*) AS n, corr(b.x, a.y) AS c FROM sm a, range(-4, 5) t(l) JOIN sm b ON b.seq = a.seq AND b.kind = a.kind AND b.axis = a.axis AND b.frame_idx = a.frame_idx + l WHERE b.x IS NOT NULL AND a.y IS NOT NULL GROUP BY 1, 2, 3, 4 HAVING count(*) >= 5),
sb AS (SELECT seq, kind, arg_max(c, round(abs(c), 9) + axis * 1e-12) AS smooth_r FROM lg WHERE lag = 0 GROUP BY 1, 2), lb AS (SELECT seq, kind, arg_max(c, round(abs(c), 9) + lag * 1e-11 + axis * 1e-12) AS lag_r, arg_max(lag, round(abs(c), 9) + lag * 1e-11 + axis * 1e-12) AS lag_frames FROM lg GROUP BY 1, 2),
asn AS (SELECT * FROM rb JOIN sb USING (seq, kind) JOIN lb USING (seq, kind))"""


def _rate_and_gyro(spark, sf) -> DataFrame:
    """A recording's rotation rate beside its own gyro and beside that of the next of ten."""
    s = S.sensors(spark, sf).withColumn("team", F.floor(F.col("seq") / 10)).withColumn("person", F.col("seq") % 10).withColumn("people", F.lit(10))
    return joins.orientation_gyro_join(s.select("team", "person", "people", "frame_idx", F.col("quat_x").alias("rate"), (F.col("frame_idx") % 6 != 1).alias("ok")), s.select("team", "person", "frame_idx", *L.GYRO), ["team"], "person", "people")


_SERIES = ["team", "person", "kind"]


def _seq() -> Column:
    return (F.col("team") * 10 + F.col("person")).alias("seq")


def _associations(spark, sf) -> DataFrame:
    return orientation.gyro_association(_rate_and_gyro(spark, sf), _SERIES, "frame_idx", "rate", list(L.GYRO), F.col("ok"), 5, 4).withColumn("seq", _seq())


_TURN = f"{_AS}, z AS (SELECT seq, kind, row_number() OVER (PARTITION BY seq, kind ORDER BY frame_idx) - 1 AS i, abs(rate) AS x, sqrt(gyro_x ** 2 + gyro_y ** 2 + gyro_z ** 2) AS y, ok FROM pr)"


@query(f"""WITH {_TURN}, q AS (SELECT seq, kind, quantile_cont(y, 0.5) AS low, quantile_cont(y, 0.9) AS high FROM z WHERE ok GROUP BY 1, 2),
st AS (SELECT seq, kind, 'low' AS stratum, x, y FROM z JOIN q USING (seq, kind) WHERE ok AND y <= low UNION ALL SELECT seq, kind, 'high', x, y FROM z JOIN q USING (seq, kind) WHERE ok AND y >= high)
SELECT seq, kind, stratum, count(*) AS frames, CASE WHEN count(*) >= 5 THEN round(corr(x, y), 6) + 0.0 END AS corr FROM st GROUP BY 1, 2, 3""")
def gyro_motion_strata(spark, sf):
    out = orientation.motion_strata(_rate_and_gyro(spark, sf), _SERIES, "rate", list(L.GYRO), F.col("ok"))
    return S.rounded(out.select(_seq(), "kind", "stratum", "frames", "corr"))


@query(f"""WITH {_TURN}, sh AS (SELECT seq, kind, t, row_number() OVER (PARTITION BY seq, kind, t ORDER BY md5('0:' || t || ':' || i)) - 1 AS i, y FROM z, range(16) r(t)),
c AS (SELECT seq, kind, t, abs(corr(z.x, sh.y)) AS r FROM z JOIN sh USING (seq, kind, i) WHERE ok GROUP BY 1, 2, 3), a AS (SELECT seq, kind, abs(corr(x, y)) AS abs_r FROM z WHERE ok GROUP BY 1, 2)
SELECT seq, kind, count(r) AS trials, round(any_value(abs_r), 6) AS abs_r, round(quantile_cont(r, 0.95), 6) AS abs_r_null FROM c JOIN a USING (seq, kind) GROUP BY 1, 2""")
def gyro_time_shuffle(spark, sf):
    out = orientation.time_shuffle_null(_rate_and_gyro(spark, sf), _SERIES, "frame_idx", "rate", list(L.GYRO), F.col("ok"))
    return S.rounded(out.select(_seq(), "kind", "trials", "abs_r", "abs_r_null"))


@query(f"WITH {_AS}, z AS (SELECT seq, kind, count(*) AS frames, count(*) FILTER (ok) AS valid_frames FROM pr GROUP BY 1, 2) SELECT seq, kind, frames, valid_frames, round(raw_r, 6) + 0.0 AS raw_r, raw_axis, round(smooth_r, 6) + 0.0 AS smooth_r, round(lag_r, 6) + 0.0 AS lag_r, lag_frames FROM z JOIN asn USING (seq, kind)")
def gyro_association(spark, sf):
    return S.rounded(_associations(spark, sf).select("seq", "kind", "frames", "valid_frames", "raw_r", "raw_axis", "smooth_r", "lag_r", "lag_frames"))


@query(f"""WITH {_AS} SELECT kind, count(*) AS series, round(median(abs(raw_r)), 6) AS median_raw_r, round(median(abs(smooth_r)), 6) AS median_smooth_r, round(median(abs(lag_r)), 6) AS median_lag_r, round(median(lag_frames), 6) + 0.0 AS median_lag_frames,
[count(*) FILTER (raw_axis = 0), count(*) FILTER (raw_axis = 1), count(*) FILTER (raw_axis = 2)] AS axis_histogram FROM asn GROUP BY kind""")
def orientation_gyro_summary(spark, sf):
    return S.rounded(orientation.orientation_gyro_summary(_associations(spark, sf), "kind"))


# no two permutations of three have equal sums of products of these factors, so no totals tie
_FRAC = lambda a, b, c: f"((x * ({a} * {a} + 2) * ({b} * {b} * {b} + 3) * 0.37 + {a} * {a} * {b} * {b} * {b} * 0.0013 + {c} * 0.071) % 1.0)"
_GT = "g AS (SELECT seq, frame_idx, p AS gt_id, (frame_idx // 12 + p) % 3 AS track, (frame_idx + p) % 7 <> 0 AS visible FROM f, range(3) t(p))"
_OPTIONS = """op AS (SELECT * FROM (VALUES (0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)) p(a, b, c))"""


def _solved(scores: str, value: str, name: str) -> str:
    """SQL: of three sensors and up to three tracks the best one-to-one choice; a place above the number of tracks is none."""
    return f"""{name}_r AS (SELECT *, dense_rank() OVER (PARTITION BY seq, w ORDER BY track) - 1 AS slot FROM {scores}),
{name}_v AS (SELECT seq, w, a, b, c, sum(CASE WHEN (imu = 0 AND slot = a) OR (imu = 1 AND slot = b) OR (imu = 2 AND slot = c) THEN {value} ELSE 0 END) AS v, max(slot) AS m FROM {name}_r, op GROUP BY 1, 2, 3, 4, 5),
{name}_b AS (SELECT * FROM {name}_v QUALIFY row_number() OVER (PARTITION BY seq, w ORDER BY v DESC, a, b, c) = 1), {name}_u AS (SELECT seq, w, unnest([0, 1, 2]) AS imu, unnest([a, b, c]) AS slot FROM {name}_b),
{name} AS (SELECT u.seq, u.w, u.imu, r.track FROM {name}_u u LEFT JOIN (SELECT DISTINCT seq, w, slot, track FROM {name}_r) r ON r.seq = u.seq AND r.w = u.w AND r.slot = u.slot)"""


def _counted(decided: str, name: str) -> str:
    """SQL: decisions carried to frames by the nearest centre, the earlier of two, and counted."""
    return f"""{name}_c AS (SELECT DISTINCT seq, w, w * 8 + 11.5 AS centre FROM {decided}), {name}_n AS (SELECT f.seq, f.frame_idx, c.w FROM f JOIN {name}_c c ON c.seq = f.seq QUALIFY row_number() OVER (PARTITION BY f.seq, f.frame_idx ORDER BY abs(f.frame_idx - centre), centre) = 1),
{name}_a AS (SELECT n.seq, n.frame_idx, d.imu, d.track FROM {name}_n n JOIN {decided} d ON d.seq = n.seq AND d.w = n.w WHERE d.track IS NOT NULL), {name}_k AS (SELECT seq, frame_idx, track, count(*) AS n, min(imu) AS imu FROM {name}_a GROUP BY 1, 2, 3),
{name} AS (SELECT g.seq, sum(coalesce(k.n = 1 AND k.imu = gt_id, false)::INT)::BIGINT AS correct, count(*) AS total FROM g LEFT JOIN {name}_k k ON k.seq = g.seq AND k.frame_idx = g.frame_idx AND k.track = g.track WHERE visible GROUP BY g.seq)"""


def _sliding(spark, sf) -> DataFrame:
    """seq, w, window_start, window_end: windows of 24 frames every eight."""
    w = windows.fixed_windows(S.sequences(spark, sf), 24, 8)
    return w.select("seq", F.floor(F.col("window_start") / 8).alias("w"), "window_start", "window_end")


def _gt_map(spark, sf) -> DataFrame:
    p = S.frames(spark, sf).select("seq", "frame_idx", F.explode(F.expr("sequence(0L, 2L)")).alias("gt_id"))
    return p.select("seq", "frame_idx", "gt_id", ((F.floor(F.col("frame_idx") / 12) + F.col("gt_id")) % 3).alias("track"), ((F.col("frame_idx") + F.col("gt_id")) % 7 != 0).alias("visible"))


def _window_scores(spark, sf, shift: int) -> DataFrame:
    """Scores of three sensors and three tracks in every window, from its first frame's signal."""
    first = _sliding(spark, sf).join(S.frames(spark, sf).select("seq", F.col("frame_idx").alias("window_start"), "x"), ["seq", "window_start"])
    each = first.withColumn("imu_idx", F.explode(F.expr("sequence(0L, 2L)"))).withColumn("track", F.explode(F.expr("sequence(0L, 2L)")))
    i, t, w = (F.col("imu_idx") + shift) * (F.col("imu_idx") + shift), F.col("track") * F.col("track") * F.col("track"), F.col("w")
    return each.select("seq", "w", "imu_idx", "track", ((F.col("x") * (i + 2) * (t + 3) * F.lit(0.37) + i * t * F.lit(0.0013) + w * F.lit(0.071)) % 1.0).alias("score"))


_WS = f"{S.SEQUENCES}, {_OPTIONS}, {_GT}, wd AS (SELECT seq, unnest(range(0, n_frames - 23, 8)) // 8 AS w FROM q WHERE n_frames >= 24)"


@query(f"""WITH {_WS}, vi AS (SELECT seq, frame_idx, t AS track FROM f, range(3) r(t) WHERE (frame_idx // 24 + seq + t) % 3 = 0 OR (t = 0 AND seq % 5 <> 0)), ac AS (SELECT DISTINCT wd.seq, w, track FROM wd JOIN vi ON vi.seq = wd.seq AND frame_idx BETWEEN w * 8 AND w * 8 + 23),
sc AS (SELECT wd.seq, wd.w, i AS imu, ac.track, {_FRAC("i", "ac.track", "wd.w")} AS score FROM wd JOIN f ON f.seq = wd.seq AND f.frame_idx = wd.w * 8 JOIN ac ON ac.seq = wd.seq AND ac.w = wd.w, range(3) t(i)),
sh AS (SELECT *, sum(score) OVER (PARTITION BY seq, imu, track ORDER BY w) AS total FROM sc), {_solved("sc", "score", "dn")}, {_solved("sh", "total", "dh")}, {_counted("dn", "cn")}, {_counted("dh", "ch")}
SELECT seq, 'now' AS rule, correct, total FROM cn UNION ALL SELECT seq, 'history', correct, total FROM ch""")
def tracked_session_decisions(spark, sf):
    """Windows of a session with the tracks that are seen in them, decided now and by all evidence so far, counted on frames."""
    f = S.frames(spark, sf)
    seen = f.withColumn("track", F.explode(F.expr("sequence(0L, 2L)"))).filter("(floor(frame_idx / 24) + seq + track) % 3 = 0 or (track = 0 and seq % 5 <> 0)")
    w = _sliding(spark, sf)
    return history.tracked_session_decisions(_window_scores(spark, sf, 0), w, seen, f, _gt_map(spark, sf), ["seq"], "w", keep_low=False)


@query(f"""WITH {_WS}, sc AS (SELECT wd.seq, wd.w, i AS imu, t AS track, 0.7 * {_FRAC("i", "t", "wd.w")} + 0.3 * CASE WHEN (i + t) % 3 <> 2 THEN {_FRAC("(i + 1)", "t", "wd.w")} ELSE 0 END AS score FROM wd JOIN f ON f.seq = wd.seq AND f.frame_idx = wd.w * 8, range(3) a(i), range(3) b(t)),
{_solved("sc", "score", "ds")}, {_counted("ds", "cs")}, m AS (SELECT *, 's' || (seq % 7) AS session FROM cs) SELECT session, count(*) AS clips, sum(correct)::BIGINT AS correct, sum(total)::BIGINT AS total, round(avg(correct / total), 6) AS mean_clip_acc, round(sum(correct) / sum(total), 6) AS frame_acc FROM m GROUP BY ROLLUP (session)""")
def segment_decisions(spark, sf):
    """Each segment decided by a mix of two scores, of which the second lacks some pairs; clips rolled up by session."""
    pair = _window_scores(spark, sf, 1).filter("(imu_idx + track) % 3 <> 2")
    clips = history.segment_decisions(_window_scores(spark, sf, 0), pair, _sliding(spark, sf), S.frames(spark, sf), _gt_map(spark, sf), ["seq"], "w", 0.7, 0.3)
    return S.rounded(session_rollup(clips.withColumn("session", F.concat(F.lit("s"), (F.col("seq") % 7).cast("string")))))


