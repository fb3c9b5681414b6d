"""Ordered-series operators and joins on the given tables."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from kinelink.operators import joins, series
from kinelink.plans import standins as S
from kinelink.plans.registry import query

_W = "(PARTITION BY seq ORDER BY frame_idx)"


@query(f"""WITH {S.FRAMES}, a AS (SELECT seq, frame_idx, ts_s, ok, CASE WHEN ok THEN x ELSE 0 END AS x, CASE WHEN ok THEN y ELSE 0 END AS y, first_value(CASE WHEN ok THEN x END IGNORE NULLS) OVER (PARTITION BY seq ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS x0 FROM f),
v AS (SELECT *, coalesce(ok AND lag(ok) OVER {_W} AND ts_s > lag(ts_s) OVER {_W}, false) AS vv, ts_s - lag(ts_s) OVER {_W} AS dt, x - lag(x) OVER {_W} AS dx, y - lag(y) OVER {_W} AS dy FROM a),
v2 AS (SELECT *, CASE WHEN vv THEN dx / dt ELSE 0 END AS vx, CASE WHEN vv THEN dy / dt ELSE 0 END AS vy FROM v),
c AS (SELECT *, coalesce(vv AND lag(vv) OVER {_W}, false) AS av, CASE WHEN vv AND lag(vv) OVER {_W} THEN (vx - lag(vx) OVER {_W}) / dt ELSE 0 END AS ax FROM v2),
j AS (SELECT *, coalesce(av AND lag(av) OVER {_W}, false) AS jv, CASE WHEN av AND lag(av) OVER {_W} THEN (ax - lag(ax) OVER {_W}) / dt ELSE 0 END AS jx FROM c)
SELECT seq, frame_idx, round(CASE WHEN ok THEN x - x0 ELSE 0 END, 6) + 0.0 AS x_displacement, round(vx, 6) + 0.0 AS x_velocity, round(ax, 6) + 0.0 AS x_acceleration, round(jx, 6) + 0.0 AS x_jerk, round(sqrt(vx * vx + vy * vy), 6) + 0.0 AS speed, vv AS velocity_valid, av AS acceleration_valid, jv AS jerk_valid FROM j""")
def derivatives(spark, sf):
    out = series.derivatives(S.frames(spark, sf), ["seq"], "ts_s", ["x", "y"], F.col("ok"))
    return S.rounded(out.select("seq", "frame_idx", "x_displacement", "x_velocity", "x_acceleration", "x_jerk", "speed", "velocity_valid", "acceleration_valid", "jerk_valid"))


@query(f"WITH {S.FRAMES}, a AS (SELECT *, coalesce(x - lag(x) OVER {_W}, 0) AS d FROM f) SELECT seq, frame_idx, round(coalesce(d - lag(d) OVER {_W}, 0), 6) + 0.0 AS d2 FROM a")
def diff_zero(spark, sf):
    return S.rounded(series.diff_zero(S.frames(spark, sf), ["seq"], ["frame_idx"], "x", 2, "d2").select("seq", "frame_idx", "d2"))


@query(f"""WITH {S.FRAMES}, n AS (SELECT seq, count(*) AS n FROM f GROUP BY seq), k AS (SELECT f.seq, f.frame_idx, least(greatest(f.frame_idx + d, 0), n.n - 1) AS at FROM f JOIN n USING (seq), range(-4, 5) t(d))
SELECT k.seq, k.frame_idx, round(sum(x) / 9, 6) + 0.0 AS x_ma FROM k JOIN f ON k.seq = f.seq AND k.at = f.frame_idx GROUP BY 1, 2""")
def moving_average(spark, sf):
    return S.rounded(series.moving_average(S.frames(spark, sf), ["seq"], ["frame_idx"], "x", 9).select("seq", "frame_idx", "x_ma"))


@query(f"WITH {S.FRAMES}, w AS (SELECT seq, frame_idx, count(CASE WHEN ok THEN x END) OVER h AS c, avg(CASE WHEN ok THEN x END) OVER h AS m FROM f WINDOW h AS (PARTITION BY seq ORDER BY frame_idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) SELECT seq, frame_idx, round(CASE WHEN c >= 4 THEN m END, 6) AS x_ma FROM w")
def masked_moving_average(spark, sf):
    return S.rounded(series.masked_moving_average(S.frames(spark, sf), ["seq"], ["frame_idx"], "x", F.col("ok"), 7).select("seq", "frame_idx", "x_ma"))


_RUNS = f"""{S.FRAMES}, m AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY seq, ok ORDER BY frame_idx) AS isl FROM f), rn AS (SELECT seq, isl, count(*) AS length, min(frame_idx) AS "first", max(frame_idx) AS "last" FROM m WHERE ok GROUP BY seq, isl)"""


@query(f'WITH {_RUNS} SELECT seq, length, "first", "last" FROM rn')
def runs(spark, sf):
    return series.runs(S.frames(spark, sf), ["seq"], ["frame_idx"], F.col("ok")).drop("run")


@query(f"""WITH {_RUNS}, z AS (SELECT seq, count(*) AS n FROM f GROUP BY seq), g AS (SELECT seq, count(*) AS runs, max(length) AS longest FROM rn GROUP BY seq)
SELECT z.seq, n, coalesce(runs, 0) AS runs, coalesce(g.longest, 0) AS longest, min(rn."first") AS longest_first, greatest(coalesce(runs, 0) - 1, 0) AS fragmentation FROM z LEFT JOIN g USING (seq) LEFT JOIN rn ON rn.seq = z.seq AND rn.length = g.longest GROUP BY 1, 2, 3, 4, 6""")
def run_summary(spark, sf):
    return series.run_summary(S.frames(spark, sf), ["seq"], ["frame_idx"], F.col("ok"))


def _angles(spark, sf):
    return S.frames(spark, sf).withColumn("a", F.round(F.atan2(F.col("y") - 5.0, F.col("x") - 20.0), 9))


def _unwrap_sql(period: str) -> str:
    return f"""{S.FRAMES}, g0 AS (SELECT *, round(atan2(y - 5.0, x - 20.0), 9) AS a, row_number() OVER (PARTITION BY seq ORDER BY frame_idx) - row_number() OVER (PARTITION BY seq, ok ORDER BY frame_idx) AS isl FROM f),
st AS (SELECT *, a - lag(a) OVER (PARTITION BY seq, ok, isl ORDER BY frame_idx) AS d FROM g0), p2 AS (SELECT {period} AS t),
fx AS (SELECT st.*, CASE WHEN d IS NULL OR abs(d) < t / 2 THEN 0 ELSE d - t * floor((d + t / 2) / t) - d END AS fix FROM st, p2),
un AS (SELECT *, a + sum(fix) OVER (PARTITION BY seq, ok, isl ORDER BY frame_idx) AS u FROM fx)"""


_UNWRAP = _unwrap_sql("2 * pi()")
_RATE = """h AS (SELECT *, u - lag(u) OVER k AS du, ts_s - lag(ts_s) OVER k AS hb, lead(u) OVER k - u AS eu, lead(ts_s) OVER k - ts_s AS ha FROM un WINDOW k AS (PARTITION BY seq, ok, isl ORDER BY frame_idx)),
rr AS (SELECT *, CASE WHEN NOT ok THEN NULL WHEN du IS NOT NULL AND eu IS NOT NULL THEN (du / hb * ha + eu / ha * hb) / (ha + hb) ELSE coalesce(du / hb, eu / ha) END AS rate FROM h)"""


@query(f"WITH {_UNWRAP} SELECT seq, frame_idx, round(CASE WHEN ok THEN u END, 6) + 0.0 AS unwrapped FROM un")
def unwrap(spark, sf):
    return S.rounded(series.unwrap(_angles(spark, sf), ["seq"], ["frame_idx"], "a", F.col("ok")).select("seq", "frame_idx", "unwrapped"))


@query(f"WITH {_UNWRAP}, {_RATE} SELECT seq, frame_idx, round(coalesce(rate, 0), 6) + 0.0 AS rate, rate IS NOT NULL AS rate_valid FROM rr")
def angle_rate(spark, sf):
    return S.rounded(series.angle_rate(_angles(spark, sf), ["seq"], "ts_s", "a", F.col("ok")).select("seq", "frame_idx", "rate", "rate_valid"))


@query(f"WITH {_unwrap_sql('pi()')}, {_RATE} SELECT seq, frame_idx, round(coalesce(rate, 0), 6) + 0.0 AS rate, rate IS NOT NULL AS rate_valid FROM rr")
def angle_rate_line(spark, sf):
    """The rate of an axis without a front: period pi."""
    return S.rounded(series.angle_rate(_angles(spark, sf), ["seq"], "ts_s", "a", F.col("ok"), math.pi).select("seq", "frame_idx", "rate", "rate_valid"))


_QUAT = ["quat_w", "quat_x", "quat_y", "quat_z"]


@query(f"""WITH {S.SENSORS}, d AS (SELECT *, quat_w * lag(quat_w) OVER {_W} + quat_x * lag(quat_x) OVER {_W} + quat_y * lag(quat_y) OVER {_W} + quat_z * lag(quat_z) OVER {_W} AS p FROM im),
l AS (SELECT *, coalesce(p <> 0, false) AS linked FROM d), b AS (SELECT *, sum((NOT linked)::INT) OVER {_W} AS blk FROM l),
o AS (SELECT *, sum((linked AND p < 0)::INT) OVER (PARTITION BY seq, blk ORDER BY frame_idx) % 2 = 1 AS odd FROM b)
SELECT seq, frame_idx, {", ".join(f"round(CASE WHEN odd THEN -{q} ELSE {q} END, 6) + 0.0 AS {q}" for q in _QUAT)} FROM o""")
def quaternion_continuity(spark, sf):
    return S.rounded(series.quaternion_continuity(S.sensors(spark, sf), ["seq"], ["frame_idx"], _QUAT).select("seq", "frame_idx", *_QUAT))


@query(f"""WITH {S.SENSORS}, n AS (SELECT *, sqrt(quat_w * quat_w + quat_x * quat_x + quat_y * quat_y + quat_z * quat_z) AS nn FROM im), u AS (SELECT seq, frame_idx, ts_s, quat_w / nn AS w, quat_x / nn AS x, quat_y / nn AS y, quat_z / nn AS z FROM n)
SELECT seq, frame_idx, round(coalesce(2 * acos(least(1.0, abs(w * lag(w) OVER {_W} + x * lag(x) OVER {_W} + y * lag(y) OVER {_W} + z * lag(z) OVER {_W}))) / (ts_s - lag(ts_s) OVER {_W}), 0), 4) + 0.0 AS angular_speed FROM u""")
def imu_views(spark, sf):
    return S.rounded(series.imu_views(S.sensors(spark, sf), ["seq"], "ts_s").select("seq", "frame_idx", "angular_speed"), 4)


@query(f"""WITH {S.SENSORS}, m AS (SELECT *, sqrt(acc_x * acc_x + acc_y * acc_y + acc_z * acc_z) AS s, ts_s - lag(ts_s) OVER {_W} AS dt FROM im)
SELECT seq, frame_idx, round(s, 6) AS acc_magnitude, round(s - avg(s) OVER (PARTITION BY seq), 6) + 0.0 AS acc_magnitude_centered, round(coalesce((acc_x - lag(acc_x) OVER {_W}) / dt, 0), 5) + 0.0 AS acc_dx FROM m""")
def imu_magnitude(spark, sf):
    out = series.imu_views(S.sensors(spark, sf), ["seq"], "ts_s", False, False).select("seq", "frame_idx", "acc_magnitude", "acc_magnitude_centered", F.round("acc_dx", 5).alias("acc_dx"))
    return S.rounded(out)


@query(f"WITH {S.FRAMES} SELECT seq, frame_idx, coalesce(last_value(CASE WHEN ok THEN x END IGNORE NULLS) OVER (PARTITION BY seq ORDER BY frame_idx), first_value(CASE WHEN ok THEN x END IGNORE NULLS) OVER (PARTITION BY seq ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS x FROM f")
def fill_forward_back(spark, sf):
    gaps = S.frames(spark, sf).withColumn("x", F.when(F.col("ok"), F.col("x")))
    return series.fill_forward_back(gaps, ["seq"], ["frame_idx"], ["x"]).select("seq", "frame_idx", "x")


@query(f"""WITH {S.FRAMES}, c AS (SELECT a.seq, a.frame_idx, b.x, row_number() OVER (PARTITION BY a.seq, a.frame_idx ORDER BY abs(a.frame_idx - b.frame_idx), b.frame_idx) AS k FROM f a JOIN f b ON a.seq = b.seq AND b.ok) SELECT f.seq, f.frame_idx, coalesce(c.x, 1.0) AS x FROM f LEFT JOIN c ON c.seq = f.seq AND c.frame_idx = f.frame_idx AND k = 1""")
def nearest_valid_fill(spark, sf):
    return series.nearest_valid_fill(S.frames(spark, sf), ["seq"], "frame_idx", ["x"], F.col("ok"), {"x": 1.0}).select("seq", "frame_idx", "x")


@query(f"WITH {S.FRAMES}, t AS (SELECT seq, coalesce(kind <> lag(kind) OVER {_W}, false) AS c FROM f) SELECT seq, sum(c::INT)::BIGINT AS transitions FROM t GROUP BY seq")
def transition_count(spark, sf):
    return series.transition_count(S.frames(spark, sf), ["seq"], ["frame_idx"], "kind")


@query(f"WITH {S.FRAMES} SELECT seq, frame_idx, round((x - avg(x) OVER (PARTITION BY seq)) / greatest(stddev_pop(x) OVER (PARTITION BY seq), 1e-5), 6) + 0.0 AS x_z FROM f")
def zscore_window(spark, sf):
    return S.rounded(series.zscore(S.frames(spark, sf), ["seq"], ["x"]).select("seq", "frame_idx", "x_z"))


_LAG = f"""{S.FRAMES}, l AS (SELECT a.seq, g.lag, a.x, b.y FROM f b, range(-4, 5) g(lag) JOIN f a ON a.seq = b.seq AND a.frame_idx = b.frame_idx + g.lag),
lc AS (SELECT seq, lag, count(*) AS n, CASE WHEN count(*) < 8 OR count(*) * sum(x * x) - sum(x) ** 2 <= 1e-12 * greatest(count(*) * sum(x * x), 1e-30) OR count(*) * sum(y * y) - sum(y) ** 2 <= 1e-12 * greatest(count(*) * sum(y * y), 1e-30) THEN NULL
  ELSE (count(*) * sum(x * y) - sum(x) * sum(y)) / (sqrt(count(*) * sum(x * x) - sum(x) ** 2) * sqrt(count(*) * sum(y * y) - sum(y) ** 2)) END AS corr FROM l GROUP BY 1, 2)"""


@query(f"WITH {_LAG} SELECT seq, lag, n, round(corr, 6) + 0.0 AS corr FROM lc")
def lag_correlation(spark, sf):
    return S.rounded(series.lag_correlation(S.frames(spark, sf), ["seq"], ["frame_idx"], "x", "y", 4, 8))


@query(f"WITH {_LAG} SELECT seq, lag AS best_lag, round(corr, 6) + 0.0 AS best_corr FROM lc WHERE corr IS NOT NULL QUALIFY row_number() OVER (PARTITION BY seq ORDER BY round(abs(corr), 9) DESC, abs(lag), lag) = 1")
def best_lag(spark, sf):
    return S.rounded(series.best_lag(series.lag_correlation(S.frames(spark, sf), ["seq"], ["frame_idx"], "x", "y", 4, 8), ["seq"]))


@query(f"""WITH {S.SENSORS}, j AS (SELECT *, sqrt(acc_x * acc_x + acc_y * acc_y + acc_z * acc_z) AS s, sqrt((acc_x - 2 * lag(acc_x) OVER {_W} + lag(acc_x, 2) OVER {_W}) ** 2 + (acc_y - 2 * lag(acc_y) OVER {_W} + lag(acc_y, 2) OVER {_W}) ** 2 + (acc_z - 2 * lag(acc_z) OVER {_W} + lag(acc_z, 2) OVER {_W}) ** 2) AS j FROM im)
SELECT seq, round(avg(s), 6) AS acc_mean, round(stddev_pop(s), 6) AS acc_std, round(avg(s * s), 6) AS acc_energy, round(coalesce(avg(j), 0), 6) AS acc_jerk_energy, round(avg((abs(acc_x) + abs(acc_y) + abs(acc_z)) / 3), 6) AS acc_abs_mean FROM j GROUP BY seq""")
def imu_activity(spark, sf):
    return S.rounded(series.imu_activity(S.sensors(spark, sf), ["seq"], ["frame_idx"], ("acc_x", "acc_y", "acc_z")))


@query()
def imu_dynamic_features(spark, sf):
    return S.rounded(series.imu_sequence_features(S.sensors(spark, sf), ["seq"], ["frame_idx"], ["acc_x", "acc_y", "acc_z"], _QUAT).drop("gyro_x", "gyro_y", "gyro_z"), 4)


@query(f"WITH {S.BOXES} SELECT frame, gt_idx, track_idx, round(iou, 6) AS iou FROM ov WHERE iou > 0 QUALIFY row_number() OVER (PARTITION BY frame, gt_idx ORDER BY iou DESC, track_idx) = 1")
def match_boxes_argmax(spark, sf):
    gt, det = S.boxes(spark, sf)
    return S.rounded(joins.match_boxes_argmax(gt, det, ["frame"]))


@query(f"""WITH {S.BOXES}, fr AS (SELECT DISTINCT frame FROM ov), {", ".join(f"o{k} AS (SELECT frame, -1 AS g, 0.0::DOUBLE AS s FROM fr UNION ALL SELECT frame, gt_idx, iou FROM ov WHERE track_idx = {k} AND iou > 0)" for k in range(3))},
cb AS (SELECT frame, o0.g AS a, o1.g AS b, o2.g AS c, round(o0.s + o1.s + o2.s, 9) AS v FROM o0 JOIN o1 USING (frame) JOIN o2 USING (frame) WHERE (o0.g < 0 OR (o0.g <> o1.g AND o0.g <> o2.g)) AND (o1.g < 0 OR o1.g <> o2.g) QUALIFY row_number() OVER (PARTITION BY frame ORDER BY v DESC, a < 0, a, b < 0, b, c < 0, c) = 1),
m AS (SELECT frame, unnest([0, 1, 2]) AS track_idx, unnest([a, b, c]) AS gt_idx FROM cb) SELECT frame, ov.gt_idx, ov.track_idx, round(iou, 6) AS iou FROM m JOIN ov USING (frame, track_idx, gt_idx) WHERE iou >= 0.1""")
def match_boxes_hungarian(spark, sf):
    gt, det = S.boxes(spark, sf)
    return S.rounded(joins.match_boxes_hungarian(gt, det, ["frame"]))


@query(f"""WITH {S.BOXES}, a AS (SELECT frame, gt_idx, track_idx, iou FROM ov WHERE track_idx = (SELECT min(track_idx) FROM det d WHERE d.frame = ov.frame) QUALIFY row_number() OVER (PARTITION BY frame ORDER BY visible DESC, iou DESC, gt_idx) = 1),
t2 AS (SELECT frame, track_idx, row_number() OVER (PARTITION BY frame ORDER BY track_idx) AS k FROM det),
b AS (SELECT ov.frame, ov.gt_idx, ov.track_idx, ov.iou FROM ov JOIN t2 ON t2.frame = ov.frame AND t2.track_idx = ov.track_idx AND k = 2 WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.frame = ov.frame AND a.gt_idx = ov.gt_idx) QUALIFY row_number() OVER (PARTITION BY ov.frame ORDER BY visible DESC, iou DESC, ov.gt_idx) = 1),
c AS (SELECT ov.frame, ov.gt_idx, ov.track_idx, ov.iou FROM ov JOIN t2 ON t2.frame = ov.frame AND t2.track_idx = ov.track_idx AND k = 3 WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.frame = ov.frame AND a.gt_idx = ov.gt_idx) AND NOT EXISTS (SELECT 1 FROM b WHERE b.frame = ov.frame AND b.gt_idx = ov.gt_idx) QUALIFY row_number() OVER (PARTITION BY ov.frame ORDER BY visible DESC, iou DESC, ov.gt_idx) = 1)
SELECT frame, gt_idx, track_idx, round(iou, 6) AS iou FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)""")
def match_boxes_exclusive(spark, sf):
    gt, det = S.boxes(spark, sf)
    return S.rounded(joins.match_boxes_exclusive(gt, det, ["frame"]).select("frame", "gt_idx", "track_idx", "iou"))


_GRID = f"{S.FRAMES}, b AS (SELECT seq, floor(min(ts_s)) AS lo FROM f GROUP BY seq), g AS (SELECT seq, lo - 50 + 3600.0::DOUBLE * i AS ts_s, i FROM b, range(40) t(i)), sm AS (SELECT seq, ts_s, x FROM f QUALIFY row_number() OVER (PARTITION BY seq, ts_s ORDER BY frame_idx DESC) = 1)"


def _grid(spark, sf):
    f = S.frames(spark, sf)
    start = f.groupBy("seq").agg(F.floor(F.min("ts_s")).alias("lo"))
    samples = f.withColumn("_k", F.row_number().over(Window.partitionBy("seq", "ts_s").orderBy(F.desc("frame_idx")))).filter("_k = 1").select("seq", "ts_s", "x")
    return samples, start.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(39)))).select("seq", (F.col("lo") - 50 + 3600.0 * F.col("i")).alias("ts_s"), F.col("i").cast("long").alias("i"))


_INTERP = f"""WITH {_GRID}, lo_ AS (SELECT g.seq, g.i, g.ts_s, s.ts_s AS t0, s.x AS x0 FROM g ASOF LEFT JOIN sm s ON g.seq = s.seq AND g.ts_s >= s.ts_s), hi_ AS (SELECT g.seq, g.i, s.ts_s AS t1, s.x AS x1 FROM g ASOF LEFT JOIN sm s ON g.seq = s.seq AND g.ts_s <= s.ts_s)"""


@query(f"{_INTERP} SELECT seq, i, round(CASE WHEN t0 = ts_s THEN x0 WHEN t0 IS NOT NULL AND t1 IS NOT NULL THEN x0 + (x1 - x0) * (ts_s - t0) / (t1 - t0) END, 6) + 0.0 AS x FROM lo_ JOIN hi_ USING (seq, i)")
def interpolate_join(spark, sf):
    samples, grid = _grid(spark, sf)
    return S.rounded(joins.interpolate_join(samples, grid, ["seq"], "ts_s", ["x"]).select("seq", "i", "x"))


@query(f"{_INTERP} SELECT seq, i, round(CASE WHEN t0 = ts_s THEN x0 WHEN t0 IS NOT NULL AND t1 IS NOT NULL THEN x0 + (x1 - x0) * (ts_s - t0) / (t1 - t0) ELSE coalesce(x0, x1) END, 6) + 0.0 AS x FROM lo_ JOIN hi_ USING (seq, i)")
def interpolate_join_clamped(spark, sf):
    samples, grid = _grid(spark, sf)
    return S.rounded(joins.interpolate_join(samples, grid, ["seq"], "ts_s", ["x"], "clamp").select("seq", "i", "x"))


@query(f"WITH {S.FRAMES}, c AS (SELECT seq, frame_idx AS center, x FROM f WHERE frame_idx % 16 = 12) SELECT f.seq, f.frame_idx, c.center FROM f LEFT JOIN c ON c.seq = f.seq QUALIFY row_number() OVER (PARTITION BY f.seq, f.frame_idx ORDER BY abs(c.center - f.frame_idx), c.center) = 1")
def nearest_center_join(spark, sf):
    f = S.frames(spark, sf)
    centers = f.filter("frame_idx % 16 = 12").select("seq", F.col("frame_idx").alias("center"), F.col("frame_idx").alias("c"))
    return joins.nearest_join(f.select("seq", "frame_idx"), centers, ["seq"], "frame_idx", "center", ["c"]).select("seq", "frame_idx", F.col("c").alias("center"))


@query(f"WITH {S.FRAMES}, h AS (SELECT seq % 7 AS session, seq || ':' || frame_idx AS id, frame_idx FROM f WHERE kind = 'purchase') SELECT session, id FROM h WHERE EXISTS (SELECT 1 FROM h o WHERE o.session = h.session AND o.id <> h.id AND abs(o.frame_idx - h.frame_idx) <= 0)")
def persistent_high(spark, sf):
    h = S.frames(spark, sf).filter("kind = 'purchase'").select((F.col("seq") % 7).alias("session"), F.concat_ws(":", F.col("seq").cast("string"), F.col("frame_idx").cast("string")).alias("id"), "frame_idx")
    return joins.near_in_time(h, h, ["session"], "frame_idx", "id", 0).select("session", "id")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def missing_refs(spark, sf):
    orders = S.table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return joins.missing_refs(S.table(spark, sf, "customer").select("c_custkey"), orders, "c_custkey")


@query("SELECT value, splits FROM (SELECT o_custkey::VARCHAR AS value, list_sort(list(DISTINCT CASE WHEN o_orderkey % 5 = 0 THEN 'test' WHEN o_orderkey % 5 = 1 THEN 'val' ELSE 'train' END)) AS splits FROM orders GROUP BY 1) WHERE len(splits) > 1")
def split_overlap(spark, sf):
    rows = S.table(spark, sf, "orders").select("o_custkey", F.when(F.col("o_orderkey") % 5 == 0, "test").when(F.col("o_orderkey") % 5 == 1, "val").otherwise("train").alias("split"))
    return joins.split_overlap(rows, "o_custkey")


@query(f"""WITH {S.SEQUENCES}, d AS (SELECT session, seq AS device, 'f' || seq AS file, CASE WHEN seq % 3 = 0 THEN 100 + seq // 7 END AS mapped FROM q), pp AS (SELECT session, 100 + i AS person_idx FROM (SELECT DISTINCT session FROM q), range(30) t(i)),
fr AS (SELECT session, person_idx, row_number() OVER (PARTITION BY session ORDER BY person_idx) AS n FROM pp WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.session = pp.session AND d.mapped = pp.person_idx)),
un AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY file) AS n FROM d WHERE mapped IS NULL)
SELECT session, device, mapped AS person_idx FROM d WHERE mapped IS NOT NULL UNION ALL SELECT un.session, device, fr.person_idx FROM un LEFT JOIN fr ON fr.session = un.session AND fr.n = un.n""")
def device_to_person(spark, sf):
    q = S.sequences(spark, sf)
    devices = q.select("session", F.col("seq").alias("device"), F.concat(F.lit("f"), F.col("seq").cast("string")).alias("file"))
    mapping = q.filter("seq % 3 = 0").select("session", F.col("seq").alias("device"), (100 + F.floor(F.col("seq") / 7)).alias("person_idx"))
    people = q.select("session").distinct().withColumn("person_idx", F.explode(F.expr("sequence(100L, 129L)")))
    return joins.device_to_person(devices, mapping, people, ["session"]).select("session", "device", "person_idx")


@query("""WITH v AS (SELECT l_partkey % 500 AS k, l_linenumber AS m, sum(l_quantity) AS x FROM lineitem GROUP BY 1, 2), j AS (SELECT a.m AS left_method, b.m AS right_method, a.x, b.x AS y FROM v a JOIN v b ON a.k = b.k AND a.m < b.m)
SELECT left_method, right_method, count(*) AS n, round(avg((x = y)::INT), 6) AS equal_share, round(avg(abs(x - y)), 6) AS mean_abs_delta, round(corr(x, y), 6) AS corr FROM j GROUP BY 1, 2""")
def method_pairs(spark, sf):
    v = S.table(spark, sf, "lineitem").groupBy((F.col("l_partkey") % 500).alias("k"), F.col("l_linenumber").alias("m")).agg(F.sum("l_quantity").alias("x"))
    return S.rounded(joins.method_pairs(v, ["k"], "m", "x"))


@query(f"""WITH {S.RECORDINGS}, o AS (SELECT seq % 2 AS session, seq // 2 AS person, frame_idx, e[1] AS rate, e[2] AS gyro FROM r), n AS (SELECT session, max(person) + 1 AS people FROM o GROUP BY session),
j AS (SELECT a.session, a.person, a.frame_idx, a.rate, b.gyro, 'matched' AS kind FROM o a JOIN o b USING (session, person, frame_idx) UNION ALL SELECT a.session, a.person, a.frame_idx, a.rate, b.gyro, 'shuffled' FROM o a JOIN n USING (session) JOIN o b ON b.session = a.session AND b.person = (a.person + 1) % people AND b.frame_idx = a.frame_idx)
SELECT kind, session, count(*) AS n, round(sum(rate * gyro), 6) + 0.0 AS product FROM j GROUP BY 1, 2""")
def orientation_gyro_join(spark, sf):
    o = S.recordings(spark, sf).select((F.col("seq") % 2).alias("session"), F.floor(F.col("seq") / 2).alias("person"), "frame_idx", F.get("e", F.lit(0)).alias("rate"), F.get("e", F.lit(1)).alias("gyro"))
    people = o.groupBy("session").agg((F.max("person") + 1).alias("people"))
    left = o.drop("gyro").join(people, "session")
    out = joins.orientation_gyro_join(left, o.drop("rate"), ["session"], "person", "people")
    return S.rounded(out.groupBy("kind", "session").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("rate") * F.col("gyro")).alias("product")))


@query("""WITH a AS (SELECT o_custkey % 300 AS k, avg(o_totalprice) AS x FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT o_custkey % 300 AS k, avg(o_totalprice) AS x FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)
SELECT count(*) AS n, round(avg(a.x - b.x), 4) AS mean_difference, round(stddev_samp(a.x - b.x), 4) AS std_difference, round(avg(a.x - b.x) / stddev_samp(a.x - b.x), 4) AS cohen_dz FROM a JOIN b USING (k)""")
def paired_difference(spark, sf):
    o = S.table(spark, sf, "orders").withColumn("k", F.col("o_custkey") % 300)
    side = lambda p: o.filter(F.col("o_orderkey") % 2 == p).groupBy("k").agg(F.avg("o_totalprice").alias("x"))
    shared = side(0).join(side(1).select("k"), "k", "left_semi"), side(1).join(side(0).select("k"), "k", "left_semi")
    return S.rounded(joins.paired_difference(*shared, ["k"], "x"), 4)


@query("SELECT o_orderkey, o_orderpriority, c_mktsegment, c_mktsegment IS NOT NULL AS has_strata FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_nationkey < 20) c ON o_custkey = c_custkey")
def attach_strata(spark, sf):
    c = S.table(spark, sf, "customer").filter("c_nationkey < 20").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return joins.attach_strata(S.table(spark, sf, "orders"), c, ["o_custkey"]).select("o_orderkey", "o_orderpriority", "c_mktsegment", "has_strata")
