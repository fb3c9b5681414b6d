"""Poses, decisions over time, linking, quality gates and statistics on the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kinelink.functions import layouts as L
from kinelink.functions import pose as P
from kinelink.functions import quaternions as Q
from kinelink.functions import vectors as V
from kinelink.operators import batches, history, linking, quality, stats
from kinelink.plans import standins as S
from kinelink.plans.registry import query


def _axis(i: int, a: int) -> str:
    return f"e[{3 * i + 1 + a}]"


def _xyz(joints, i: int, name: str):
    return [P.joint(joints, i)[a].alias(f"{name}_{a}") for a in "xyz"]


@query(f"""WITH {S.RECORDINGS}, n AS (SELECT *, greatest(sqrt(({_axis(8, 0)} - {_axis(0, 0)}) ** 2 + ({_axis(8, 1)} - {_axis(0, 1)}) ** 2 + ({_axis(8, 2)} - {_axis(0, 2)}) ** 2), 1e-6) AS s FROM r)
SELECT seq, frame_idx, {", ".join(f"round(({_axis(13, k)} - {_axis(0, k)}) / s, 6) + 0.0 AS wrist_{a}" for k, a in enumerate("xyz"))} FROM n""")
def root_torso_normalize(spark, sf):
    j = S.skeletons(spark, sf).withColumn("joints", P.root_torso_normalize("joints"))
    return S.rounded(j.select("seq", "frame_idx", *_xyz("joints", 13, "wrist")))


@query(f"""WITH {S.RECORDINGS} SELECT seq, frame_idx, round(({_axis(11, 0)} + {_axis(12, 0)}) / 2, 6) + 0.0 AS pelvis_x, round(({_axis(5, 1)} + {_axis(6, 1)}) / 2, 6) + 0.0 AS thorax_y,
round({_axis(0, 0)} + 0.5 * ({_axis(0, 0)} - (({_axis(5, 0)} + {_axis(6, 0)}) / 2 + {_axis(0, 0)}) / 2), 6) + 0.0 AS head_x, 0.0::DOUBLE AS head_z, round({_axis(0, 1)}, 6) + 0.0 AS neck_y FROM r""")
def coco17_to_h36m17(spark, sf):
    j = S.skeletons(spark, sf).withColumn("h", P.coco17_to_h36m17("joints"))
    at = lambda n: P.joint("h", L.H36M17.index(n))
    return S.rounded(j.select("seq", "frame_idx", at("pelvis")["x"].alias("pelvis_x"), at("thorax")["y"].alias("thorax_y"), at("head")["x"].alias("head_x"), at("head")["z"].alias("head_z"), at("neck")["y"].alias("neck_y")))


@query(f"""WITH {S.RECORDINGS}, n AS (SELECT *, sqrt(({_axis(8, 0)} - {_axis(0, 0)}) ** 2 + ({_axis(8, 1)} - {_axis(0, 1)}) ** 2) AS s FROM r)
SELECT seq, frame_idx, round(({_axis(8, 0)} - {_axis(0, 0)}) * (CASE WHEN s > 1e-6 THEN 171.0 / s ELSE 171.0 END) + 960, 5) AS thorax_x, round(({_axis(8, 1)} - {_axis(0, 1)}) * (CASE WHEN s > 1e-6 THEN 171.0 / s ELSE 171.0 END) + 540, 5) AS thorax_y FROM n""")
def screen_calibrate(spark, sf):
    j = S.skeletons(spark, sf).withColumn("joints", P.screen_calibrate("joints"))
    return S.rounded(j.select("seq", "frame_idx", P.joint("joints", 8)["x"].alias("thorax_x"), P.joint("joints", 8)["y"].alias("thorax_y")), 5)


_JT = f"{S.RECORDINGS}, jt AS (SELECT seq, frame_idx, j, e[3 * j + 1] AS x, e[3 * j + 2] AS y, e[3 * j + 3] AS z, e[3 * j + 3] > -0.1 AS v FROM r, range(17) t(j)), bx AS (SELECT seq, frame_idx, min(x) AS x1, max(x) AS x2, min(y) AS y1, max(y) AS y2 FROM jt WHERE v GROUP BY 1, 2)"


def _visible(spark, sf):
    return S.skeletons(spark, sf).withColumn("v", F.transform("joints", lambda p: p["z"] > -0.1))


@query(f"WITH {_JT} SELECT seq, frame_idx, j AS joint, round(CASE WHEN v THEN (x - (x1 + x2) / 2) / greatest(x2 - x1, y2 - y1, 1e-5) ELSE 0 END, 6) + 0.0 AS x, round(CASE WHEN v THEN (y - (y1 + y2) / 2) / greatest(x2 - x1, y2 - y1, 1e-5) ELSE 0 END, 6) + 0.0 AS y FROM jt LEFT JOIN bx USING (seq, frame_idx)")
def bbox_normalize(spark, sf):
    j = _visible(spark, sf).select("seq", "frame_idx", F.posexplode(P.bbox_normalize("joints", "v")).alias("joint", "p"))
    return S.rounded(j.select("seq", "frame_idx", "joint", "p.x", "p.y"))


@query(f"""WITH {_JT}, a AS (SELECT seq, frame_idx, count(*) FILTER (v AND j IN (11, 14)) AS n3, avg(x) FILTER (v AND j IN (11, 14)) AS x3, count(*) FILTER (v AND j IN (11, 14, 12, 13)) AS n5, avg(y) FILTER (v AND j IN (11, 14, 12, 13)) AS y5, avg(z) FILTER (v) AS z6, count(*) FILTER (v) AS n6 FROM jt GROUP BY 1, 2)
SELECT a.seq, a.frame_idx, n3 >= 2 AS a3_valid, round(CASE WHEN n3 >= 2 THEN x3 ELSE 0 END, 6) + 0.0 AS a3_x, n5 >= 2 AS a5_valid, round(CASE WHEN n5 >= 2 THEN y5 ELSE 0 END, 6) + 0.0 AS a5_y, round(coalesce(z6, 0), 6) + 0.0 AS a6_z, n6 > 0 AS a7_valid, round(coalesce((x1 + x2) / 2, 0), 6) + 0.0 AS a7_x FROM a LEFT JOIN bx USING (seq, frame_idx)""")
def global_anchors(spark, sf):
    a = P.global_anchors("joints", "v", L.H36M17)
    j = _visible(spark, sf).select("seq", "frame_idx", *(a[n].alias(n) for n in a))
    return S.rounded(j.select("seq", "frame_idx", F.col("A3_shoulder_midpoint.valid").alias("a3_valid"), F.col("A3_shoulder_midpoint.p.x").alias("a3_x"), F.col("A5_upper_centroid.valid").alias("a5_valid"), F.col("A5_upper_centroid.p.y").alias("a5_y"), F.col("A6_full_centroid.p.z").alias("a6_z"), F.col("A7_bbox_center.valid").alias("a7_valid"), F.col("A7_bbox_center.p.x").alias("a7_x")))


_PARENTS = ", ".join(map(str, L.H36M_PARENTS))


@query(f"""WITH {_JT}, b AS (SELECT c.seq, c.j, sqrt((c.x - p.x) ** 2 + (c.y - p.y) ** 2 + (c.z - p.z) ** 2) AS l FROM jt c JOIN jt p ON c.seq = p.seq AND c.frame_idx = p.frame_idx AND p.j = ([{_PARENTS}])[c.j + 1])
SELECT seq, j AS joint, round(avg(l), 6) AS mean, round(stddev_pop(l) / avg(l), 6) AS variation FROM b GROUP BY 1, 2""")
def bone_length_variation(spark, sf):
    j = S.skeletons(spark, sf).select("seq", F.posexplode(P.bone_lengths("joints")).alias("joint", "l")).filter("joint > 0")
    mean, variation = P.length_variation("l")
    return S.rounded(j.groupBy("seq", "joint").agg(mean.alias("mean"), variation.alias("variation")))


@query(f"WITH {_JT} SELECT seq, CASE WHEN bool_and(z BETWEEN 0 AND 1) THEN '2d_xy_with_visibility_in_last_dim' ELSE '3d_xyz' END AS representation FROM (SELECT seq, CASE WHEN seq % 2 = 0 THEN abs(z) ELSE z END AS z FROM jt) GROUP BY seq")
def classify_representation(spark, sf):
    j = S.skeletons(spark, sf).withColumn("joints", F.when(F.col("seq") % 2 == 0, F.transform("joints", lambda p: P.xyz(p["x"], p["y"], F.abs(p["z"])))).otherwise(F.col("joints")))
    return j.groupBy("seq").agg(P.representation("joints").alias("representation"))


@query(f"""WITH {S.SENSORS}, n AS (SELECT *, sqrt(quat_w ** 2 + quat_x ** 2 + quat_y ** 2 + quat_z ** 2) AS s FROM im), u AS (SELECT seq, frame_idx, quat_w / s AS w, quat_x / s AS x, quat_y / s AS y, quat_z / s AS z FROM n)
SELECT seq, frame_idx, round(abs(w), 5) AS w, round(x * sign(w), 5) + 0.0 AS x, round(y * sign(w), 5) + 0.0 AS y, round(z * sign(w), 5) + 0.0 AS z FROM u""")
def quaternion_round_trip(spark, sf):
    """Quaternion to matrix and back, with w made positive."""
    q = S.sensors(spark, sf).select("seq", "frame_idx", Q.normalize(F.array(*L.QUAT)).alias("q"))
    back = q.withColumn("b", Q.from_matrix(Q.to_matrix("q")))
    sign = F.when(F.get("b", F.lit(0)) < 0, -1.0).otherwise(1.0)
    return S.rounded(back.select("seq", "frame_idx", *(((F.get("b", F.lit(i)) * sign)).alias(n) for i, n in enumerate("wxyz"))), 5)


@query(f"""WITH {S.RECORDINGS} SELECT seq, frame_idx, round(e[1], 6) + 0.0 AS "first", round(e[64], 6) + 0.0 AS "last", round(e[32] + (e[33] - e[32]) * 0.5, 6) + 0.0 AS middle FROM r""")
def resample_window(spark, sf):
    r = S.recordings(spark, sf).withColumn("a", V.resample("e", 127))
    return S.rounded(r.select("seq", "frame_idx", F.get("a", F.lit(0)).alias("first"), F.get("a", F.lit(126)).alias("last"), F.get("a", F.lit(63)).alias("middle")))


def _scores(spark, sf):
    """Sensors and tracks of sessions: an event's user is a session, its window is the order of events, three tracks by three sensors."""
    f = S.frames(spark, sf)
    cells = f.withColumn("imu_idx", F.explode(F.expr("sequence(0L, 2L)"))).withColumn("t", F.explode(F.expr("sequence(0L, 2L)")))
    score = (F.floor(F.col("x") * 100).cast("long") * (F.col("imu_idx") + 2) * (F.col("t") + 3) + F.col("frame_idx") * 7) % 97 / 97.0
    return cells.select(F.col("seq").alias("session"), F.col("frame_idx").alias("window_idx"), "imu_idx", F.concat(F.lit("t"), F.col("t").cast("string")).alias("track"), score.alias("score")).filter("(window_idx + cast(substring(track, 2) as int)) % 4 <> 0")


def _score_cells(spark, sf):
    """The same scores as arrays, a row for each window."""
    f = S.frames(spark, sf).withColumn("_c", F.expr("filter(sequence(0L, 8L), c -> (frame_idx + c % 3) % 4 <> 0)"))
    imu, t = lambda c: F.floor(c / 3), lambda c: c % 3
    score = lambda c: (F.floor(F.col("x") * 100).cast("long") * (imu(c) + 2) * (t(c) + 3) + F.col("frame_idx") * 7) % 97 / 97.0
    each = {"imu_idx": imu, "track": lambda c: F.concat(F.lit("t"), t(c).cast("string")), "score": score}
    return f.select(F.col("seq").alias("session"), F.col("frame_idx").alias("window_idx"), *(F.transform("_c", g).alias(name) for name, g in each.items()))


_SC = f"""{S.FRAMES}, sc AS (SELECT seq AS session, frame_idx AS window_idx, i AS imu_idx, 't' || t AS track, ((floor(x * 100)::BIGINT * (i + 2) * (t + 3) + frame_idx * 7) % 97) / 97.0::DOUBLE AS score FROM f, range(3) a(i), range(3) b(t) WHERE (frame_idx + t) % 4 <> 0),
cf AS (SELECT *, list_sort(list(score) OVER (PARTITION BY session, window_idx, track), 'DESC') AS l FROM sc), mg AS (SELECT *, l[1] - l[2] AS confidence, row_number() OVER (PARTITION BY session, track, imu_idx ORDER BY window_idx) AS k FROM cf)"""


@query(f"WITH {_SC} SELECT session, window_idx, imu_idx, track, round(confidence, 6) + 0.0 AS confidence, round(sum(CASE WHEN k = 1 OR confidence > 0.2 THEN score ELSE 0 END) OVER (PARTITION BY session, track, imu_idx ORDER BY window_idx), 6) + 0.0 AS accumulated FROM mg")
def history_scores(spark, sf):
    out = history.history_scores(_scores(spark, sf), ["session"], "window_idx", threshold=0.2)
    return S.rounded(out.select("session", "window_idx", "imu_idx", "track", "confidence", "accumulated"))


_DECAY = f"""WITH RECURSIVE {_SC}, h(session, track, imu_idx, k, a) AS (SELECT session, track, imu_idx, k, score FROM mg WHERE k = 1 UNION ALL
SELECT h.session, h.track, h.imu_idx, m.k, CASE WHEN m.confidence > 0.2 THEN 0.7 * h.a + m.score ELSE h.a END FROM h JOIN mg m ON m.session = h.session AND m.track = h.track AND m.imu_idx = h.imu_idx AND m.k = h.k + 1)
SELECT session, window_idx, imu_idx, track, round(a, 6) + 0.0 AS accumulated FROM h JOIN mg USING (session, track, imu_idx, k)"""


@query(_DECAY)
def history_scores_decay(spark, sf):
    out = history.history_scores(_scores(spark, sf), ["session"], "window_idx", decay=0.3, threshold=0.2)
    return S.rounded(out.select("session", "window_idx", "imu_idx", "track", "accumulated"))


@query(_DECAY)
def history_scores_decay_window(spark, sf):
    out = history.history_scores(_scores(spark, sf), ["session"], "window_idx", decay=0.3, threshold=0.2)
    return S.rounded(out.select("session", "window_idx", "imu_idx", "track", "accumulated"))


def _best3_sql(name: str, scores: str, by: str) -> str:
    """SQL: the best of the six assignments of three rows by `by`, rounded sums, the first of equals; up to three columns count."""
    return f"""{name}_v AS (SELECT {by}, p, round(coalesce(sum(s), 0), 9) AS v FROM (SELECT DISTINCT {by} FROM {scores}) k CROSS JOIN (VALUES ([0, 1, 2]), ([0, 2, 1]), ([1, 0, 2]), ([1, 2, 0]), ([2, 0, 1]), ([2, 1, 0])) q(p) LEFT JOIN {scores} USING ({by}) WHERE p[r + 1] = c GROUP BY {by}, p),
{name} AS (SELECT {by}, p FROM {name}_v QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY v DESC, p) = 1)"""


@query(f"""WITH {_SC}, h AS (SELECT *, sum(CASE WHEN k = 1 OR confidence > 0.2 THEN score ELSE 0 END) OVER (PARTITION BY session, track, imu_idx ORDER BY window_idx) AS a, dense_rank() OVER (PARTITION BY session, window_idx ORDER BY track) - 1 AS c FROM mg),
now_s AS (SELECT session, window_idx, imu_idx AS r, c, score AS s FROM h), past_s AS (SELECT session, window_idx, imu_idx AS r, c, a AS s FROM h), {_best3_sql("nw", "now_s", "session, window_idx")}, {_best3_sql("pt", "past_s", "session, window_idx")}
SELECT nw.session, nw.window_idx, i AS imu_idx, a.track AS track_now, b.track AS track_history FROM nw JOIN pt USING (session, window_idx) CROSS JOIN range(3) t(i)
LEFT JOIN h a ON a.session = nw.session AND a.window_idx = nw.window_idx AND a.imu_idx = i AND a.c = nw.p[i + 1] LEFT JOIN h b ON b.session = nw.session AND b.window_idx = nw.window_idx AND b.imu_idx = i AND b.c = pt.p[i + 1]""")
def session_decisions(spark, sf):
    return history.session_decisions(_score_cells(spark, sf), ["session"], "window_idx", threshold=0.2)


def _windows3(spark, sf):
    """Square scores of three sensors and three tracks: every cell is there."""
    f = S.frames(spark, sf)
    cells = f.withColumn("row", F.explode(F.expr("sequence(0L, 2L)"))).withColumn("col", F.explode(F.expr("sequence(0L, 2L)")))
    score = (F.floor(F.col("x") * 100).cast("long") * (F.col("row") + 2) * (F.col("col") + 3) + F.col("frame_idx") * 7) % 97 / 97.0
    return cells.select(F.col("seq").alias("session"), F.col("frame_idx").alias("centre"), "row", "col", score.alias("score"))


_W3 = f"""{S.FRAMES}, w3 AS (SELECT seq AS session, frame_idx AS centre, i AS "row", t AS col, ((floor(x * 100)::BIGINT * (i + 2) * (t + 3) + frame_idx * 7) % 97) / 97.0::DOUBLE AS score FROM f, range(3) a(i), range(3) b(t)),
perms AS (SELECT * FROM (VALUES (0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)) p(a, b, c))"""


@query(f"""WITH {_W3}, m AS (SELECT session, "row", col, avg(score) AS s FROM w3 GROUP BY 1, 2, 3), v AS (SELECT session, a, b, c, round(sum(CASE WHEN ("row" = 0 AND col = a) OR ("row" = 1 AND col = b) OR ("row" = 2 AND col = c) THEN s END), 9) AS v FROM m, perms GROUP BY 1, 2, 3, 4),
t AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY session ORDER BY v DESC, a, b, c) = 1) SELECT session, unnest([0, 1, 2])::BIGINT AS "row", unnest([a, b, c])::BIGINT AS col FROM t""")
def offline_all_windows(spark, sf):
    return history.offline_policy(_windows3(spark, sf), ["session"], "centre", "global_all_windows")


@query(f"""WITH {_W3}, m AS (SELECT session, centre // 8 AS segment, "row", col, avg(score) AS s, count(*) AS n FROM w3 GROUP BY 1, 2, 3, 4 HAVING count(*) >= 3),
v AS (SELECT session, segment, a, b, c, sum(CASE WHEN ("row" = 0 AND col = a) OR ("row" = 1 AND col = b) OR ("row" = 2 AND col = c) THEN s END) AS v FROM m, perms GROUP BY 1, 2, 3, 4, 5),
g AS (SELECT session, segment, max(v) FILTER (k = 1) - max(v) FILTER (k = 2) AS gap FROM (SELECT *, row_number() OVER (PARTITION BY session, segment ORDER BY v DESC) AS k FROM v) GROUP BY 1, 2)
SELECT session, segment, round(gap / 3, 6) + 0.0 AS gap FROM g""")
def segment_gaps(spark, sf):
    e = history.segment_evidence(_windows3(spark, sf), ["session"], "centre", 8, 3).filter("segment >= 0")
    return S.rounded(e.select("session", "segment", "gap").distinct())


@query(f"""WITH {_W3}, sz AS (SELECT session, centre // 8 AS segment, count(DISTINCT centre) AS n FROM w3 GROUP BY 1, 2), k AS (SELECT w3.*, segment FROM w3 JOIN sz ON sz.session = w3.session AND sz.segment = centre // 8 AND n >= 3),
m AS (SELECT session, segment, "row", col, avg(score) AS s FROM k GROUP BY 1, 2, 3, 4), wn AS (SELECT session, segment, "row", col AS winner FROM m QUALIFY row_number() OVER (PARTITION BY session, segment, "row" ORDER BY round(s, 12) DESC, col) = 1),
ld AS (SELECT k.session, k.segment, k."row", centre, max(score) FILTER (col = winner) - max(score) FILTER (col <> winner) AS lead FROM k JOIN wn ON wn.session = k.session AND wn.segment = k.segment AND wn."row" = k."row" GROUP BY 1, 2, 3, 4)
SELECT session, segment, "row", round(median(lead) - mad(lead), 6) + 0.0 AS margin, round(avg((lead > 0)::INT), 6) AS consistency FROM ld GROUP BY 1, 2, 3""")
def segment_evidence(spark, sf):
    e = history.segment_evidence(_windows3(spark, sf), ["session"], "centre", 8, 3).filter("segment >= 0")
    return S.rounded(e.select("session", "segment", "row", "margin", "consistency").distinct())


_ROWS3 = lambda name: f'SELECT session, unnest([0, 1, 2])::BIGINT AS "row", unnest({name}.p)::BIGINT AS col FROM {name}'
_SEGMENTS = f"""{_W3}, sz AS (SELECT session, centre // 8 AS segment, count(DISTINCT centre) AS n FROM w3 GROUP BY 1, 2), k AS (SELECT w3.*, segment FROM w3 JOIN sz ON sz.session = w3.session AND sz.segment = centre // 8 AND n >= 3),
m AS (SELECT session, segment, "row", col, avg(score) AS s FROM k GROUP BY 1, 2, 3, 4)"""


@query(f"""WITH {_W3}, each AS (SELECT session, centre, "row" AS r, col AS c, score AS s FROM w3), {_best3_sql("won", "each", "session, centre")},
votes AS (SELECT session, r, c, count(*)::DOUBLE AS s FROM (SELECT session, unnest([0, 1, 2]) AS r, unnest(p) AS c FROM won) GROUP BY 1, 2, 3), {_best3_sql("fin", "votes", "session")} {_ROWS3("fin")}""")
def offline_votes(spark, sf):
    return history.offline_policy(_windows3(spark, sf), ["session"], "centre", "window_hungarian_all")


@query(f"""WITH {_SEGMENTS}, e AS (SELECT session, segment, "row" AS r, col AS c, s FROM m), {_best3_sql("own", "e", "session, segment")},
g AS (SELECT session, segment, max(v) FILTER (k = 1) - max(v) FILTER (k = 2) AS gap FROM (SELECT *, row_number() OVER (PARTITION BY session, segment ORDER BY v DESC) AS k FROM own_v) GROUP BY 1, 2),
b AS (SELECT session, segment FROM g QUALIFY row_number() OVER (PARTITION BY session ORDER BY round(gap / 3, 7) DESC, segment) = 1), fin AS (SELECT session, p FROM own JOIN b USING (session, segment)) {_ROWS3("fin")}""")
def offline_best_segment(spark, sf):
    return history.offline_policy(_windows3(spark, sf), ["session"], "centre", "global_best_segment", 8, 3)


@query(f"""WITH {_SEGMENTS}, wn AS (SELECT session, segment, "row", col AS winner FROM m QUALIFY row_number() OVER (PARTITION BY session, segment, "row" ORDER BY round(s, 12) DESC, col) = 1),
ld AS (SELECT k.session, k.segment, k."row", centre, max(score) FILTER (col = winner) - max(score) FILTER (col <> winner) AS lead FROM k JOIN wn ON wn.session = k.session AND wn.segment = k.segment AND wn."row" = k."row" GROUP BY 1, 2, 3, 4),
mr AS (SELECT session, segment, "row", median(lead) - mad(lead) AS margin FROM ld GROUP BY 1, 2, 3), ch AS (SELECT *, row_number() OVER (PARTITION BY session, "row" ORDER BY margin DESC, segment) AS n, max(margin) OVER (PARTITION BY session, "row") AS top FROM mr),
mx AS (SELECT m.session, m."row" AS r, m.col AS c, sum(exp(margin - top) * s) / sum(exp(margin - top)) AS s FROM m JOIN ch ON ch.session = m.session AND ch.segment = m.segment AND ch."row" = m."row" AND n <= 3 GROUP BY 1, 2, 3), {_best3_sql("fin", "mx", "session")} {_ROWS3("fin")}""")
def offline_topk_segments(spark, sf):
    return history.offline_policy(_windows3(spark, sf), ["session"], "centre", "local_topk_segment", 8, 3)


def _detections(spark, sf):
    f = S.frames(spark, sf)
    return f.select((F.col("seq") % 20).alias("video"), (F.col("seq") * 10 + F.floor(F.col("frame_idx") / 25)).alias("track_id"), (F.floor(F.col("seq") / 20) * 60 + F.col("frame_idx") + 3 * F.floor(F.col("frame_idx") / 25)).alias("frame_id"), F.col("x").alias("cx"), F.col("y").alias("cy"), (F.col("x") + 10).alias("w"), (F.col("y") + 20).alias("h"))


_DET = f"{S.FRAMES}, dt AS (SELECT seq % 20 AS video, seq * 10 + frame_idx // 25 AS track_id, (seq // 20) * 60 + frame_idx + 3 * (frame_idx // 25) AS frame_id, x AS cx, y AS cy, x + 10 AS w, y + 20 AS h FROM f)"
_TS = f"""{_DET}, rk AS (SELECT *, row_number() OVER (PARTITION BY video, track_id ORDER BY frame_id) AS a, row_number() OVER (PARTITION BY video, track_id ORDER BY frame_id DESC) AS z FROM dt),
ts AS (SELECT video, track_id, min(frame_id) AS "start", max(frame_id) AS "end", count(*) AS length, avg(cx) FILTER (a <= 5) AS head_cx, avg(cy) FILTER (a <= 5) AS head_cy, avg(w) FILTER (a <= 5) AS head_w, avg(h) FILTER (a <= 5) AS head_h,
  avg(cx) FILTER (z <= 5) AS tail_cx, avg(cy) FILTER (z <= 5) AS tail_cy, avg(w) FILTER (z <= 5) AS tail_w, avg(h) FILTER (z <= 5) AS tail_h,
  CASE WHEN max(frame_id) FILTER (z <= 5) > min(frame_id) FILTER (z <= 5) THEN (arg_max(cx, frame_id) FILTER (z <= 5) - arg_min(cx, frame_id) FILTER (z <= 5)) / (max(frame_id) FILTER (z <= 5) - min(frame_id) FILTER (z <= 5)) ELSE 0 END AS tail_vx,
  CASE WHEN max(frame_id) FILTER (z <= 5) > min(frame_id) FILTER (z <= 5) THEN (arg_max(cy, frame_id) FILTER (z <= 5) - arg_min(cy, frame_id) FILTER (z <= 5)) / (max(frame_id) FILTER (z <= 5) - min(frame_id) FILTER (z <= 5)) ELSE 0 END AS tail_vy FROM rk GROUP BY 1, 2)"""
_CAND = f"""{_TS}, cd AS (SELECT s.video, s.track_id AS src, t.track_id AS dst, t."start" - s."end" AS gap, t.head_cx - s.tail_cx AS dx, t.head_cy - s.tail_cy AS dy, sqrt(((s.tail_w + t.head_w) / 2) ** 2 + ((s.tail_h + t.head_h) / 2) ** 2) + 1e-6 AS size,
  sqrt(ln((t.head_w + 1e-6) / (s.tail_w + 1e-6)) ** 2 + ln((t.head_h + 1e-6) / (s.tail_h + 1e-6)) ** 2) AS size_diff, s.tail_vx, s.tail_vy FROM ts s JOIN ts t ON s.video = t.video AND s.track_id <> t.track_id AND t."start" - s."end" BETWEEN 1 AND 30),
ce AS (SELECT video, src, dst, gap, sqrt(dx * dx + dy * dy) / size AS norm_dist, size_diff, sqrt((dx - tail_vx * gap / 30) ** 2 + (dy - tail_vy * gap / 30) ** 2) / size AS vel_residual, ln(1.0 + gap) AS gap_penalty FROM cd),
cs AS (SELECT *, norm_dist + size_diff + vel_residual + 0.1 * gap_penalty AS score FROM ce)"""


@query(f'WITH {_TS} SELECT video, track_id, "start", "end", length, round(head_cx, 6) AS head_cx, round(tail_h, 6) AS tail_h, round(tail_vx, 6) + 0.0 AS tail_vx, round(tail_vy, 6) + 0.0 AS tail_vy FROM ts')
def tracklet_stats(spark, sf):
    return S.rounded(linking.tracklet_stats(_detections(spark, sf), ["video"]).select("video", "track_id", "start", "end", "length", "head_cx", "tail_h", "tail_vx", "tail_vy"))


@query(f"WITH {_CAND} SELECT video, src, dst, gap, round(norm_dist, 6) AS norm_dist, round(size_diff, 6) AS size_diff, round(vel_residual, 6) AS vel_residual, round(score, 6) AS score FROM cs")
def tracklet_candidates(spark, sf):
    c = linking.tracklet_candidates(linking.tracklet_stats(_detections(spark, sf), ["video"]), ["video"], 30)
    return S.rounded(c.drop("gap_penalty"))


@query(f"""WITH RECURSIVE {_CAND}, ed AS (SELECT video, src AS a, dst AS b FROM cs WHERE score <= 0.9 UNION SELECT video, dst, src FROM cs WHERE score <= 0.9),
rc(video, track_id, m) AS (SELECT video, track_id, track_id FROM ts UNION SELECT ed.video, ed.b, rc.m FROM rc JOIN ed ON ed.video = rc.video AND ed.a = rc.track_id), lb AS (SELECT video, track_id, min(m) AS label FROM rc GROUP BY 1, 2)
SELECT video, track_id, dense_rank() OVER (PARTITION BY video ORDER BY label) - 1 AS new_id FROM lb""")
def link_tracklets(spark, sf):
    st = linking.tracklet_stats(_detections(spark, sf), ["video"])
    links = linking.accepted_links(linking.tracklet_candidates(st, ["video"], 30), 0.9, 1e9, 1e9)
    return S.rounded(linking.link_tracklets(st, links, ["video"]))


@query()
def link_known_people(spark, sf):
    st = linking.tracklet_stats(_detections(spark, sf), ["video"])
    links = linking.accepted_links(linking.tracklet_candidates(st, ["video"], 30), 0.9, 1e9, 1e9)
    return S.rounded(linking.link_tracklets(st, links, ["video"], 8))


@query()
def merge_track_series(spark, sf):
    det = _detections(spark, sf)
    st = linking.tracklet_stats(det, ["video"])
    links = linking.accepted_links(linking.tracklet_candidates(st, ["video"], 30), 0.9, 1e9, 1e9)
    return S.rounded(linking.merge_track_series(det, linking.link_tracklets(st, links, ["video"]), ["video"], ["cx", "cy"], True))


@query(f"WITH {S.SENSORS}, n AS (SELECT *, sqrt(quat_w ** 2 + quat_x ** 2 + quat_y ** 2 + quat_z ** 2) AS s FROM im) SELECT seq, count(*) AS frames, count(*) FILTER (s NOT BETWEEN 0.2 AND 0.3) AS invalid, count(*) FILTER (s <= 1e-12) AS zero, round(avg((s NOT BETWEEN 0.2 AND 0.3)::INT), 6) AS invalid_share FROM n GROUP BY seq")
def quaternion_quality(spark, sf):
    return S.rounded(quality.quaternion_quality(S.sensors(spark, sf), ["seq"], list(L.QUAT), 0.2, 0.3))


@query(f"WITH {_JT}, c AS (SELECT j, unnest([0, 1, 2]) AS dim, unnest([x, y, z]) AS v FROM jt) SELECT j AS joint, dim::BIGINT AS dim, count(*) AS n, round(max(abs(v)), 6) AS largest FROM c WHERE abs(v) > 0.25 GROUP BY 1, 2")
def extreme_coordinates(spark, sf):
    return S.rounded(quality.extreme_coordinates(S.skeletons(spark, sf), "seq", ["frame_idx"], "joints", 0.25)[0])


@query("""WITH w AS (SELECT *, ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS bad FROM events) SELECT 'timestamps' AS rule, user_id::VARCHAR AS key, count(*)::VARCHAR AS detail FROM w WHERE bad GROUP BY user_id""")
def check_timestamps(spark, sf):
    e = S.table(spark, sf, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    return quality.check_timestamps(e, ["user_id"], ["event_id"], "t")


@query(f"""WITH {S.SEQUENCES}, w AS (SELECT seq, unnest(range(0, n_frames - 23, 16)) AS s, CASE WHEN seq % 3 = 0 THEN 'test' WHEN seq % 3 = 1 THEN 'val' ELSE 'train' END AS split FROM q WHERE n_frames >= 24),
d AS (SELECT split, s - lag(s) OVER (PARTITION BY split, seq ORDER BY s) AS d FROM w) SELECT split, 16::BIGINT AS stride FROM d WHERE d > 0 GROUP BY split""")
def window_stride(spark, sf):
    from kinelink.operators.windows import fixed_windows

    w = fixed_windows(S.sequences(spark, sf), 24, 16).withColumn("split", F.when(F.col("seq") % 3 == 0, "test").when(F.col("seq") % 3 == 1, "val").otherwise("train"))
    return quality.stride_of(w, ["seq"])


def _prepared(spark, sf):
    """A window index with flaws: orders as windows, customers as sequences."""
    o = S.table(spark, sf, "orders")
    start = (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1) * 16
    return o.select(F.when(F.col("o_orderkey") % 3 == 0, "test").otherwise("train").alias("split"), F.concat(F.lit("f"), F.col("o_custkey").cast("string")).alias("npz_path"), F.col("o_custkey").cast("string").alias("source_sequence"), (F.col("o_custkey") % 50).cast("string").alias("session"), F.lit(0).alias("person_idx"), F.lit(0).alias("imu_idx"), start.cast("long").alias("window_start"), (start + 24).cast("long").alias("window_end"), F.lit(24).alias("window_len"), F.concat(F.lit("g"), F.floor(F.col("o_orderkey") / 200).cast("string")).alias("candidate_group_id"))


_PREP = """o AS (SELECT * FROM orders), w AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'test' ELSE 'train' END AS split, 'f' || o_custkey AS npz_path, o_custkey::VARCHAR AS source_sequence, (o_custkey % 50)::VARCHAR AS session, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) * 16 AS window_start, 'g' || (o_orderkey // 200) AS g FROM o)"""


@query(f"""WITH {_PREP}, fl AS (SELECT 'f' || c_custkey AS npz_path FROM customer WHERE c_custkey % 40 <> 0),
sd AS (SELECT split, list(DISTINCT d) AS ds FROM (SELECT split, window_start - lag(window_start) OVER (PARTITION BY split, npz_path ORDER BY window_start) AS d FROM w) WHERE d > 0 GROUP BY split)
SELECT 'empty_split' AS rule, 'val' AS key, '' AS detail
UNION ALL SELECT 'identity_leak', session, 'test/train' FROM w GROUP BY session HAVING count(DISTINCT split) > 1
UNION ALL SELECT 'sequence_leak', source_sequence, 'test/train' FROM w GROUP BY source_sequence HAVING count(DISTINCT split) > 1
UNION ALL SELECT DISTINCT 'missing_file', npz_path, '' FROM w WHERE npz_path NOT IN (SELECT npz_path FROM fl)
UNION ALL SELECT 'singleton_group', g, '' FROM w WHERE split = 'test' GROUP BY g HAVING count(*) < 2""")
def validate_prepared(spark, sf):
    files = S.table(spark, sf, "customer").filter("c_custkey % 40 <> 0").select(F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("npz_path"))
    return quality.validate_prepared(_prepared(spark, sf), files, "session", 24, 16)


@query(f"""WITH {S.SENSORS}, u AS (SELECT * FROM im), l AS (SELECT unnest(['acc_x', 'acc_y', 'acc_z']) AS channel, unnest([acc_x, acc_y, acc_z]) AS v FROM u) SELECT channel, count(*) AS n, round(avg(v), 6) + 0.0 AS mean, round(sqrt(greatest(avg(v * v) - avg(v) ** 2, 1e-12)), 6) AS std FROM l GROUP BY channel""")
def imu_channel_stats(spark, sf):
    im = S.sensors(spark, sf)
    w = im.select("seq", F.col("frame_idx").alias("window_start"))
    return S.rounded(stats.imu_channel_stats(w, im, ["seq"], list(L.ACC)))


@query("SELECT l_returnflag AS flag, round(quantile_cont(l_quantity, 0.05), 6) AS q05_l_quantity, round(quantile_cont(l_quantity, 0.25), 6) AS q25_l_quantity, round(quantile_cont(l_quantity, 0.5), 6) AS q50_l_quantity, round(quantile_cont(l_quantity, 0.75), 6) AS q75_l_quantity, round(quantile_cont(l_quantity, 0.95), 6) AS q95_l_quantity, count(l_quantity) AS n_l_quantity FROM lineitem GROUP BY 1")
def quantile_summary(spark, sf):
    return S.rounded(stats.quantile_summary(S.table(spark, sf, "lineitem"), ["l_returnflag"], ["l_quantity"]).withColumnRenamed("l_returnflag", "flag"))


@query("WITH q AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 1 / 3) AS q1, quantile_cont(o_totalprice, 2 / 3) AS q2 FROM orders GROUP BY 1) SELECT o_orderkey, CASE WHEN o_totalprice <= q1 THEN 'low' WHEN o_totalprice <= q2 THEN 'mid' ELSE 'high' END AS stratum FROM orders JOIN q USING (o_orderpriority)")
def tertile_strata(spark, sf):
    return stats.tertile_strata(S.table(spark, sf, "orders"), "o_totalprice", ["o_orderpriority"]).select("o_orderkey", "stratum")


@query("WITH m AS (SELECT o_orderstatus, o_custkey, avg(o_totalprice) AS g FROM orders GROUP BY 1, 2), q AS (SELECT o_orderstatus, quantile_cont(g, 0.75) AS t FROM m GROUP BY 1) SELECT o_orderkey, CASE WHEN g >= t - 1e-7 THEN 'high' ELSE 'low' END AS stratum FROM orders JOIN m USING (o_orderstatus, o_custkey) JOIN q USING (o_orderstatus)")
def turning_strata(spark, sf):
    return stats.turning_strata(S.table(spark, sf, "orders"), ["o_custkey"], "o_totalprice", "o_orderstatus").select("o_orderkey", "stratum")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS total, round(avg((o_totalprice > 200000)::INT), 6) AS hit_acc, grouping(o_orderpriority, o_orderstatus)::BIGINT AS level FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), (o_orderstatus, o_orderpriority), ())")
def stratified_accuracy(spark, sf):
    o = S.table(spark, sf, "orders").withColumn("hit", F.col("o_totalprice") > 200000)
    return S.rounded(stats.stratified_accuracy(o, [["o_orderstatus"], ["o_orderpriority"], ["o_orderpriority", "o_orderstatus"], []], ["hit"]))


_VIS = f"""{S.FRAMES}, vs AS (SELECT seq % 10 AS session, seq // 10 AS person, frame_idx, ok FROM f)"""


def _visibility(spark, sf):
    return S.frames(spark, sf).select((F.col("seq") % 10).alias("session"), F.floor(F.col("seq") / 10).alias("person"), "frame_idx", "ok")


@query(f"""WITH {_VIS}, pf AS (SELECT session, frame_idx, bool_and(ok) AS al FROM vs GROUP BY 1, 2), c AS (SELECT session, count(*) AS frames, avg(al::INT) AS all_visible_share FROM pf GROUP BY 1), cv AS (SELECT session, avg(ok::INT) AS coverage FROM vs GROUP BY 1),
i AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY session, person, ok ORDER BY frame_idx) AS g FROM vs), rn AS (SELECT session, person, count(*) AS length FROM i WHERE ok GROUP BY session, person, g),
rs AS (SELECT session, count(*) AS runs, avg(length) AS run_mean, median(length) AS run_q50 FROM rn GROUP BY 1), fr AS (SELECT p.session, avg(greatest(coalesce(n, 0) - 1, 0)) AS fragmentation_mean, count(*) AS people FROM (SELECT DISTINCT session, person FROM vs) p LEFT JOIN (SELECT session, person, count(*) AS n FROM rn GROUP BY 1, 2) k ON k.session = p.session AND k.person = p.person GROUP BY 1)
SELECT session, frames, round(coverage, 6) AS coverage, round(all_visible_share, 6) AS all_visible_share, round(fragmentation_mean, 6) AS fragmentation_mean, people, runs, round(run_mean, 6) AS run_mean, round(run_q50, 6) AS run_q50 FROM c JOIN cv USING (session) JOIN rs USING (session) JOIN fr USING (session)""")
def tracking_quality(spark, sf):
    return S.rounded(stats.tracking_quality(_visibility(spark, sf), ["session"], "person", "frame_idx", "ok"))


@query(f"WITH {_VIS}, g AS (SELECT session, frame_idx, count(*) FILTER (ok) AS group_size FROM vs GROUP BY 1, 2) SELECT session, group_size, count(*) AS frames FROM g GROUP BY 1, 2")
def group_size_histogram(spark, sf):
    return stats.group_size_histogram(_visibility(spark, sf), ["session"], "frame_idx", "ok")


@query(f"""WITH {S.FRAMES}, m AS (SELECT seq % 10 AS session, frame_idx, (seq + frame_idx // 3) % 4 AS track, seq AS person FROM f WHERE ok),
a AS (SELECT session, coalesce(person <> lag(person) OVER (PARTITION BY session, track ORDER BY frame_idx, person), false) AS c FROM m), b AS (SELECT session, coalesce(track <> lag(track) OVER (PARTITION BY session, person ORDER BY frame_idx, track), false) AS c FROM m)
SELECT session, (SELECT count(*) FROM m WHERE m.session = s.session) AS matched, (SELECT sum(c::INT)::BIGINT FROM a WHERE a.session = s.session) AS id_to_person_changes, (SELECT sum(c::INT)::BIGINT FROM b WHERE b.session = s.session) AS person_to_id_changes FROM (SELECT DISTINCT session FROM m) s""")
def detector_id_audit(spark, sf):
    m = S.frames(spark, sf).filter("ok").select((F.col("seq") % 10).alias("session"), "frame_idx", ((F.col("seq") + F.floor(F.col("frame_idx") / 3)) % 4).alias("track"), F.col("seq").alias("person"))
    return stats.detector_id_audit(m, ["session"], "frame_idx", "track", "person")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(avg(o_totalprice), 3) AS mean, round(coalesce(stddev_samp(o_totalprice), 0), 3) AS std FROM orders GROUP BY 1, 2")
def seed_summary(spark, sf):
    return S.rounded(stats.seed_summary(S.table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"], "o_totalprice"), 3)


@query("WITH s AS (SELECT c_mktsegment, count(*) AS n, avg(c_acctbal) AS mean, stddev_pop(c_acctbal) AS std FROM customer GROUP BY 1) SELECT c_mktsegment, n, round(mean, 4) AS mean, round(std, 4) AS std, row_number() OVER (ORDER BY mean DESC, c_mktsegment) AS rank FROM s")
def leaderboard(spark, sf):
    return S.rounded(stats.leaderboard(S.table(spark, sf, "customer"), ["c_mktsegment"], "c_acctbal"), 4)


_REC = "rc AS (SELECT o_orderstatus AS condition, o_orderpriority AS source, o_custkey % 3 AS seed, o_custkey % 20 AS session, count(*) FILTER (o_totalprice > 250000) AS correct, count(*) AS total FROM orders GROUP BY 1, 2, 3, 4)"


@query(f"""WITH {_REC}, ps AS (SELECT condition, source, seed, avg(correct / total) AS macro, sum(correct) / sum(total) AS micro, stddev_samp(correct / total) AS spread FROM rc GROUP BY 1, 2, 3)
SELECT condition, source, count(*) AS seeds, round(avg(macro), 6) AS macro_mean, round(stddev_samp(macro), 6) AS macro_std, round(avg(micro), 6) AS micro_mean, round(stddev_samp(micro), 6) AS micro_std, round(avg(spread), 6) AS spread_mean, round(stddev_samp(spread), 6) AS spread_std FROM ps GROUP BY 1, 2""")
def aggregate_runs(spark, sf):
    o = S.table(spark, sf, "orders")
    rec = o.groupBy(F.col("o_orderstatus").alias("condition"), F.col("o_orderpriority").alias("source"), (F.col("o_custkey") % 3).alias("seed"), (F.col("o_custkey") % 20).alias("session")).agg(F.count_if(F.col("o_totalprice") > 250000).alias("correct"), F.count(F.lit(1)).alias("total"))
    return S.rounded(stats.aggregate_runs(rec))


@query()
def paired_bootstrap(spark, sf):
    o = S.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg((F.avg(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice"))) - F.avg(F.when(F.col("o_orderkey") % 2 == 1, F.col("o_totalprice")))).alias("d")).filter("d is not null")
    return S.rounded(stats.bootstrap_interval(o, ["k"], "d", 2000), 3)


@query("WITH v AS (SELECT o_orderpriority, o_orderstatus, avg(o_totalprice) / 1e5 AS a FROM orders GROUP BY 1, 2) SELECT b.o_orderpriority, round(b.a, 6) AS base, round(v.a, 6) AS variant, round(100 * (v.a - b.a), 5) + 0.0 AS points FROM v b JOIN v ON b.o_orderpriority = v.o_orderpriority AND b.o_orderstatus = 'F' AND v.o_orderstatus = 'O'")
def compare_results(spark, sf):
    v = S.table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg((F.avg("o_totalprice") / 1e5).alias("a"))
    out = stats.compare_results(v.filter("o_orderstatus = 'F'"), v.filter("o_orderstatus = 'O'"), ["o_orderpriority"], "a")
    return S.rounded(out.withColumn("points", F.round("points", 5)))


@query(f"""WITH {_PREP}, st AS (SELECT split, gcd(min(d), max(d)) AS stride FROM (SELECT split, window_start - lag(window_start) OVER (PARTITION BY split, source_sequence ORDER BY window_start) AS d FROM w) WHERE d > 0 GROUP BY split), lk AS (SELECT count(*) AS n FROM (SELECT session FROM w GROUP BY session HAVING count(DISTINCT split) > 1))
SELECT w.split, count(*) AS rows, count(DISTINCT session) AS identities, count(DISTINCT source_sequence) AS sequences, 24::BIGINT AS len_min, any_value(st.stride)::BIGINT AS stride, any_value(lk.n) AS leaking_identities FROM w JOIN st USING (split), lk GROUP BY w.split""")
def dataset_manifest(spark, sf):
    return S.rounded(stats.dataset_manifest(_prepared(spark, sf)).select("split", "rows", "identities", "sequences", "len_min", "stride", "leaking_identities"))


@query(f"""WITH {S.RECORDINGS}, h AS (SELECT seq % 2 AS src, seq, string_agg((round(e[1], 0) + 0.0)::VARCHAR, ',' ORDER BY frame_idx) AS p FROM r GROUP BY 1, 2)
SELECT list_sort(list(DISTINCT src::VARCHAR)) AS sources, count(*) AS sequences FROM h GROUP BY p HAVING count(DISTINCT src) > 1""")
def duplicate_fingerprints(spark, sf):
    """Recordings that are equal from end to end in whole numbers."""
    r = S.recordings(spark, sf).select((F.col("seq") % 2).cast("string").alias("src"), "seq", "frame_idx", (F.round(F.get("e", F.lit(0)), 0) + F.lit(0.0)).alias("v"))
    return stats.duplicate_fingerprints(r, "src", "seq", "frame_idx", ["v"], None).select("sources", "sequences")


@query("""WITH c AS (SELECT c_mktsegment AS source, c_nationkey AS target, avg(c_acctbal) AS m FROM customer GROUP BY 1, 2) SELECT source, count(*) AS n, round(corr(m, target), 6) AS corr FROM c GROUP BY 1""")
def source_target_matrix(spark, sf):
    c = S.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("source"), F.col("c_nationkey").alias("target"), F.col("c_acctbal").alias("value"))
    motion = c.select("target", F.col("target").cast("double").alias("motion")).distinct()
    return S.rounded(stats.source_target_matrix(c, motion)[1])


@query("WITH v AS (SELECT l_suppkey, l_returnflag AS method, avg(l_quantity) AS value FROM lineitem GROUP BY 1, 2) SELECT v.l_suppkey, v.method, round(v.value, 6) AS value, round(v.value - b.value, 6) + 0.0 AS delta FROM v JOIN v b ON b.l_suppkey = v.l_suppkey AND b.method = 'A'")
def sweep_deltas(spark, sf):
    v = S.table(spark, sf, "lineitem").groupBy("l_suppkey", F.col("l_returnflag").alias("method")).agg(F.avg("l_quantity").alias("value"))
    return S.rounded(stats.sweep_deltas(v, ["l_suppkey"], "method", "value", "A"))


@query("""WITH a AS (SELECT unnest(range(64)) AS i, embedding FROM embeddings WHERE vec_id % 2 = 0), b AS (SELECT unnest(range(64)) AS i, embedding FROM embeddings WHERE vec_id % 2 = 1),
ca AS (SELECT i, j, covar_samp(embedding[i + 1]::DOUBLE, embedding[j + 1]::DOUBLE) AS c FROM a, range(64) t(j) GROUP BY 1, 2), cb AS (SELECT i, j, covar_samp(embedding[i + 1]::DOUBLE, embedding[j + 1]::DOUBLE) AS c FROM b, range(64) t(j) GROUP BY 1, 2)
SELECT round(sum((ca.c - cb.c) ** 2) / (4 * 64 * 64) * 1e6, 6) AS coral_e6 FROM ca JOIN cb USING (i, j)""")
def coral_gap(spark, sf):
    e = S.table(spark, sf, "embeddings").withColumn("v", F.transform("embedding", lambda x: x.cast("double")))
    out = stats.coral_gap(e.filter("vec_id % 2 = 0"), e.filter("vec_id % 2 = 1"), "v", 64)
    return S.rounded(out.select((F.col("coral") * 1e6).alias("coral_e6")))


@query("""WITH e AS (SELECT vec_id, (label >= 5)::INT AS s, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL),
p AS (SELECT a.s + b.s AS kind, list_distance(a.v, b.v) ** 2 AS d FROM e a JOIN e b ON a.vec_id < b.vec_id), w AS (SELECT greatest(median(d), 1e-12) AS band FROM p),
k AS (SELECT kind, avg(exp(-d / band)) AS m FROM p, w GROUP BY kind)
SELECT round(greatest(sum(CASE kind WHEN 1 THEN -2 * m ELSE m END), 0), 6) + 0.0 AS mmd FROM k""")
def mmd_gap(spark, sf):
    e = S.table(spark, sf, "embeddings")
    return S.rounded(stats.mmd_gap(e.filter("label < 5"), e.filter("label >= 5"), "embedding", "vec_id", None))


@query("SELECT value, row_number() OVER (ORDER BY value) - 1 AS label FROM (SELECT DISTINCT trim(n_name) AS value FROM nation WHERE trim(n_name) <> '')")
def label_map(spark, sf):
    return S.rounded(stats.label_map(S.table(spark, sf, "nation"), "n_name"))


@query(f"""WITH {S.pairs_sql()}, ph AS (SELECT *, (("row" * 7 + col * 5 + grp) % 11) / 11.0::DOUBLE AS physical FROM s), sz AS (SELECT grp, count(*) FILTER ("row" = col) AS n FROM s GROUP BY grp),
b AS (SELECT rule, ph.grp, "row", arg_max(col, CASE WHEN rule = 'baseline' OR (rule = 'turning_moe' AND ph.grp % 31 < 19) OR (rule = 'turning_moe_persistent' AND (ph.grp % 31 < 19 OR ph.grp % 2 = 0)) THEN score ELSE physical END * 1e6 - col * 1e-7) AS best
  FROM ph JOIN sz ON sz.grp = ph.grp AND n >= 2, (SELECT unnest(['baseline', 'physical_only', 'turning_moe', 'turning_moe_persistent']) AS rule) GROUP BY 1, 2, 3)
SELECT rule, count(*) FILTER (best = "row") AS correct, count(*) AS total, round(avg((best = "row")::INT), 6) AS accuracy FROM b GROUP BY rule""")
def turning_moe(spark, sf):
    from kinelink.operators.accuracy import candidate_scores

    s = candidate_scores(S.pairs(spark, sf), "grp", "idx").withColumnRenamed("score", "baseline").withColumn("physical", (F.col("row") * 7 + F.col("col") * 5 + F.col("grp")) % 11 / 11.0)
    counts = s.select("grp").distinct().withColumn("turning_count", F.col("grp") % 31)
    persistent = counts.filter("turning_count >= 19 and grp % 2 = 1")
    return S.rounded(stats.turning_moe(s, counts, ["grp"], persistent=persistent))


@query("""WITH d AS (SELECT o_orderstatus AS domain, row_number() OVER (ORDER BY o_orderstatus) - 1 AS d FROM (SELECT DISTINCT o_orderstatus FROM orders)), m AS (SELECT count(*) AS m FROM d), c AS (SELECT o_orderstatus AS domain, count(*) AS n FROM orders GROUP BY 1)
SELECT batch, domain, count(*) AS n FROM (SELECT domain, (r * m + d) // 32 AS batch FROM (SELECT c.domain, d.d, m.m, unnest(range(c.n)) AS r FROM c JOIN d USING (domain), m)) GROUP BY 1, 2""")
def domain_balanced_batches(spark, sf):
    b = batches.domain_balanced_batches(S.table(spark, sf, "orders"), "o_orderstatus", "o_orderkey", 32, 1)
    return b.groupBy("batch", F.col("o_orderstatus").alias("domain")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey, count(*) AS n, true AS together, true AS bounded FROM orders GROUP BY 1")
def same_group_batches(spark, sf):
    """What no draw changes: a customer's rows are all there, in one batch where they fit, and no batch holds more than its size and a group."""
    o = S.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    b = batches.same_group_batches(o, "o_custkey", 64, 3)
    sizes = b.groupBy("batch").agg(F.count(F.lit(1)).alias("_size"))
    groups = b.join(sizes, "batch").groupBy("o_custkey").agg(F.count_distinct("o_orderkey").alias("n"), F.count_distinct("batch").alias("_b"), F.max("_size").alias("_most"))
    return groups.select("o_custkey", "n", (F.col("_b") <= F.ceil(F.col("n") / 64)).alias("together"), (F.col("_most") < 64 + 64).alias("bounded"))


@query("""WITH c AS (SELECT c_custkey AS k, c_mktsegment AS m, c_acctbal / 100 AS x FROM customer), p AS (SELECT a.k AS anchor, b.k AS negative, row_number() OVER (PARTITION BY a.k ORDER BY abs(a.x - b.x), b.k) AS rank FROM c a JOIN c b ON a.m = b.m AND a.k <> b.k) SELECT * FROM p WHERE rank <= 3""")
def hard_negatives(spark, sf):
    c = S.table(spark, sf, "customer").select("c_custkey", "c_mktsegment", (F.col("c_acctbal") / 100).alias("activity"))
    return S.rounded(batches.hard_negatives(c, "c_custkey", "c_mktsegment", "activity", 3, 5))
