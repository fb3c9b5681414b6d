"""Structured Streaming jobs over the given tables, read as streams until they end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelink.functions import layouts as L
from kinelink.operators.storage import fresh_folder
from kinelink.plans import standins as S
from kinelink.plans.registry import query
from kinelink.streaming import matching


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    path = f"{sf}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/{name}.parquet*")


def _finish(stream: DataFrame) -> DataFrame:
    """All that the stream emits until its input ends, as a table in the shared folder."""
    at = fresh_folder(stream.sparkSession)
    stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/out")


@query("""WITH m AS (SELECT max(ts) - INTERVAL 60 SECOND AS mark FROM events), w AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP '1970-01-01') - INTERVAL 30 MINUTE * k AS s, event_type, value FROM events, range(2) t(k))
SELECT epoch(s)::BIGINT AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w, m WHERE s + INTERVAL 60 MINUTE <= mark GROUP BY 1, 2""")
def stream_windows(spark, sf):
    e = _stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = matching.window_stream(e, ["event_type"], "ts", "60 minutes", "30 minutes", "60 seconds", F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    done = _finish(out)
    return S.rounded(done.select(F.unix_seconds("window_start").alias("window_start"), "event_type", "n", "total"), 4)


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM o),
s AS (SELECT user_id, min(ts) AS a, max(ts) + INTERVAL 2 HOUR AS b, count(*) AS n FROM g GROUP BY user_id, g) SELECT user_id, epoch_us(a) AS session_start, n FROM s WHERE b <= (SELECT max(ts) FROM events) - INTERVAL 60 SECOND""")
def stream_sessions(spark, sf):
    e = _stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    done = _finish(matching.session_stream(e, ["user_id"], "ts", "2 hours", "60 seconds"))
    return done.select("user_id", F.unix_micros("session_start").alias("session_start"), "n")


def stream_cells(events: DataFrame) -> DataFrame:
    """Scores of three sensors and tracks per event, as arrays: an event closes a window of its user's session."""
    cells = events.withColumn("_c", F.expr("filter(sequence(0, 8), c -> (event_id + c % 3) % 4 <> 0)"))
    score = lambda c: (F.floor(F.col("value") * 100).cast("long") * (F.floor(c / 3) + 2) * (c % 3 + 3) + F.col("event_id") * 7) % 97 / 97.0
    each = {"imu_idx": lambda c: F.floor(c / 3).cast("int"), "track": lambda c: F.concat(F.lit("t"), (c % 3).cast("string")), "score": score}
    return cells.select(F.col("user_id").cast("string").alias("session"), F.col("ts").cast("timestamp").alias("window_end"), *(F.transform("_c", f).alias(name) for name, f in each.items()))


def stream_scores(events: DataFrame) -> DataFrame:
    """The same scores, a row for each sensor and track."""
    return stream_cells(events).select("session", "window_end", F.explode(F.arrays_zip("imu_idx", "track", "score")).alias("_x")).select("session", "window_end", "_x.*")


@query("""WITH sc AS (SELECT user_id::VARCHAR AS session, epoch_us(ts) // 1000 AS ms, i, t, ((floor(value * 100)::BIGINT * (i + 2) * (t + 3) + event_id * 7) % 97) / 97.0::DOUBLE AS score FROM events, range(3) a(i), range(3) b(t) WHERE (event_id + t) % 4 <> 0),
cf AS (SELECT *, list_sort(list(score) OVER (PARTITION BY session, ms, t), 'DESC') AS l, row_number() OVER (PARTITION BY session, t, i ORDER BY ms) AS k FROM sc),
h AS (SELECT session, ms, i, t, sum(CASE WHEN k = 1 OR l[1] - l[2] > 0.2 THEN score ELSE 0 END) OVER (PARTITION BY session, t, i ORDER BY ms) AS a FROM cf),
m AS (SELECT *, dense_rank() OVER (PARTITION BY session, ms ORDER BY t) - 1 AS c FROM h WHERE ms <= (SELECT (epoch_us(max(ts)) - 10000000) // 1000 FROM events)),
v AS (SELECT session, ms, p, round(coalesce(sum(a), 0), 9) AS v FROM (SELECT DISTINCT session, ms FROM m) w CROSS JOIN (VALUES ([0, 1, 2]), ([0, 2, 1]), ([1, 0, 2]), ([1, 2, 0]), ([2, 0, 1]), ([2, 1, 0])) q(p) LEFT JOIN m USING (session, ms) WHERE p[i + 1] = c GROUP BY 1, 2, 3),
best AS (SELECT session, ms, p FROM v QUALIFY row_number() OVER (PARTITION BY session, ms ORDER BY v DESC, p) = 1)
SELECT b.session, b.ms AS window_end_ms, s.i::BIGINT AS imu_idx, 't' || m.t AS track, round(m.a, 6) + 0.0 AS accumulated FROM best b CROSS JOIN range(3) s(i) LEFT JOIN m ON m.session = b.session AND m.ms = b.ms AND m.i = s.i AND m.c = b.p[s.i + 1]""")
def stream_realtime_match(spark, sf):
    done = _finish(matching.realtime_match(stream_cells(_stream(spark, sf, "events")), threshold=0.2))
    return S.rounded(done)


@query()
def stream_madgwick(spark, sf):
    """Attitude of every label's vectors as a stream of samples, 33 ms apart."""
    v = _stream(spark, sf, "embeddings")
    names = [*L.ACC, *L.GYRO, *L.QUAT]
    samples = v.select(F.col("label").cast("string").alias("device"), F.timestamp_millis(F.col("vec_id") * 33).alias("ts"), *(F.get("embedding", F.lit(51 + i)).cast("double").alias(n) for i, n in enumerate(names)))
    return S.rounded(_finish(matching.madgwick_stream(samples, "device", "ts", list(L.ACC), list(L.GYRO), list(L.QUAT))))


@query("""WITH m AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'), p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase')
SELECT m.event_id AS imu_event, p.event_id AS track_event FROM m JOIN p ON m.user_id = p.user_id AND p.ts BETWEEN m.ts - INTERVAL 30 MINUTE AND m.ts + INTERVAL 30 MINUTE""")
def stream_join(spark, sf):
    e = _stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    side = lambda kind, name: e.filter(F.col("event_type") == kind).select("user_id", "ts", F.col("event_id").alias(name))
    done = _finish(matching.join_streams(side("click", "imu_event"), side("purchase", "track_event"), "user_id", "ts", "30 minutes", "60 seconds"))
    return done.select("imu_event", "track_event")
