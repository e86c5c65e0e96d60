"""Streams run to the end of what is there; the SQL says what batch processing gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import streams as S
from .catalog import query


def _path(d):
    return f"{d}/events.parquet"


CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


@query(f"SELECT start, event_type, n, mean, highest FROM (SELECT time_bucket(INTERVAL 30 SECOND, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) n, avg(value) mean, max(value) highest FROM events GROUP BY 1, 2) WHERE start + INTERVAL 30 SECOND <= {CLOSED}")
def stream_windows(spark, d):
    w = S.drained(spark, S.windowed(S.event_stream(spark, _path(d))), "windows")
    return w.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(f"SELECT start, event_type, n, mean, highest FROM (SELECT s AS start, event_type, count(*) n, avg(value) mean, max(value) highest FROM (SELECT *, unnest([time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '1970-01-01') - INTERVAL 5 MINUTE]) s FROM events) GROUP BY 1, 2) WHERE start + INTERVAL 10 MINUTE <= {CLOSED}")
def stream_sliding_windows(spark, d):
    w = S.drained(spark, S.windowed(S.event_stream(spark, _path(d)), "10 minutes", "5 minutes"), "sliding")
    return w.withColumn("start", F.col("start").cast("timestamp_ntz"))


GAPS = "SELECT user_id, event_id, ts, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) k FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) p FROM events)"


@query(f'SELECT user_id, start, "end", n FROM (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE "end", count(*) n FROM ({GAPS}) GROUP BY user_id, k) WHERE "end" <= {CLOSED}')
def stream_sessions(spark, d):
    s = S.drained(spark, S.sessions(S.event_stream(spark, _path(d))), "sessions")
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query(f"SELECT user_id, event_id, n FROM (SELECT user_id, arg_max(event_id, (ts, event_id)) event_id, max(ts) + INTERVAL 30 MINUTE e, count(*) n FROM ({GAPS}) GROUP BY user_id, k) WHERE e <= {CLOSED}")
def stream_trailing_debounce(spark, d):
    return S.drained(spark, S.last_of_burst(S.event_stream(spark, _path(d)), "user_id", "30 minutes"), "trailing")


@query("SELECT event_id FROM events")
def stream_deduplicated(spark, d):
    """Leading edge by event identifier: repeated deliveries count once."""
    s = S.event_stream(spark, _path(d))
    return S.drained(spark, S.debounced(s.select("event_id", "ts"), ["event_id"]), "leading").select("event_id")


@query("SELECT user_id, count(*) n, round(list_reduce(list_prepend(0.5::DOUBLE, list(CAST(value AS DOUBLE) ORDER BY ts, event_id)), lambda a, v: a * (1 - 0.1) + v * 0.1), 6) AS average FROM events GROUP BY 1")
def stream_running_average(spark, d):
    s = S.event_stream(spark, _path(d)).select("user_id", "ts", "event_id", "value")
    return S.drained(spark, S.running_average(s), "average").withColumn("average", F.round("average", 6))
