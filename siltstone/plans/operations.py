"""Metrics, alerts, telemetry and caches; events stand for measurements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from .catalog import query, table


def _e(spark, d):
    return table(spark, d, "events")


def _p(v, p):
    return f"list_sort(list({v}))[CAST(floor((count(*) - 1) * {p}) AS BIGINT) + 1]"


@query(f"SELECT event_type AS name, count(*) n, sum(value) total, avg(value) mean, max(value) highest, min(value) lowest, {_p('value', 0.95)} p95, {_p('value', 0.99)} p99 FROM events GROUP BY 1")
def metric_summary(spark, d):
    v = F.collect_list("value")
    return _e(spark, d).groupBy(F.col("event_type").alias("name")).agg(
        F.count("*").alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean"), F.max("value").alias("highest"), F.min("value").alias("lowest"),
        M.rank_percentile(v, 0.95).alias("p95"), M.rank_percentile(v, 0.99).alias("p99"),
    )


@query(f"SELECT user_id, {_p('value', 0.5)} median FROM events GROUP BY 1")
def rank_percentiles(spark, d):
    return M.percentile_of(_e(spark, d), ["user_id"], "value", 0.5, "median")


@query(f"SELECT time_bucket(INTERVAL 30 SECOND, ts, TIMESTAMP '1970-01-01') AS start, count(*) n, round(avg(value), 9) mean, {_p('value', 0.95)} p95, round(count(*) / 30, 9) rate, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 9) error_share FROM events GROUP BY 1")
def metric_windows_30s(spark, d):
    return M.tumbling(_e(spark, d), "30 seconds", [], 30)


@query(f"SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) n, round(avg(value), 9) mean, {_p('value', 0.95)} p95, round(count(*) / 3600, 9) rate, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 9) error_share FROM events GROUP BY 1, 2")
def metric_windows_hourly(spark, d):
    return M.tumbling(_e(spark, d), "1 hour", ["event_type"], 3600)


@query(
    """SELECT day, round(greatest(0, least(100, 100 - CASE WHEN m > 1000 THEN 20 WHEN m > 500 THEN 10 ELSE 0 END - CASE WHEN s < 0.95 THEN (1 - s) * 30 ELSE 0 END - CASE WHEN i < 0.95 THEN (1 - i) * 20 ELSE 0 END - CASE WHEN f < 1 THEN 15 ELSE 0 END)), 6) score
    FROM (SELECT CAST(ts AS DATE) AS day, avg(value) * 10 m, avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END) s, avg(CASE WHEN event_type <> 'signup' THEN 1.0 ELSE 0.0 END) i, count(*) / 86400 f FROM events GROUP BY 1)"""
)
def health_scores(spark, d):
    e, ok = F.col("event_type"), lambda c: F.avg(c.cast("double"))
    a = _e(spark, d).groupBy(F.to_date("ts").alias("day")).agg((F.avg("value") * 10).alias("m"), ok(e != "error").alias("s"), ok(e != "signup").alias("i"), (F.count("*") / 86400).alias("f"))
    return a.select("day", F.round(M.health(F.col("m"), F.col("s"), F.col("i"), F.col("f")), 6).alias("score"))


NAMES = {"click": "system.cpu.usage", "view": "system.memory.usage_percent", "purchase": "system.disk.usage_percent", "signup": "search.avg_response_time_ms"}


def points(spark, d):
    c = F.lit("other")
    for k, v in NAMES.items():
        c = F.when(F.col("event_type") == k, v).otherwise(c)
    return _e(spark, d).select(c.alias("metric"), "ts", "value", F.col("event_id").alias("seq"))


def _rules(spark):
    return spark.createDataFrame(M.RULES, "rule string, metric string, op string, threshold double, severity string, cooldown_s int")


POINTS = "SELECT CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NAMES.items()) + " ELSE 'other' END metric, ts, value, event_id seq FROM events"
RULES_SQL = "VALUES " + ", ".join(f"('{r}', '{m}', {t}, '{s}', {c})" for r, m, _, t, s, c in M.RULES)


@query(f"SELECT rule, severity, count(*) points, count(*) FILTER (WHERE value > threshold) firing FROM ({POINTS}) JOIN ({RULES_SQL}) r(rule, metric, threshold, severity, cooldown_s) USING (metric) GROUP BY 1, 2")
def alert_checks(spark, d):
    return M.alert_checks(points(spark, d), _rules(spark)).groupBy("rule", "severity").agg(F.count("*").alias("points"), F.count_if("firing").alias("firing"))


@query()
def alert_history(spark, d):
    """Firings and resolutions with cooldown; checked against a plain loop in the tests."""
    return M.alerts(M.alert_checks(points(spark, d), _rules(spark)))


COMMANDS = "SELECT user_id alert_id, event_id AS place, CASE event_type WHEN 'error' THEN 'create' WHEN 'view' THEN 'acknowledge' ELSE 'resolve' END kind FROM events WHERE event_type IN ('error', 'view', 'purchase')"


@query(
    f"""WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY place) n FROM ({COMMANDS})),
    f AS (SELECT alert_id, CAST(0 AS BIGINT) n, 'none' state, CAST(NULL AS BIGINT) opened, CAST(NULL AS BIGINT) acknowledged FROM (SELECT DISTINCT alert_id FROM c)
    UNION ALL SELECT f.alert_id, c.n, CASE WHEN kind = 'create' AND state IN ('none', 'resolved') THEN 'open' WHEN kind = 'acknowledge' AND state = 'open' THEN 'acknowledged' WHEN kind = 'resolve' THEN 'resolved' ELSE state END,
    CASE WHEN kind = 'create' AND state IN ('none', 'resolved') THEN place WHEN kind = 'resolve' THEN NULL ELSE opened END, CASE WHEN kind = 'acknowledge' AND state = 'open' THEN place WHEN kind = 'resolve' THEN NULL ELSE acknowledged END
    FROM f JOIN c ON c.alert_id = f.alert_id AND c.n = f.n + 1)
    SELECT alert_id, arg_max(state, n) state, arg_max(CAST(coalesce(opened, -1) AS BIGINT), n) opened, arg_max(CAST(coalesce(acknowledged, -1) AS BIGINT), n) acknowledged FROM f GROUP BY 1"""
)
def alert_lifecycle(spark, d):
    """The state of each user's alert after errors create it, views acknowledge it and purchases resolve it."""
    kind = F.when(F.col("event_type") == "error", "create").when(F.col("event_type") == "view", "acknowledge").when(F.col("event_type") == "purchase", "resolve")
    s = M.alert_states(_e(spark, d).select(F.col("user_id").alias("alert_id"), F.col("event_id").alias("at"), kind.alias("kind")))
    return s.select("alert_id", "state", *(F.coalesce(c, F.lit(-1)).cast("long").alias(c) for c in ("opened", "acknowledged")))


@query(f"SELECT '# TYPE ' || n || ' gauge' || chr(10) || n || ' ' || v line FROM (SELECT regexp_replace(metric, '[^A-Za-z0-9_]', '_', 'g') n, CAST(arg_max(value, (ts, seq)) AS VARCHAR) v FROM ({POINTS}) GROUP BY metric)")
def prometheus_export(spark, d):
    return M.prometheus(points(spark, d))


@query("SELECT event_id, event_type, value FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-12 00:00:00' ORDER BY ts, event_id")
def metric_range(spark, d):
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return _e(spark, d).where((F.col("ts") >= at("2024-01-10 00:00:00")) & (F.col("ts") < at("2024-01-12 00:00:00"))).select("event_id", "event_type", "value", "ts").orderBy("ts", "event_id").drop("ts")


@query("SELECT event_type, count(*) n, min(ts) oldest, max(ts) newest FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1")
def retention(spark, d):
    e = _e(spark, d)
    last = e.agg(F.max("ts").alias("last"))  # one row
    return e.crossJoin(F.broadcast(last)).where(F.col("ts") > F.col("last") - F.expr("INTERVAL 7 DAYS")).groupBy("event_type").agg(F.count("*").alias("n"), F.min("ts").alias("oldest"), F.max("ts").alias("newest"))


@query("SELECT event_id, value FROM events WHERE value > 95")
def slow_operations(spark, d):
    return _e(spark, d).where("value > 95").select("event_id", "value")


@query("SELECT user_id, CAST(day AS VARCHAR) \"day\", CAST((row_number() OVER (PARTITION BY day ORDER BY ts, event_id) - 1) // 100 AS INTEGER) batch, event_id FROM (SELECT *, CAST(ts AS DATE) AS day FROM events)")
def telemetry_batches(spark, d):
    e = _e(spark, d).withColumn("day", F.to_date("ts").cast("string"))
    return M.batches(e, ["ts", "event_id"], 100).select("user_id", "day", "batch", "event_id")


@query("SELECT event_id, '/home/[USER]/docs/' || event_type path, sha256(CAST(user_id AS VARCHAR)) user_hash FROM events")
def telemetry_anonymised(spark, d):
    path = F.concat(F.lit("/home/u"), F.col("user_id").cast("string"), F.lit("/docs/"), F.col("event_type"))
    return _e(spark, d).select("event_id", M.anonymised(path).alias("path"), F.sha2(F.col("user_id").cast("string"), 256).alias("user_hash"))


@query("SELECT event_type, sha256(lower(trim(' ' || upper(event_type) || ' ')) || '|' || 'k=' || json_extract_string(props, '$.k') || '&' || 'user=' || user_id) cache_key, count(*) hits, count(*) > 1 AS hit FROM events GROUP BY ALL")
def search_cache_keys(spark, d):
    f = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("k"), F.get_json_object("props", "$.k"))
    e = _e(spark, d).select("event_type", M.cache_key(F.concat(F.lit(" "), F.upper("event_type"), F.lit(" ")), f).alias("cache_key"))
    return e.groupBy("event_type", "cache_key").agg(F.count("*").alias("hits"), (F.count("*") > 1).alias("hit"))


@query("SELECT user_id, count(*) hits, round(300.0 * CASE WHEN count(*) > 10 THEN 1.5 ELSE 1 END * CASE WHEN avg(value) / 100 > 0.8 THEN 1.2 WHEN avg(value) / 100 < 0.3 THEN 0.5 ELSE 1 END, 6) ttl_s, round(0.7 * avg(value) / 100 + 0.3 * least(1.0, 1000 / greatest(avg(value), 1)), 6) quality FROM events GROUP BY 1")
def cache_policy(spark, d):
    a = _e(spark, d).groupBy("user_id").agg(F.count("*").alias("hits"), F.avg("value").alias("v"))
    return a.select("user_id", "hits", F.round(M.cache_ttl(300, F.col("hits"), F.col("v") / 100), 6).alias("ttl_s"), F.round(M.cache_quality(F.col("v") / 100, F.col("v")), 6).alias("quality"))


@query("SELECT event_id, event_type FROM events WHERE ts + INTERVAL 3 DAY > TIMESTAMP '2024-01-28 00:00:00' AND event_type <> 'error'")
def cache_lookup(spark, d):
    """Entries that haven't expired as of an instant, without those of an invalidated type."""
    return _e(spark, d).where((F.col("ts") + F.expr("INTERVAL 3 DAYS") > F.lit("2024-01-28 00:00:00").cast("timestamp_ntz")) & (F.col("event_type") != "error")).select("event_id", "event_type")


@query("SELECT label AS model, n * 256 bytes FROM (SELECT label, count(*) n, sum(count(*) * 256) OVER (ORDER BY count(*) > 50, min(vec_id), label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) before_ FROM embeddings GROUP BY 1) WHERE coalesce(before_, 0) < 40000")
def model_eviction(spark, d):
    m = table(spark, d, "embeddings").groupBy(F.col("label").alias("model")).agg((F.count("*") * 256).alias("bytes"), (F.count("*") > 50).alias("used"), F.min("vec_id").alias("last_used"))
    return M.evicted(m, 40000).select("model", "bytes")


@query("SELECT count(*) total, count(*) FILTER (WHERE event_type = 'view') hits, round(count(*) FILTER (WHERE event_type = 'view') / count(*), 9) hit_rate, sum(length(props)) bytes, sum(length(props)) > 1000000 pressure FROM events")
def cache_metrics(spark, d):
    hit = F.count_if(F.col("event_type") == "view")
    size = F.sum(F.length("props"))
    return _e(spark, d).agg(F.count("*").alias("total"), hit.alias("hits"), F.round(hit / F.count("*"), 9).alias("hit_rate"), size.alias("bytes"), (size > 1000000).alias("pressure"))


@query("SELECT name, severity FROM (SELECT 'documents' name, CASE WHEN count(*) = 0 THEN 2 ELSE 0 END severity FROM documents UNION ALL SELECT 'events', CASE WHEN avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0 END) > 0.1 THEN 1 ELSE 0 END FROM events UNION ALL SELECT 'overall', greatest((SELECT CASE WHEN count(*) = 0 THEN 2 ELSE 0 END FROM documents), (SELECT CASE WHEN avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0 END) > 0.1 THEN 1 ELSE 0 END FROM events)))")
def overall_health(spark, d):
    """The worst state of the components."""
    docs = table(spark, d, "documents").agg(F.when(F.count("*") == 0, 2).otherwise(0).alias("severity")).select(F.lit("documents").alias("name"), "severity")
    ev = _e(spark, d).agg(F.when(F.avg((F.col("event_type") == "error").cast("double")) > 0.1, 1).otherwise(0).alias("severity")).select(F.lit("events").alias("name"), "severity")
    both = docs.unionByName(ev)
    return both.unionByName(both.agg(F.max("severity").alias("severity")).select(F.lit("overall").alias("name"), "severity"))


@query("SELECT event_type, user_id, count(*) n, grouping(event_type) g1, grouping(user_id) g2 FROM events GROUP BY GROUPING SETS ((event_type), (user_id), ())")
def audit_report(spark, d):
    _e(spark, d).createOrReplaceTempView("audit_events")
    return spark.sql("SELECT event_type, user_id, count(*) n, CAST(grouping(event_type) AS BIGINT) g1, CAST(grouping(user_id) AS BIGINT) g2 FROM audit_events GROUP BY GROUPING SETS ((event_type), (user_id), ())")


@query(
    "SELECT user_id, round(list_reduce(list_prepend(0.0::DOUBLE, list(CAST(value AS DOUBLE) ORDER BY ts, event_id)), lambda a, v: 0.9 * a + 0.1 * v), 6) smoothed FROM events GROUP BY 1"
)
def exponential_average(spark, d):
    from ..operators.behaviour import moving

    e = _e(spark, d).select("user_id", F.struct("ts", "event_id", "value").alias("x"))
    return e.groupBy("user_id").agg(F.array_sort(F.collect_list("x")).alias("xs")).select("user_id", F.round(moving(F.transform("xs", lambda x: x["value"]), 0.1, 0.0), 6).alias("smoothed"))
