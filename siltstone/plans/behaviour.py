"""Sessions, personalisation and learning; events stand for interactions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import behaviour as B
from .catalog import query, table

SESSIONS = """SELECT *, CAST(sum(CASE WHEN p IS NULL OR ts - p > INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) session_no
FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) p FROM events)"""
KIND = "CASE event_type WHEN 'purchase' THEN 'bookmark' WHEN 'signup' THEN 'share' WHEN 'view' THEN 'dwell' WHEN 'click' THEN 'click' ELSE 'open' END"
SIGNALS = "CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'signup' THEN 0.9 WHEN 'view' THEN 0.6 WHEN 'click' THEN 0.3 ELSE 0.7 END"


def _events(spark, d):
    return table(spark, d, "events")


def _kind():
    e = F.col("event_type")
    return F.when(e == "purchase", "bookmark").when(e == "signup", "share").when(e == "view", "dwell").when(e == "click", "click").otherwise("open")


@query(f"SELECT event_id, user_id, session_no FROM ({SESSIONS})")
def sessionised_events(spark, d):
    return B.sessions(_events(spark, d)).select("event_id", "user_id", F.col("session_no").cast("long").alias("session_no"))


@query(
    f"""SELECT user_id, session_no, count(*) events, count(*) FILTER (WHERE event_type = 'view') searches, count(*) FILTER (WHERE event_type = 'click') selections, epoch(max(ts) - min(ts)) AS seconds,
    round(CASE WHEN count(*) FILTER (WHERE event_type = 'view') > 0 THEN count(*) FILTER (WHERE event_type = 'click') / count(*) FILTER (WHERE event_type = 'view') ELSE 0 END, 9) ctr FROM ({SESSIONS}) GROUP BY 1, 2"""
)
def session_metrics(spark, d):
    return B.session_metrics(B.sessions(_events(spark, d)).withColumn("session_no", F.col("session_no").cast("long")))


@query()
def capped_sessions(spark, d):
    """Sessions of at most eight hours; equal to the plain ones where none is longer (tested)."""
    return B.capped_sessions(_events(spark, d))


@query("SELECT user_id, count(*) sessions FROM (SELECT user_id FROM (" + SESSIONS + ") GROUP BY user_id, session_no) GROUP BY 1")
def session_windows(spark, d):
    """The same sessions by the built-in session window; its gap is reached where the other's is exceeded."""
    e = _events(spark, d).select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    s = e.groupBy("user_id", F.session_window("ts", "1800 seconds 1 microseconds")).count()
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"))


JACCARD = "round(CASE WHEN len(list_distinct(t || p)) = 0 THEN 0 ELSE len(list_intersect(list_distinct(t), list_distinct(p))) / len(list_distinct(t || p)) END, 9)"
TURNS = """SELECT conv_id, turn, t, lag(t) OVER (PARTITION BY conv_id ORDER BY turn) p FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: w <> '') t FROM conversations)"""


@query(f"SELECT conv_id, turn, CASE WHEN p IS NOT NULL THEN {JACCARD} END similarity, CASE WHEN p IS NULL THEN 'none' WHEN {JACCARD} > 0.5 THEN 'refine' ELSE 'pivot' END transition, CASE WHEN p IS NOT NULL THEN {JACCARD} > 0.5 AND {JACCARD} < 0.95 END reformulated FROM ({TURNS})")
def query_refinements(spark, d):
    r = B.refinements(table(spark, d, "conversations"), "conv_id", "turn", T.ascii_tokens(F.coalesce("text", F.lit(""))))
    first = F.col("transition") == "none"
    return r.withColumn("similarity", F.when(~first, F.col("similarity"))).withColumn("reformulated", F.when(~first, F.col("reformulated")))


@query("""SELECT "from", event_type "to", count(*) n FROM (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) "from" FROM events) WHERE "from" IS NOT NULL GROUP BY 1, 2""")
def reformulation_map(spark, d):
    e = _events(spark, d).withColumn("at", F.struct("ts", "event_id"))
    return B.transitions(e, "user_id", "at", "event_type")


@query(f"SELECT user_id, {KIND} kind, {SIGNALS} signal, count(*) n FROM events GROUP BY ALL")
def learning_signals(spark, d):
    k = _events(spark, d).select("user_id", _kind().alias("kind"))
    return k.select("user_id", "kind", B.signal(F.col("kind")).alias("signal")).groupBy("user_id", "kind", "signal").agg(F.count("*").alias("n"))


@query(f"SELECT user_id, round(list_reduce(list_prepend(0.5::DOUBLE, list(CAST({SIGNALS} AS DOUBLE) ORDER BY ts, event_id)), lambda a, v: a * (1 - 0.1) + v * 0.1), 9) preference FROM events GROUP BY 1")
def preference_updates(spark, d):
    e = _events(spark, d).select("user_id", F.struct("ts", "event_id", B.signal(_kind()).alias("v")).alias("x"))
    return e.groupBy("user_id").agg(F.array_sort(F.collect_list("x")).alias("xs")).select("user_id", F.round(B.moving(F.transform("xs", lambda x: x["v"])), 9).alias("preference"))


@query(
    f"""SELECT user_id, round(list_reduce(list_prepend({{'v': 0.7::DOUBLE, 'k': '', 'd': 60.0::DOUBLE}}, list({{'v': 0.0::DOUBLE, 'k': {KIND}, 'd': CAST(value AS DOUBLE)}} ORDER BY ts, event_id)), lambda a, e: {{'v': CASE WHEN e.k = 'bookmark' THEN greatest(a.v, 0.9) WHEN e.k = 'share' THEN least(greatest(a.v, 0.8) + 0.1, 1.0) WHEN e.d > 120 THEN greatest(a.v, 0.8) WHEN e.d < 10 THEN least(a.v, 0.6) ELSE a.v END, 'k': e.k, 'd': e.d}}).v, 9) satisfaction FROM events GROUP BY 1"""
)
def session_satisfaction(spark, d):
    e = _events(spark, d).select("user_id", F.struct("ts", "event_id", _kind().alias("kind"), F.col("value").alias("dwell_s")).alias("x"))
    return e.groupBy("user_id").agg(F.array_sort(F.collect_list("x")).alias("xs")).select("user_id", F.round(B.satisfaction(F.col("xs")), 9).alias("satisfaction"))


@query("SELECT user_id, event_id, CAST(hour(ts) AS DOUBLE) / 24 hour_of_day, CAST(isodow(ts) - 1 AS INTEGER) weekday, CAST(day(ts) AS DOUBLE) / 31 day_of_month, least(abs(value) / 1000, 1.0) length_share FROM events")
def interaction_features(spark, d):
    ts = F.col("ts")
    return _events(spark, d).select("user_id", "event_id", (F.hour(ts.cast("timestamp")).cast("double") / 24).alias("hour_of_day"), F.weekday(ts).alias("weekday"), (F.dayofmonth(ts).cast("double") / 31).alias("day_of_month"), F.least(F.abs("value") / 1000, F.lit(1.0)).alias("length_share"))


FEATURES = "SELECT user_id, event_type feature, count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS value FROM events GROUP BY 1, 2"


@query(
    f"""WITH f AS ({FEATURES}), p AS (SELECT a.user_id, b.user_id other, avg(1 - abs(a.value - b.value)) s, avg(CASE WHEN abs(a.value - b.value) < 0.2 THEN 1.0 ELSE 0.0 END) c FROM f a JOIN f b ON a.feature = b.feature AND a.user_id <> b.user_id GROUP BY 1, 2)
    SELECT user_id, other, round(s, 9) similarity, CAST(row_number() OVER (PARTITION BY user_id ORDER BY round(s, 9) DESC, other) AS INTEGER) AS rank FROM p WHERE c > 0.5 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(s, 9) DESC, other) <= 5"""
)
def similar_users(spark, d):
    n = _events(spark, d).groupBy("user_id", F.col("event_type").alias("feature")).agg(F.count("*").alias("n"))
    f = n.withColumn("value", F.col("n") / F.sum("n").over(Window.partitionBy("user_id")))
    return B.similar_users(f.select("user_id", "feature", "value"))


DRIFT = "SELECT user_id, event_id, avg(value) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) now, avg(value) OVER (w ROWS BETWEEN 39 PRECEDING AND 20 PRECEDING) old, count(value) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) a, count(value) OVER (w ROWS BETWEEN 39 PRECEDING AND 20 PRECEDING) b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)"


@query(f"SELECT user_id, event_id, round(abs(now - old), 6) drift FROM ({DRIFT}) WHERE a >= 10 AND b >= 10")
def preference_drift(spark, d):
    return B.drift(_events(spark, d), "user_id", "event_id", "value").withColumn("drift", F.round("drift", 6))


@query("SELECT user_id, count(*) n, CASE WHEN count(*) <= 5 THEN 'ColdStart' WHEN count(*) <= 20 THEN 'Bootstrapping' WHEN avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END) >= 0.8 THEN 'Stable' WHEN avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END) >= 0.6 THEN 'Active' ELSE 'Degraded' END state FROM events GROUP BY 1")
def learning_states(spark, d):
    a = _events(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), F.avg((F.col("event_type") != "error").cast("double")).alias("acc"))
    return a.select("user_id", "n", B.learning_state(F.col("n"), F.col("acc")).alias("state"))


@query("SELECT conv_id, term, n FROM (SELECT conv_id, term, count(*) n, row_number() OVER (PARTITION BY conv_id ORDER BY count(*) DESC, term) r FROM (SELECT conv_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: length(w) > 3)) term FROM conversations) GROUP BY 1, 2) WHERE r <= 5")
def dominant_topics(spark, d):
    from ..operators.results import top_terms

    return top_terms(table(spark, d, "conversations"), "conv_id", 5, 3).select("conv_id", "term", "n")


@query("SELECT user_id, event_type AS query_type, epoch(max(ts) - min(ts)) dwell_s FROM (" + SESSIONS + ") GROUP BY user_id, session_no, event_type")
def selection_dwell(spark, d):
    s = B.sessions(_events(spark, d)).groupBy("user_id", "session_no", F.col("event_type").alias("query_type"))
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return s.agg(((us(F.max("ts")) - us(F.min("ts"))) / 1_000_000).alias("dwell_s")).select("user_id", "query_type", "dwell_s")


@query("SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) n FROM events) WHERE n <= 20")
def session_history(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return _events(spark, d).withColumn("n", F.row_number().over(w)).where("n <= 20").select("user_id", "event_id", "ts")


@query("SELECT u.user_id, coalesce(p.relevance, 0.5) relevance, coalesce(p.recency, 0.2) recency FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN (SELECT user_id, 0.6 relevance, 0.1 recency FROM events WHERE event_type = 'purchase' GROUP BY 1 HAVING count(*) > 12) p USING (user_id)")
def personal_weights(spark, d):
    """A user's own weights, or the default ones."""
    e = _events(spark, d)
    own = e.where("event_type = 'purchase'").groupBy("user_id").count().where("count > 12").select("user_id", F.lit(0.6).alias("r"), F.lit(0.1).alias("c"))
    return e.select("user_id").distinct().join(own, "user_id", "left").select("user_id", F.coalesce("r", F.lit(B.DEFAULT_WEIGHTS["relevance"])).alias("relevance"), F.coalesce("c", F.lit(B.DEFAULT_WEIGHTS["recency"])).alias("recency"))


@query("SELECT conv_id, turn, len(t) > len(n2) narrowing FROM (SELECT conv_id, turn, t, lead(t, 2) OVER (PARTITION BY conv_id ORDER BY turn) n2 FROM (SELECT conv_id, turn, regexp_split_to_array(trim(coalesce(text, '')), '[ \\t\\n\\x0B\\f\\r]+') t FROM conversations)) WHERE n2 IS NOT NULL")
def refinement_pattern(spark, d):
    """Of three queries in a row, whether the first has more words than the last."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, d, "conversations").select("conv_id", "turn", F.size(F.split(F.trim(F.coalesce("text", F.lit(""))), r"\s+")).alias("n"))
    return t.withColumn("later", F.lead("n", 2).over(w)).where("later IS NOT NULL").select("conv_id", "turn", (F.col("n") > F.col("later")).alias("narrowing"))
