"""Further operators: status records, contexts, feedback, permissions, exports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import results as R
from ..operators import security as S
from ..operators import understand as U
from .behaviour import SESSIONS
from .catalog import query, table
from .fusion import ASKED_SQL, asked_queries
from .results import ALIKE, CLASSES, MEASURED, PAIRS, alike


def _e(spark, d):
    return table(spark, d, "events")


def _docs(spark, d):
    return table(spark, d, "documents")


@query("SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), 0) files, CASE WHEN event_type = 'error' THEN 'error' ELSE 'idle' END state, CASE WHEN event_type = 'error' THEN 'failed ' || event_id END message FROM events")
def indexing_status(spark, d):
    """Status rows: JSON with defaults, and states that carry a message behind 'error:'."""
    raw = _e(spark, d).select("event_id", "props", F.when(F.col("event_type") == "error", F.concat(F.lit("error:failed "), F.col("event_id").cast("string"))).otherwise("idle").alias("status"))
    p = F.from_json("props", "k BIGINT")
    failed = F.startswith("status", F.lit("error:"))
    return raw.select("event_id", F.coalesce(p["k"], F.lit(0)).alias("files"), F.when(failed, "error").otherwise(F.col("status")).alias("state"), F.when(failed, F.substring("status", 7, 1 << 20)).alias("message"))


CONTEXT = "SELECT user_id, arg_min(event_type, (ts, event_id)) project, list_sort(list(DISTINCT event_type)) apps, list_sort(list(DISTINCT hour(ts))) hs FROM events GROUP BY 1"


@query(
    f"""WITH c AS ({CONTEXT}) SELECT a.user_id, b.user_id other, round((CASE WHEN a.project = b.project THEN 1 ELSE 0 END + len(list_intersect(a.apps, b.apps)) / len(list_distinct(a.apps || b.apps)) + len(list_intersect(a.hs, b.hs)) / len(list_distinct(a.hs || b.hs))) / 3, 9) similarity
    FROM c a JOIN c b ON b.user_id = a.user_id + 1"""
)
def context_similarity(spark, d):
    """Mean of same project, shared applications and shared hours of users whose numbers follow each other."""
    c = _e(spark, d).groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("project"), F.collect_set("event_type").alias("apps"), F.collect_set(F.hour(F.col("ts").cast("timestamp")).cast("string")).alias("hours"))
    b = c.select((F.col("user_id") - 1).alias("user_id"), F.col("user_id").alias("other"), F.col("project").alias("p2"), F.col("apps").alias("a2"), F.col("hours").alias("h2"))
    s = F.when(F.col("project") == F.col("p2"), 1.0).otherwise(0.0) + T.jaccard(F.col("apps"), F.col("a2")) + T.jaccard(F.col("hours"), F.col("h2"))
    return c.join(b, "user_id").select("user_id", "other", F.round(s / 3, 9).alias("similarity"))


@query(f"SELECT user_id, session_no, CASE WHEN bool_or(event_type = 'purchase') THEN 'buying' WHEN count(*) FILTER (WHERE event_type = 'view') >= 2 THEN 'research' WHEN bool_or(event_type = 'error') THEN 'troubleshooting' ELSE 'browsing' END task FROM ({SESSIONS}) GROUP BY 1, 2")
def task_inference(spark, d):
    from ..operators.behaviour import sessions

    e = F.col("event_type")
    g = sessions(_e(spark, d)).groupBy("user_id", F.col("session_no").cast("long").alias("session_no"))
    task = F.when(F.bool_or(e == "purchase"), "buying").when(F.count_if(e == "view") >= 2, "research").when(F.bool_or(e == "error"), "troubleshooting").otherwise("browsing")
    return g.agg(task.alias("task"))


@query("SELECT user_id, round(list_reduce(list_prepend(0.0::DOUBLE, list(CASE event_type WHEN 'purchase' THEN 0.5::DOUBLE WHEN 'error' THEN -1.0::DOUBLE ELSE 0.1::DOUBLE END ORDER BY ts, event_id)), lambda a, v: greatest(-1.0, least(1.0, a + v * 0.1))), 9) weight FROM events GROUP BY 1")
def feedback_adaptation(spark, d):
    """Weights moved by strength times rate and kept in [-1, 1]."""
    v = F.when(F.col("event_type") == "purchase", 0.5).when(F.col("event_type") == "error", -1.0).otherwise(0.1)
    e = _e(spark, d).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", v.alias("v")))).alias("xs"))
    w = F.aggregate("xs", F.lit(0.0), lambda a, x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), a + x["v"] * 0.1)))
    return e.select("user_id", F.round(w, 9).alias("weight"))


@query("SELECT user_id, list_sort(list(event_type) FILTER (WHERE n > 0.2)) favourites FROM (SELECT user_id, event_type, count(*) / sum(count(*)) OVER (PARTITION BY user_id) n FROM events GROUP BY 1, 2) GROUP BY 1 HAVING count(*) FILTER (WHERE n > 0.2) > 0")
def customisations(spark, d):
    """Of a user's feature map what is beyond a threshold."""
    n = _e(spark, d).groupBy("user_id", "event_type").count()
    w = Window.partitionBy("user_id")
    m = n.withColumn("share", F.col("count") / F.sum("count").over(w)).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "share"))).alias("features"))
    return m.select("user_id", F.array_sort(F.map_keys(F.map_filter("features", lambda k, v: v > 0.2))).alias("favourites")).where(F.size("favourites") > 0)


@query(
    f"""SELECT a, b, round(least(1.0, 0.35 * jaccard + 0.2 * (1 - abs(x.n_chars - y.n_chars) / 10000) + CASE WHEN x.lang = y.lang THEN 0.1 ELSE 0 END + 0.1 * 0.9), 6) similarity
    FROM (WITH {CLASSES} {MEASURED}) p JOIN documents x ON x.doc_id = a JOIN documents y ON y.doc_id = b WHERE round(jaccard, 9) >= {ALIKE}"""
)
def cluster_similarity(spark, d):
    """The weighted sum that clusters are built on."""
    m = _docs(spark, d).select("doc_id", "lang", "n_chars")
    x, y = (m.select(F.col("doc_id").alias(k), F.col("lang").alias(f"l{k}"), F.col("n_chars").alias(f"n{k}")) for k in "ab")
    p = alike(spark, d).join(x, "a").join(y, "b")
    vec = 1 - F.abs(F.col("na") - F.col("nb")) / 10000
    s = R.cluster_similarity(F.col("jaccard"), vec, F.lit(0.0), F.col("la") == F.col("lb"), F.lit(0.9), F.lit(0.0))
    return p.select("a", "b", F.round(s, 6).alias("similarity"))


@query(f"SELECT d.lang AS label, count(*) pairs, round(avg(1 - abs(d.n_chars - e.n_chars) / greatest(d.n_chars, e.n_chars)), 9) coherence FROM ({PAIRS}) p JOIN documents d ON d.doc_id = a JOIN documents e ON e.doc_id = b WHERE d.lang = e.lang GROUP BY 1")
def cluster_coherence(spark, d):
    """Mean likeness of the pairs of a group."""
    m = _docs(spark, d).select("doc_id", "lang", "n_chars")
    x, y = (m.select(F.col("doc_id").alias(k), F.col("lang").alias(f"l{k}"), F.col("n_chars").alias(f"n{k}")) for k in "ab")
    p = alike(spark, d).join(x, "a").join(y, "b").where("la = lb")
    return p.groupBy(F.col("la").alias("label")).agg(F.count("*").alias("pairs"), F.round(F.avg(1 - F.abs(F.col("na") - F.col("nb")) / F.greatest("na", "nb")), 9).alias("coherence"))


@query("SELECT page_id, regexp_replace(regexp_replace(url, '([?&])(utm_source|ref|token|key)=[^&#]*', '\\1\\2=[REDACTED]', 'g'), '#.*$', '') url FROM pages")
def audit_redaction(spark, d):
    """Addresses without the values of tracking and secret parameters."""
    u = F.regexp_replace(F.regexp_replace("url", r"([?&])(utm_source|ref|token|key)=[^&#]*", "$1$2=[REDACTED]"), "#.*$", "")
    return table(spark, d, "pages").select("page_id", u.alias("url"))


@query("SELECT page_id, regexp_matches(url, '^https?://[A-Za-z0-9.-]+(/[^ <>\"]*)?$') valid, lower(regexp_extract(url, '^https?://([^/]+)', 1)) host, length(url) <= 2048 short_enough FROM pages")
def url_validation(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", u.rlike(r'^https?://[A-Za-z0-9.-]+(/[^ <>"]*)?$').alias("valid"), F.lower(F.regexp_extract(u, "^https?://([^/]+)", 1)).alias("host"), (F.length(u) <= 2048).alias("short_enough"))


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'error' AND value > 95) incidents FROM events GROUP BY 1 HAVING count(*) FILTER (WHERE event_type = 'error' AND value > 95) > 0")
def compliance_rule(spark, d):
    n = F.count_if((F.col("event_type") == "error") & (F.col("value") > 95))
    return _e(spark, d).groupBy("user_id").agg(n.alias("incidents")).where("incidents > 0")


@query("SELECT event_id, '10.0.' || (user_id % 4) || '.' || (event_id % 250) ip, user_id % 4 IN (1, 3) allowed FROM events")
def ip_restriction(spark, d):
    """Prefix match of masks of 24 bits."""
    ip = F.concat(F.lit("10.0."), (F.col("user_id") % 4).cast("string"), F.lit("."), (F.col("event_id") % 250).cast("string"))
    e = _e(spark, d).select("event_id", ip.alias("ip"))
    return e.select("event_id", "ip", (F.startswith("ip", F.lit("10.0.1.")) | F.startswith("ip", F.lit("10.0.3."))).alias("allowed"))


@query("SELECT r.doc_id, bool_or(p.ok IS NOT NULL) granted FROM (SELECT doc_id, source || '/' || lang path FROM documents) r LEFT JOIN (VALUES ('^src1/.*$', true), ('^src[0-9]/en$', true)) p(pat, ok) ON regexp_matches(r.path, p.pat) GROUP BY 1")
def direct_permissions(spark, d):
    """Glob, action and expiry of direct grants as of a stated day."""
    grants = spark.createDataFrame([("^src1/.*$", "read", "2025-01-01"), ("^src[0-9]/en$", "read", "2024-06-01"), ("^.*$", "write", "2025-01-01"), ("^.*$", "read", "2023-01-01")], "pattern string, action string, expires string")
    live = grants.where((F.col("action") == "read") & (F.col("expires") > "2024-01-31"))
    r = _docs(spark, d).select("doc_id", F.concat_ws("/", "source", "lang").alias("path"))
    hit = r.join(F.broadcast(live), F.expr("path RLIKE pattern"), "left")  # a stated table of grants
    return hit.groupBy("doc_id").agg(F.bool_or(F.col("pattern").isNotNull()).alias("granted"))


@query("SELECT event_id, value / 100 confidence FROM events WHERE value / 100 >= 0.6 AND length(props) > 7")
def ocr_quality_filter(spark, d):
    """Recognised text is kept from a confidence and a length on."""
    c = F.col("value") / 100
    return _e(spark, d).where((c >= 0.6) & (F.length("props") > 7)).select("event_id", c.alias("confidence"))


@query("SELECT event_id, to_json({'name': event_type, 'value': value, 'user': user_id}) AS json_line, event_type || ',' || value || ',' || user_id csv_line FROM events")
def metric_export(spark, d):
    j = F.to_json(F.struct(F.col("event_type").alias("name"), "value", F.col("user_id").alias("user")))
    return _e(spark, d).select("event_id", j.alias("json_line"), F.concat_ws(",", "event_type", F.col("value").cast("string"), F.col("user_id").cast("string")).alias("csv_line"))


@query("SELECT level, count(*) n, avg(value) mean FROM (SELECT value, CASE WHEN r <= 5 THEN 'memory' WHEN r <= 25 THEN 'disk' ELSE 'miss' END AS level FROM (SELECT value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) r FROM events)) GROUP BY 1")
def two_level_cache(spark, d):
    """Where an entry would be found: the last few in memory, more on disk."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    r = _e(spark, d).withColumn("r", F.row_number().over(w))
    return r.groupBy(F.when(F.col("r") <= 5, "memory").when(F.col("r") <= 25, "disk").otherwise("miss").alias("level")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


@query("SELECT event_type, count(*) n FROM events WHERE NOT (event_type = 'click' OR contains(props, '\"k\": 7') OR value < 5) GROUP BY 1")
def cache_invalidation(spark, d):
    """By type, by content and by confidence."""
    gone = (F.col("event_type") == "click") | F.col("props").contains('"k": 7') | (F.col("value") < 5)
    return _e(spark, d).where(~gone).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT event_type || ' ' || json_extract_string(props, '$.k') query, count(*) uses, count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-24 00:00:00') recent, count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-24 00:00:00') * 4 > count(*) rising, substr(event_type || ' ' || json_extract_string(props, '$.k'), 4) suffix FROM events GROUP BY ALL")
def suggestion_enrichment(spark, d):
    """Use, recent use, trend and what a suggestion adds to three typed letters."""
    q = _e(spark, d).select(F.concat_ws(" ", "event_type", F.get_json_object("props", "$.k")).alias("query"), "ts")
    late = F.count_if(F.col("ts") > F.lit("2024-01-24 00:00:00").cast("timestamp_ntz"))
    return q.groupBy("query").agg(F.count("*").alias("uses"), late.alias("recent")).select("query", "uses", "recent", (F.col("recent") * 4 > F.col("uses")).alias("rising"), F.substring("query", 4, 1 << 20).alias("suffix"))


@query("SELECT user_id, event_type || ' in project' suggestion, round(count(*) / sum(count(*)) OVER (PARTITION BY user_id) * 0.8, 9) score FROM events GROUP BY user_id, event_type")
def personal_suggestions(spark, d):
    w = Window.partitionBy("user_id")
    n = _e(spark, d).groupBy("user_id", "event_type").count()
    return n.select("user_id", F.concat("event_type", F.lit(" in project")).alias("suggestion"), F.round(F.col("count") / F.sum("count").over(w) * 0.8, 9).alias("score"))


@query("SELECT doc_id, length(text) > 100000 too_long, regexp_matches(text, '[\\x00-\\x08\\x0e-\\x1f]') control_signs, length(trim(text)) = 0 blank FROM documents")
def input_validation(spark, d):
    t = F.col("text")
    return _docs(spark, d).select("doc_id", (F.length(t) > 100000).alias("too_long"), t.rlike(r"[\x00-\x08\x0e-\x1f]").alias("control_signs"), (F.length(F.trim(t)) == 0).alias("blank"))


@query("SELECT doc_id, replace(lang, '''', '''''') || ':' || replace(source, '''', '''''') literal FROM documents")
def sql_escape(spark, d):
    return _docs(spark, d).select("doc_id", F.concat(S.sql_escaped(F.col("lang")), F.lit(":"), S.sql_escaped(F.col("source"))).alias("literal"))


@query(f"WITH s AS (SELECT user_id, session_no, list_sort(list(DISTINCT event_type)) topics FROM ({SESSIONS}) GROUP BY 1, 2) SELECT a.user_id, a.session_no, min(b.session_no) joins FROM s a JOIN s b ON a.user_id = b.user_id AND b.session_no <= a.session_no AND len(list_intersect(a.topics, b.topics)) / len(list_distinct(a.topics || b.topics)) > 0.5 GROUP BY 1, 2")
def session_clusters(spark, d):
    """Each session with the first of its user that shares more than half of their topics."""
    from ..operators.behaviour import sessions

    t = sessions(_e(spark, d)).groupBy("user_id", F.col("session_no").cast("long").alias("session_no")).agg(F.array_sort(F.collect_set("event_type")).alias("topics"))
    # sessions with equal topics meet once, so a user's pairs are bounded by the kinds of topics
    kinds = t.groupBy("user_id", "topics").agg(F.min("session_no").alias("first"))
    b = kinds.select("user_id", F.col("topics").alias("other"), F.col("first").alias("candidate"))
    near = t.join(b, "user_id").where((F.col("candidate") <= F.col("session_no")) & (T.jaccard(F.col("topics"), F.col("other")) > 0.5))
    return near.groupBy("user_id", "session_no").agg(F.min("candidate").alias("joins"))


def _types(c):
    from .understanding import TYPES

    return TYPES.replace("lower(text)", f"lower({c})")


STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


@query(f"""SELECT query_id, replace(coalesce(list_aggregate(list_transform(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: length(w) > 3 AND w NOT IN ({STOPS})), lambda w: 'content:' || w) || list_transform({_types('text')}, lambda t: 'type:' || t), 'string_agg', '|'), ''), '|', CASE WHEN regexp_matches(lower(text), '\\b(compare|versus|vs|difference)\\b') THEN ' OR ' ELSE ' AND ' END) expression FROM ({ASKED_SQL})""")
def intent_to_boolean(spark, d):
    return asked_queries(spark, d).select("query_id", U.as_boolean(F.col("text")).alias("expression"))


@query()
def intent_filters(spark, d):
    """Date ranges, types and persons of the stated queries; entities need places, so no SQL."""
    return U.intent_filters(asked_queries(spark, d), "2024-01-31")


@query(
    f"""SELECT query_id, list_transform(list_sort(list_filter([CASE WHEN h = 0 THEN {{'g': -0.9, 'a': 'use fewer words'}} END, CASE WHEN h > 100 THEN {{'g': -0.7, 'a': 'add a word'}} END, CASE WHEN n = 1 THEN {{'g': -0.5, 'a': 'name a field or a type'}} END,
    CASE WHEN n > 1 AND NOT contains(text, '"') THEN {{'g': -0.4, 'a': 'quote a phrase'}} END, CASE WHEN NOT regexp_matches(text, '\\b(AND|OR|NOT)\\b') THEN {{'g': -0.3, 'a': 'combine words with AND, OR, NOT'}} END], lambda r: r IS NOT NULL)), lambda r: r.a) advice
    FROM (SELECT query_id, text, length(text) % 150 h, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')) n FROM ({ASKED_SQL}))"""
)
def refinement_suggestions(spark, d):
    return asked_queries(spark, d).select("query_id", U.refinements(F.col("text"), F.length("text") % 150).alias("advice"))


@query("SELECT user_id, event_id, CASE WHEN p IS NULL THEN 0.0 WHEN p <> event_type THEN 0.8 ELSE 0.0 END + CASE WHEN h IS NULL OR h = hour(ts) THEN 0.0 ELSE 0.5 END change FROM (SELECT *, lag(event_type) OVER w p, lag(hour(ts)) OVER w h FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))")
def context_changes(spark, d):
    """What changed since the event before: project 0.8, application 0.5."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = _e(spark, d).withColumn("h", F.hour(F.col("ts").cast("timestamp")))
    p, q = F.lag("event_type").over(w), F.lag("h").over(w)
    c = F.when(p.isNull() | p.eqNullSafe(F.col("event_type")), 0.0).otherwise(0.8) + F.when(q.isNull() | q.eqNullSafe(F.col("h")), 0.0).otherwise(0.5)
    return e.select("user_id", "event_id", c.alias("change"))


@query("SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 'bookmark' WHEN 'signup' THEN 'share' ELSE 'open' END AS action FROM events WHERE event_type IN ('purchase', 'signup', 'error')")
def follow_up_actions(spark, d):
    e = F.col("event_type")
    return _e(spark, d).where(e.isin("purchase", "signup", "error")).select("user_id", "event_id", F.when(e == "purchase", "bookmark").when(e == "signup", "share").otherwise("open").alias("action"))


@query("SELECT user_id, session_no, round((least(1, CASE WHEN count(*) FILTER (WHERE event_type = 'view') > 0 THEN count(*) FILTER (WHERE event_type = 'click') / count(*) FILTER (WHERE event_type = 'view') ELSE 0 END) + CASE WHEN bool_or(event_type = 'purchase') THEN 1 ELSE 0 END + least(1, 10 / greatest(epoch(max(ts) - min(ts)) / 60 / count(*), 0.001))) / 3, 6) efficiency FROM (" + SESSIONS + ") GROUP BY 1, 2")
def session_efficiency(spark, d):
    """Mean of click-through, goals reached and quickness."""
    from ..operators.behaviour import sessions

    e = F.col("event_type")
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    views, clicks = F.count_if(e == "view"), F.count_if(e == "click")
    ctr = F.least(F.lit(1.0), F.when(views > 0, clicks / views).otherwise(0.0))
    quick = F.least(F.lit(1.0), 10 / F.greatest((us(F.max("ts")) - us(F.min("ts"))) / 60_000_000 / F.count("*"), F.lit(0.001)))
    g = sessions(_e(spark, d)).groupBy("user_id", F.col("session_no").cast("long").alias("session_no"))
    return g.agg(F.round((ctr + F.bool_or(e == "purchase").cast("int") + quick) / 3, 6).alias("efficiency"))


@query("SELECT page_id, lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) IN ('html', 'htm', 'pdf', 'txt', 'md') OR (lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) = '' AND strlen(html) > 0) indexable, greatest(len(list_filter(regexp_split_to_array(html, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')) // 500, 1) pages FROM pages")
def indexable_files(spark, d):
    from ..sources import files

    p = table(spark, d, "pages")
    ext = files.extension(F.col("url"))
    ok = ext.isin("html", "htm", "pdf", "txt", "md") | ((ext == "") & (F.length("html") > 0))
    return p.select("page_id", ok.alias("indexable"), files.page_estimate(F.col("html")).alias("pages"))


@query("SELECT vec_id, label, round(CAST(embedding[1] AS DOUBLE), 6) score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(CAST(embedding[1] AS DOUBLE), 6) DESC, vec_id) r FROM embeddings WHERE embedding[1] >= 0.05) WHERE r <= 10")
def cached_image_search(spark, d):
    """Stored similarities of a text and model: filtered by score, the best ten of each model."""
    w = Window.partitionBy("label").orderBy(F.desc("score"), "vec_id")
    s = table(spark, d, "embeddings").where(F.element_at("embedding", 1) >= F.lit(0.05).cast("float")).select("vec_id", "label", F.round(F.element_at("embedding", 1).cast("double"), 6).alias("score"))
    return s.withColumn("r", F.row_number().over(w)).where("r <= 10").drop("r")
