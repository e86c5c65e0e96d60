"""Changes, expiry, re-processing, samples, ranked boolean queries, session advice, policies and mails."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..boolean import execute as X
from ..operators import behaviour as B
from ..operators import security as S
from ..operators import upkeep as K
from ..operators.inverted import stored
from ..sources.files import mail_fields
from .behaviour import SESSIONS
from .catalog import query, table
from .search import DOCS, FIELDS, HAS, boolean_texts, tree_of


def _docs(spark, d):
    return table(spark, d, "documents")


def _e(spark, d):
    return table(spark, d, "events")


def _us(c):
    return F.unix_micros(F.col(c).cast("timestamp"))


RANKED = 'with^2 AND (from OR "of the") AND NOT scum'


@query(
    f"""WITH d AS ({DOCS}), q(term, boost) AS (VALUES ('with', 2.0), ('from', 1.0), ('of', 1.0), ('the', 1.0)), c AS (SELECT count(*) n, avg(len(t)) m FROM d),
    f AS (SELECT term, doc_id, n, count(*) tf FROM (SELECT doc_id, len(t) n, unnest(t) term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL), g AS (SELECT term, count(*) df FROM f GROUP BY 1),
    s AS (SELECT doc_id, sum(CAST(boost AS DOUBLE) * ln((c.n - df + 0.5) / (df + 0.5) + 1.0) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * f.n / c.m))) score FROM f JOIN g USING (term) JOIN q USING (term), c GROUP BY 1),
    h AS (SELECT doc_id FROM d WHERE {HAS.format('with')} AND ({HAS.format('from')} OR {HAS.format('of the')}) AND NOT {HAS.format('scum')}),
    r AS (SELECT doc_id, score, CAST(row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS rank FROM h JOIN s USING (doc_id)) SELECT doc_id, score, rank FROM r WHERE rank <= 50"""
)
def boolean_ranked(spark, d):
    """Relevance of boolean hits: BM25 of the asked words times their boosts, over the stored index."""
    docs = _docs(spark, d)
    return X.ranked_search(docs, stored(docs), RANKED, FIELDS, 50)


@query(f"SELECT doc_id FROM ({DOCS}) WHERE {HAS.format('with')} AND {HAS.format('from')} AND lang = 'en'")
def fallback_search(spark, d):
    """A text that isn't a boolean query becomes its words; the intent's filter narrows them."""
    return X.answered(_docs(spark, d), "with ) from", FIELDS, ["type:en"]).select("doc_id")


@query()
def boolean_steps(spark, d):
    """Plan records of boolean queries over the documents that there are; checked by hand-made examples in the tests."""
    n = stored(_docs(spark, d)).manifest.docs

    def run(frames):
        for x in frames:
            rows = [(name, i, *s) for name, text in zip(x["name"], x["text"], strict=True) for i, s in enumerate(X.steps(tree_of(text or ""), n))]
            yield pd.DataFrame(rows, columns=["name", "step", "kind", "operation", "selectivity", "documents", "cost"])

    return boolean_texts(spark, d).mapInPandas(run, "name string, step int, kind string, operation string, selectivity double, documents long, cost double")


@query(
    """SELECT lower(w) word, count(*) frequency FROM (SELECT unnest(list_transform(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: regexp_replace(x, '^[^\\pL\\pN]+|[^\\pL\\pN]+$', '', 'g'))) w FROM documents WHERE text IS NOT NULL) WHERE octet_length(encode(w)) >= 3 GROUP BY 1"""
)
def user_dictionary(spark, d):
    return _docs(spark, d).select(F.explode(K.dictionary_words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("frequency"))


OLD = "SELECT source || '/' || doc_id path, md5(coalesce(text, '')) hash FROM documents WHERE source IS DISTINCT FROM 'src1'"
NEW = "SELECT CASE WHEN source = 'src3' THEN 'moved/' ELSE '' END || source || '/' || doc_id path, md5(CASE WHEN lang = 'de' AND source <> 'src3' THEN '*' ELSE '' END || coalesce(text, '')) hash FROM documents WHERE source IS DISTINCT FROM 'src2'"


@query(
    f"""WITH o AS ({OLD}), n AS ({NEW}), t AS (SELECT coalesce(o.path, n.path) path, CASE WHEN o.path IS NULL THEN 'created' WHEN n.path IS NULL THEN 'deleted' WHEN o.hash <> n.hash THEN 'modified' END change, coalesce(n.hash, o.hash) hash FROM o FULL JOIN n ON o.path = n.path),
    m AS (SELECT min(path) FILTER (WHERE change = 'created') path, min(path) FILTER (WHERE change = 'deleted') from_path FROM t WHERE change IN ('created', 'deleted') GROUP BY hash HAVING count(*) FILTER (WHERE change = 'created') = 1 AND count(*) FILTER (WHERE change = 'deleted') = 1)
    SELECT change, path, NULL::VARCHAR from_path FROM t WHERE change IS NOT NULL AND path NOT IN (SELECT path FROM m UNION ALL SELECT from_path FROM m) UNION ALL SELECT 'renamed', path, from_path FROM m"""
)
def change_events(spark, d):
    """What happened between two listings: src1 came, src2 went, src3 moved, German texts changed."""
    docs = _docs(spark, d)
    source, text, name = F.col("source"), F.coalesce("text", F.lit("")), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))
    old = docs.where(~source.eqNullSafe(F.lit("src1"))).select(name.alias("path"), F.md5(text).alias("hash")).where("path IS NOT NULL")
    path = F.concat(F.when(source == "src3", "moved/").otherwise(""), name)
    changed = F.concat(F.when((F.col("lang") == "de") & (source != "src3"), "*").otherwise(""), text)
    new = docs.where(~source.eqNullSafe(F.lit("src2"))).select(path.alias("path"), F.md5(changed).alias("hash")).where("path IS NOT NULL")
    return K.changes(old, new)


@query("SELECT event_id, CAST(ceil((epoch_us(ts) + CAST(least(value, 300) * 1000000 AS BIGINT)) / 300000000) * 300 AS BIGINT) removed_at FROM events WHERE value IS NOT NULL")
def periodic_expiry(spark, d):
    """Entries live for their own time; a sweep every five minutes removes them."""
    live = (F.least("value", F.lit(300.0)) * 1_000_000).cast("decimal(20,0)").cast("long")
    return _e(spark, d).where("value IS NOT NULL").select("event_id", K.swept(_us("ts") + live, 300).cast("long").alias("removed_at"))


@query("SELECT event_id, event_type FROM events WHERE CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 7) AS BIGINT) < 26843545")
def event_sampling(spark, d):
    """A tenth of the measurements (the sampling operator)."""
    return K.sampled(_e(spark, d), "event_id", 0.1).select("event_id", "event_type")


@query(
    """SELECT doc_id, similarity FROM (SELECT doc_id, round(coalesce(list_position(list_transform(range(1, 33), lambda i: h[i] <> t[i]), true) - 1, 32) / 32.0, 9) similarity FROM (SELECT doc_id, md5(coalesce(text, '')) h, md5('stated text') t FROM documents)) WHERE similarity > 0"""
)
def hash_prefix_similarity(spark, d):
    s = K.prefix_similarity(F.md5(F.coalesce("text", F.lit(""))), F.md5(F.lit("stated text")))
    return _docs(spark, d).select("doc_id", F.round(s, 9).alias("similarity")).where("similarity > 0")


@query("SELECT doc_id, coalesce(length(trim(text, ' ')), 0) < 40 reprocessed, CASE WHEN coalesce(length(trim(text, ' ')), 0) < 40 THEN 'heard ' || doc_id ELSE left(text, 40) END AS beginning FROM documents")
def reprocessed_documents(spark, d):
    """Texts too short to be whole come anew from a stand-in of a recogniser."""
    docs = K.reprocessed(_docs(spark, d).select("doc_id", "text"), "doc_id", lambda k: pd.Series([f"heard {x}" for x in k], index=k.index), 40)
    return docs.select("doc_id", "reprocessed", F.left("text", F.lit(40)).alias("beginning"))


@query("SELECT props AS query, count(*) n, count(*) FILTER (WHERE event_type = 'click') selected, max(ts) AS last FROM events GROUP BY 1")
def query_recording(spark, d):
    """A log of the first half of the month, and the second half recorded upon it."""
    e = _e(spark, d).select(F.col("props").alias("query"), (F.col("event_type") == "click").alias("selected"), "ts")
    middle = F.lit("2024-01-16").cast("timestamp_ntz")
    empty = spark.createDataFrame([], "query string, n long, selected long, last timestamp_ntz")
    return K.recorded(K.recorded(empty, e.where(F.col("ts") < middle)), e.where(F.col("ts") >= middle))


MEASURES = "SELECT user_id, count(*) n, avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END) accuracy, avg(value) AS dwell FROM events GROUP BY 1"
CONDITIONS = [("expand_queries", "accuracy", "<", 0.8), ("expand_queries", "n", ">", 20.0), ("personalise", "dwell", ">", 45.0), ("personalise", "accuracy", ">", 0.7), ("explore", "n", "<", 100.0)]


@query(
    f"""WITH m AS ({MEASURES}) SELECT user_id, 'expand_queries' strategy FROM m WHERE accuracy < 0.8 AND n > 20 UNION ALL SELECT user_id, 'personalise' FROM m WHERE dwell > 45 AND accuracy > 0.7 UNION ALL SELECT user_id, 'explore' FROM m WHERE n < 100"""
)
def adaptation_conditions(spark, d):
    """Strategies whose conditions all hold."""
    m = _e(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), F.avg((F.col("event_type") != "error").cast("double")).alias("accuracy"), F.avg("value").alias("dwell"))
    return B.adaptations(m, CONDITIONS)


@query(
    f"""WITH e AS (SELECT *, user_id || ':' || session_no sid FROM ({SESSIONS.replace('30 MINUTE', '2 DAY')})), s AS (SELECT sid, count(*) queries FROM e GROUP BY 1),
    g AS (SELECT sid, 'buy' goal, count(*) FILTER (WHERE event_type = 'purchase') / 3.0::DOUBLE progress FROM e GROUP BY 1 HAVING bool_or(event_type IN ('purchase', 'signup'))), a AS (SELECT sid, event_type area, count(*) queries, avg(CASE WHEN value >= 50 THEN 1.0 ELSE 0.0 END) success FROM e GROUP BY 1, 2)
    SELECT sid session_id, 'query' kind, 'continue: ' || goal AS content, round(0.8 * (1 - progress), 9) relevance FROM g WHERE progress < 1 UNION ALL SELECT sid, 'refine_goal', 'split: ' || goal, 0.5 FROM g WHERE progress < 0.2
    UNION ALL SELECT sid, 'query', 'other ways: ' || area, 0.7 FROM a WHERE queries > 2 AND success < 0.5 UNION ALL SELECT sid, 'set_goal', 'set goals', 0.6 FROM s WHERE queries > 3 AND sid NOT IN (SELECT sid FROM g)"""
)
def session_suggestions(spark, d):
    e = B.sessions(_e(spark, d), "2 days")
    kind = F.col("event_type")
    s = e.groupBy("session_id").agg(F.count("*").alias("queries"))
    g = e.groupBy("session_id").agg((F.count_if(kind == "purchase") / 3.0).alias("progress"), F.bool_or(kind.isin("purchase", "signup")).alias("any"))
    goals = g.where("any").select("session_id", F.lit("buy").alias("goal"), "progress", F.lit(True).alias("active"))
    areas = e.groupBy("session_id", kind.alias("area")).agg(F.count("*").alias("queries"), F.avg(F.coalesce((F.col("value") >= 50).cast("double"), F.lit(0.0))).alias("success"))
    out = B.session_suggestions(s, goals, areas)
    return out.withColumn("relevance", F.round("relevance", 9))


@query(
    "WITH g AS (SELECT *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER w, 0) gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id, max(gap) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) <= 86400000000 valid FROM g"
)
def session_validation(spark, d):
    """Sessions of a day's timeout."""
    a = _e(spark, d).select(F.col("user_id").alias("session"), "ts", F.col("event_id").alias("seq"))
    return S.session_validity(a, 86400).select(F.col("seq").alias("event_id"), "valid")


@query(
    """WITH l AS (SELECT *, CASE WHEN event_type = 'error' AND value > 300 THEN 'critical' WHEN event_type = 'error' AND value > 150 THEN 'high' ELSE 'low' END severity FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000),
    a AS (SELECT count(*) total_events, count(DISTINCT user_id) active_sessions, count(*) FILTER (WHERE severity = 'critical') critical_events, count(*) FILTER (WHERE severity = 'high') high_events, count(*) FILTER (WHERE event_type = 'error') logins, count(*) FILTER (WHERE event_type = 'signup' AND value > 400) injections FROM l)
    SELECT total_events, active_sessions, critical_events, high_events, CASE WHEN critical_events > 0 THEN 'critical' WHEN high_events > 5 THEN 'high' WHEN high_events > 0 THEN 'medium' ELSE 'low' END threat_level,
    concat_ws('; ', CASE WHEN logins > 10 THEN 'lock accounts after failed logins' END, CASE WHEN injections > 0 THEN 'validate input against injection' END) advice FROM a"""
)
def security_report(spark, d):
    kind, v = F.col("event_type"), F.col("value")
    sev = F.when((kind == "error") & (v > 300), "critical").when((kind == "error") & (v > 150), "high").otherwise("low")
    told = F.when(kind == "error", "failed_login").when((kind == "signup") & (v > 400), "injection").otherwise("access")
    return S.security_report(_e(spark, d).select("ts", F.col("event_id").alias("seq"), F.col("user_id").alias("session"), sev.alias("severity"), told.alias("kind")))


RULES = [
    S.Rule("no_bots", "deny", "*", "*", (("agent", "matches", "bot[0-3]$"),)),
    S.Rule("office", "allow", "src1*", "read", (("ip", "starts_with", "10.0.1"), ("lang", "in", "en,de"))),
    S.Rule("long", "deny", "src?", "write", (("size", "greater", "2000"), ("lang", "not_equals", "en"))),
    S.Rule("short", "allow", "src*", "write", (("size", "less", "500"), ("agent", "ends_with", "8"), ("lang", "not_in", "fr,xx"))),
    S.Rule("readers", "allow", "src*", "read", (("agent", "contains", "bot"), ("action", "equals", "read"))),
]


@query(
    """SELECT doc_id, CASE WHEN regexp_matches(agent, 'bot[0-3]$') THEN 'no_bots' WHEN starts_with(source, 'src1') AND action = 'read' AND starts_with(ip, '10.0.1') AND lang IN ('en', 'de') THEN 'office'
    WHEN regexp_full_match(source, 'src.') AND action = 'write' AND n_chars > 2000 AND lang <> 'en' THEN 'long' WHEN starts_with(source, 'src') AND action = 'write' AND n_chars < 500 AND ends_with(agent, '8') AND lang NOT IN ('fr', 'xx') THEN 'short'
    WHEN starts_with(source, 'src') AND action = 'read' THEN 'readers' END AS rule FROM (SELECT doc_id, source, lang, n_chars, 'bot' || doc_id % 10 agent, '10.0.' || doc_id % 4 ip, CASE WHEN doc_id % 3 = 0 THEN 'write' ELSE 'read' END AS action FROM documents)"""
)
def policy_conditions(spark, d):
    """The first rule whose glob, action and conditions hold."""
    k = F.col("doc_id")
    action = F.when(k % 3 == 0, "write").otherwise("read")
    fields = {"agent": F.concat(F.lit("bot"), (k % 10).cast("string")), "ip": F.concat(F.lit("10.0."), (k % 4).cast("string")), "lang": F.col("lang"), "size": F.col("n_chars"), "action": action}
    return _docs(spark, d).select("doc_id", S.first_rule(RULES, F.col("source"), action, fields)["rule"].alias("rule"))


@query("SELECT conv_id, turn, 'Turn ' || turn || ' of ' || conv_id subject, role || '@example.org' sender, replace(coalesce(text, ''), chr(13) || chr(10), chr(10)) body FROM conversations WHERE role IS NOT NULL")
def mail_headers(spark, d):
    """Turns as messages with folded headers, read back."""
    c = table(spark, d, "conversations").where("role IS NOT NULL")
    head = F.concat(F.lit("from: "), "role", F.lit("@example.org\r\nSubject: Turn "), F.col("turn").cast("string"), F.lit("\r\n of "), F.col("conv_id").cast("string"), F.lit("\r\nX-Other: subject: none\r\n\r\n"))
    m = mail_fields(F.concat(head, F.coalesce("text", F.lit(""))))
    return c.select("conv_id", "turn", m["subject"].alias("subject"), m["sender"].alias("sender"), m["body"].alias("body"))
