"""Sanitising, validation, limits and access."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import security as S
from .catalog import query, table


def _docs(spark, d):
    return table(spark, d, "documents")


@query("SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) escaped FROM pages")
def html_escape(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(S.html_escaped(F.col("html")), 256).alias("escaped"))


@query("""SELECT doc_id, sha256(CASE WHEN regexp_matches(c, '[",\\n\\r]') THEN '"' || replace(c, '"', '""') || '"' ELSE c END) escaped FROM (SELECT doc_id, CASE WHEN regexp_matches(text, '^[=+@-]') THEN '''' || text ELSE text END c FROM documents)""")
def csv_escape(spark, d):
    return _docs(spark, d).select("doc_id", F.sha2(S.csv_escaped(F.col("text")), 256).alias("escaped"))


def _without(c, pattern, mark=""):
    return "regexp_replace({}, '{}', '{}', 'g')".format(c, pattern.replace("'", "''"), mark)


CONTROL = r"[\x00-\x1f\x{7f}-\x{9f}]"


@query(f"SELECT page_id, sha256({_without(_without('html', S.CONTROLS), S.XML_OUTSIDE, S.BLOCKED)}) clean FROM pages")
def xml_sanitised(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(S.xml_sanitised(F.col("html")), 256).alias("clean"))


@query(f"SELECT doc_id, sha256({_without(_without('text', CONTROL), S.COMMAND_CHAINS, S.BLOCKED)}) command, CASE WHEN regexp_matches({_without('text', CONTROL)}, '{S.SLOW_REGEX}') THEN '{S.BLOCKED}' ELSE substr({_without('text', CONTROL)}, 1, {S.REGEX_LENGTH}) END AS expression FROM documents")
def command_and_regex_sanitised(spark, d):
    t = F.col("text")
    return _docs(spark, d).select("doc_id", F.sha2(S.command_sanitised(t), 256).alias("command"), S.regex_sanitised(t).alias("expression"))


def _any(c):
    return "(" + " OR ".join("regexp_matches({}, '{}')".format(c, p.replace("'", "''")) for p in S.UNSAFE) + ")"


def _block(c):
    for p in S.UNSAFE:
        c = "regexp_replace({}, '{}', '[BLOCKED]', 'g')".format(c, p.replace("'", "''"))
    return c


@query(f"SELECT page_id, {_any('html')} unsafe, len(regexp_extract_all({_block('html')}, '\\[BLOCKED')) blocked FROM pages")
def unsafe_content(spark, d):
    h = F.col("html")
    return table(spark, d, "pages").select("page_id", S.unsafe(h).alias("unsafe"), F.regexp_count(S.blocked(h), F.lit(r"\[BLOCKED")).alias("blocked"))


@query(
    f"""SELECT page_id, round(greatest(0, least(100, 100.0 - len(regexp_extract_all(c, '\\[BLOCKED')) * 10 - CASE WHEN strlen(c) < strlen(html) THEN (1 - strlen(c) / strlen(html)) * 20 ELSE 0 END - len(regexp_extract_all(html, '[\\x00-\\x1f\\x7f-\\x{{9f}}]')) * 5)), 6) safety FROM (SELECT page_id, html, {_block('html')} c FROM pages)"""
)
def sanitisation_report(spark, d):
    h = F.col("html")
    return table(spark, d, "pages").select("page_id", F.round(S.safety(h, S.blocked(h)), 6).alias("safety"))


@query("SELECT page_id, regexp_replace(regexp_replace(url, '\\.\\.+[/\\\\]?', '', 'g'), '[<>:\"|?*\\x00-\\x1f]', '_', 'g') path FROM pages")
def safe_paths(spark, d):
    return table(spark, d, "pages").select("page_id", S.safe_path(F.col("url")).alias("path"))


@query("SELECT c_custkey, least(length(c_name) * 4, 40) + 15 * (CAST(regexp_matches(c_name, '[a-z]') AS INT) + CAST(regexp_matches(c_name, '[A-Z]') AS INT) + CAST(regexp_matches(c_name, '[0-9]') AS INT) + CAST(regexp_matches(c_name, '[^A-Za-z0-9]') AS INT)) score FROM customer")
def password_scores(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.password_score(F.col("c_name")).alias("score"))


def _requests(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("client"), "ts", F.col("event_id").alias("seq"))


@query()
def rate_limits(spark, d):
    """Refusals that block; checked against a plain loop in the tests."""
    return S.rate_limited(_requests(spark, d), 3, 3600, 2, 600, 3600)


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 MINUTE PRECEDING AND CURRENT ROW) recent FROM events")
def sliding_rate(spark, d):
    """Requests of a client in the last hour, by a range frame."""
    from pyspark.sql.window import Window

    e = table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(-3_600_000_000, 0)
    return e.select("event_id", F.count("*").over(w).alias("recent"))


POLICIES = [(1, "deny", "guest", "src1*", ["read", "write"]), (2, "allow", "*", "src*", ["read"]), (3, "allow", "editor", "src*", ["write"]), (3, "deny", "editor", "src2", ["write"])]


@query(
    """WITH r AS (SELECT doc_id request_id, CASE doc_id % 3 WHEN 0 THEN 'guest' WHEN 1 THEN 'editor' ELSE 'viewer' END role, source resource, CASE WHEN doc_id % 2 = 0 THEN 'read' ELSE 'write' END action FROM documents),
    p(priority, effect, role, pat, acts) AS (VALUES (1, 'deny', 'guest', '^src1.*$', ['read', 'write']), (2, 'allow', '*', '^src.*$', ['read']), (3, 'allow', 'editor', '^src.*$', ['write']), (3, 'deny', 'editor', '^src2$', ['write']))
    SELECT r.request_id, coalesce(arg_min(p.effect, p.priority * 10 + CASE WHEN p.effect = 'deny' THEN 0 ELSE 1 END), 'not_applicable') decision FROM r LEFT JOIN p ON (p.role = '*' OR p.role = r.role) AND regexp_matches(r.resource, p.pat) AND list_contains(p.acts, r.action) GROUP BY 1"""
)
def access_decisions(spark, d):
    k = F.col("doc_id") % 3
    r = _docs(spark, d).select(F.col("doc_id").alias("request_id"), F.when(k == 0, "guest").when(k == 1, "editor").otherwise("viewer").alias("role"), F.col("source").alias("resource"), F.when(F.col("doc_id") % 2 == 0, "read").otherwise("write").alias("action"))
    return S.decisions(r, spark.createDataFrame(POLICIES, "priority int, effect string, role string, glob string, actions array<string>"))


GRANTS = "SELECT 'supplier ' || s_suppkey AS role, n_name AS parent FROM supplier JOIN nation ON n_nationkey = s_nationkey UNION ALL SELECT n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT r_name, 'everyone' FROM region"


@query(f"WITH RECURSIVE p(role, parent) AS ({GRANTS}), r(role, inherits) AS (SELECT role, parent FROM p UNION SELECT r.role, p.parent FROM r JOIN p ON p.role = r.inherits) SELECT role, inherits FROM r")
def role_inheritance(spark, d):
    """Suppliers have the rights of their nation, nations those of their region, regions those of everyone."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    of_suppliers = table(spark, d, "supplier").join(n, F.col("n_nationkey") == F.col("s_nationkey")).select(F.concat(F.lit("supplier "), F.col("s_suppkey").cast("string")).alias("role"), F.col("n_name").alias("parent"))
    of_nations = n.join(r, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("n_name").alias("role"), F.col("r_name").alias("parent"))
    return S.role_closure(spark, of_suppliers.union(of_nations).union(r.select(F.col("r_name").alias("role"), F.lit("everyone").alias("parent"))))


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'error') violations, CASE WHEN count(*) FILTER (WHERE event_type = 'error') <= 2 THEN 'low' WHEN count(*) FILTER (WHERE event_type = 'error') <= 5 THEN 'medium' WHEN count(*) FILTER (WHERE event_type = 'error') <= 10 THEN 'high' ELSE 'critical' END severity FROM events GROUP BY 1")
def violation_severity(spark, d):
    v = F.count_if(F.col("event_type") == "error")
    return table(spark, d, "events").groupBy("user_id").agg(v.alias("violations")).select("user_id", "violations", S.severity(F.col("violations")).alias("severity"))


@query("SELECT user_id, count(*) errors FROM events WHERE event_type = 'error' GROUP BY 1 HAVING count(*) > 10")
def incident_detection(spark, d):
    return table(spark, d, "events").where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("errors")).where("errors > 10")


@query("SELECT event_id, hour(ts) BETWEEN 8 AND 17 AND dayofweek(ts) BETWEEN 1 AND 5 AS allowed FROM events")
def time_restriction(spark, d):
    """Working hours of working days (Sunday is 0)."""
    ts = F.col("ts")
    return table(spark, d, "events").select("event_id", (F.hour(ts.cast("timestamp")).between(8, 17) & (F.dayofweek(ts) - 1).between(1, 5)).alias("allowed"))


@query("SELECT event_id FROM events WHERE event_type IN ('error', 'purchase') AND NOT contains(props, '\"k\": 1') AND (value IS NULL OR value >= 10) AND regexp_matches(props, '[0-9]{2}')")
def log_filters(spark, d):
    """Level, block before allow, least duration (a null passes), pattern."""
    return table(spark, d, "events").where(F.col("event_type").isin("error", "purchase") & ~F.col("props").contains('"k": 1') & (F.coalesce(F.col("value"), F.lit(10.0)) >= 10) & F.col("props").rlike("[0-9]{2}")).select("event_id")
