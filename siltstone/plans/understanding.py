"""Query understanding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import understand as U
from .catalog import query, table
from .fusion import ASKED_SQL, asked_queries

WS = "[ \\t\\n\\x0B\\f\\r]"
NORMAL = f"""trim(regexp_replace(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}} \\t\\n\\x0B\\f\\r.,!?\\-_()\\[\\]{{}}"'']', '', 'g'), '{WS}+', ' ', 'g'), ' ')"""
KEYWORDS = "VALUES " + ", ".join(f"('{i}', '{k}', {len(k.split())})" for i, ks in U.INTENT_KEYWORDS.items() for k in ks)
INTENTS = f"""WITH q AS (SELECT query_id, {NORMAL} q FROM ({ASKED_SQL})), k(intent, keyword, n) AS ({KEYWORDS}),
p AS (SELECT query_id, intent, sum(length(keyword) / length(q) * n) score, count(*) m, sum(length(keyword) / length(q)) cov FROM q JOIN k ON contains(q, keyword) GROUP BY 1, 2),
b AS (SELECT query_id, intent, least(1.0, score * sqrt(m) + least(cov, 0.3)) c FROM p WHERE least(1.0, score * sqrt(m) + least(cov, 0.3)) >= CASE WHEN intent IN ('QuestionAnswering', 'SimilaritySearch') THEN 0.2 ELSE 0.5 END),
f AS (SELECT query_id, intent, least(1.0, sum(c)) confidence FROM (SELECT * FROM b UNION ALL SELECT query_id, 'QuestionAnswering', 0.3 FROM q WHERE regexp_matches(q, '{U.QUESTION}') UNION ALL SELECT query_id, 'SimilaritySearch', 0.4 FROM q WHERE regexp_matches(q, '{U.SIMILARITY}')) GROUP BY 1, 2)
SELECT * FROM f UNION ALL SELECT query_id, CASE WHEN regexp_matches(q, 'file|document') THEN 'DocumentSearch' ELSE 'ContentSearch' END, CASE WHEN regexp_matches(q, 'file|document') THEN 0.6 ELSE 0.5 END FROM q WHERE query_id NOT IN (SELECT query_id FROM f)"""


@query(f"SELECT query_id, intent, round(confidence, 6) confidence FROM ({INTENTS})")
def query_intents(spark, d):
    return U.intents(asked_queries(spark, d)).select("query_id", "intent", F.round("confidence", 6).alias("confidence"))


@query(f"SELECT query_id, {NORMAL} normalised FROM ({ASKED_SQL})")
def query_normalised(spark, d):
    return asked_queries(spark, d).select("query_id", U.normalised(F.col("text")).alias("normalised"))


WORD_LIST = "regexp_extract_all(lower(text), '[a-z0-9_]+')"


def _found(intent):
    line = f"(' ' || coalesce(array_to_string({WORD_LIST}, ' '), '') || ' ')"
    asked = [f" {p} " for p in U.SECOND_PHRASES[intent]] + [f" {p}" for p in U.SECOND_STEMS.get(intent, ())]
    return " + ".join(f"CAST(contains({line}, '{p}') AS INT)" for p in asked)


def _holds(words):
    return f"len(list_intersect({WORD_LIST}, [{', '.join(f'{chr(39)}{w}{chr(39)}' for w in words)}])) > 0"


TYPES = f"list_sort(list_filter([{', '.join(f'CASE WHEN {_holds(ws)} THEN {chr(39)}{t}{chr(39)} END' for t, ws in U.TYPE_WORDS.items())}], lambda x: x IS NOT NULL))"
SECOND = f"""SELECT query_id, list_transform(list_sort(list_filter([{", ".join(f"{{'s': -({_found(i)}), 'i': '{i}'}}" for i in U.SECOND_PHRASES)}], lambda x: x.s < 0))[1:CASE WHEN {_holds(U.JOINING_WORDS)} THEN 3 ELSE 2 END], lambda x: x.i) intents,
CASE WHEN {" + ".join(map(_found, U.SECOND_PHRASES))} > 0 THEN 0.8 ELSE 0.3 END confidence,
CASE WHEN {_holds(U.JOINING_WORDS)} THEN 'compound' WHEN contains(text, '?') THEN 'conversational' WHEN {_holds(U.SECOND_PHRASES["Filter"])} THEN 'filter' WHEN length(text) > 50 THEN 'exploratory' ELSE 'simple' END query_type FROM ({ASKED_SQL})"""


@query(SECOND)
def query_intents_second(spark, d):
    return U.second_intents(asked_queries(spark, d))


@query(f"SELECT query_id, {TYPES} types FROM ({ASKED_SQL})")
def query_file_types(spark, d):
    return asked_queries(spark, d).select("query_id", U.file_types(F.col("text")).alias("types"))


TIME_TEXTS = ["files from today", "Mails of YESTERDAY, please", "due tomorrow?", "recently changed", "the last day", "past week", "previous month and this month", "last   year", "current week or this year", "3 days ago", "notes of 2 weeks ago and 10 months ago", "1 year ago", "no time, lastly weekly"]
DAY = "DATE '2024-01-31'"


@query(
    f"""WITH t AS (SELECT query_id, ' ' || coalesce(array_to_string({WORD_LIST}, ' '), '') || ' ' line FROM ({ASKED_SQL} UNION ALL SELECT 1000000 + conv_id * 1000 + turn, text FROM conversations UNION ALL SELECT -100 - (row_number() OVER ()), x FROM (SELECT unnest({TIME_TEXTS!r}) x))),
    u(unit, days) AS (VALUES ('day', 1), ('week', 7), ('month', 30), ('year', 365)),
    r(e, p, a, b) AS (SELECT 'today', ' today ', {DAY}, {DAY} + 1 UNION ALL SELECT 'yesterday', ' yesterday ', {DAY} - 1, {DAY} UNION ALL SELECT 'tomorrow', ' tomorrow ', {DAY} + 1, {DAY} + 2 UNION ALL SELECT 'recent', ' recent(ly)? ', {DAY} - 7, {DAY} + 1
      UNION ALL SELECT unit, ' (last|past|previous) ' || unit || ' ', {DAY} - CAST(days AS INTEGER), {DAY} + 1 FROM u
      UNION ALL SELECT 'this ' || unit, ' (this|current) ' || unit || ' ', CAST(date_trunc(unit, {DAY}) AS DATE), CAST(date_trunc(unit, {DAY}) + CASE unit WHEN 'day' THEN INTERVAL 1 DAY WHEN 'week' THEN INTERVAL 7 DAY WHEN 'month' THEN INTERVAL 1 MONTH ELSE INTERVAL 1 YEAR END AS DATE) FROM u),
    g AS (SELECT query_id, unnest(regexp_extract_all(line, ' [0-9]{{1,4}} (?:day|week|month|year)s? ago')) m FROM t)
    SELECT query_id, e AS expression, a AS since, b AS until FROM t, r WHERE regexp_matches(line, p)
    UNION ALL SELECT query_id, 'ago', d, d + 1 FROM (SELECT DISTINCT query_id, {DAY} - CAST(regexp_extract(m, '[0-9]+') AS INTEGER) * CAST(days AS INTEGER) d FROM g JOIN u ON contains(m, unit))"""
)
def query_time_spans(spark, d):
    """Times named in the stated queries, the benchmark's items, turns of conversations and stated texts."""
    turns = table(spark, d, "conversations").select((1000000 + F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")
    own = spark.createDataFrame([(-101 - i, t) for i, t in enumerate(TIME_TEXTS)], "query_id long, text string")
    return U.time_spans(asked_queries(spark, d).select("query_id", "text").union(turns).union(own), "2024-01-31")


SLIPS = [("find teh file",), ("I recieve seperate docs",), ("definately occured, teh end",)]


@query(
    """SELECT q, array_to_string(list_transform(regexp_split_to_array(q, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: coalesce(map_extract(MAP {'teh': 'the', 'recieve': 'receive', 'seperate': 'separate', 'definately': 'definitely', 'occured': 'occurred'}, regexp_replace(lower(w), '[^a-z]', '', 'g'))[1], w)), ' ') corrected
    FROM (SELECT text q FROM conversations UNION ALL SELECT text FROM benchmark UNION ALL VALUES ('find teh file'), ('I recieve seperate docs'), ('definately occured, teh end')) WHERE q IS NOT NULL"""
)
def query_corrections(spark, d):
    """Usual slips mended in turns of conversations, items of the benchmark and stated texts."""
    q = table(spark, d, "conversations").select("text").union(table(spark, d, "benchmark").select("text")).toDF("q").union(spark.createDataFrame(SLIPS, "q string"))
    return q.where("q IS NOT NULL").select("q", U.corrected(F.col("q")).alias("corrected"))


@query(f"SELECT query_id, flatten(list_transform(list_filter(regexp_split_to_array(lower(text), '{WS}+'), lambda w: w IN ('doc', 'pic', 'vid', 'find', 'show')), lambda w: CASE w WHEN 'doc' THEN ['document', 'docx'] WHEN 'pic' THEN ['picture', 'image'] WHEN 'vid' THEN ['video', 'movie'] WHEN 'find' THEN ['search', 'locate'] ELSE ['display', 'list'] END))[1:3] expansions FROM ({ASKED_SQL})")
def query_expansions(spark, d):
    return asked_queries(spark, d).select("query_id", U.expansions(F.col("text")).alias("expansions"))


@query()
def query_entities(spark, d):
    """Entities with their places; checked against cases in the tests."""
    return U.entities(asked_queries(spark, d))


@query()
def query_strategies(spark, d):
    return U.strategies(asked_queries(spark, d), "2024-01-31")


@query("SELECT lower(trim(text)) k, sha256(lower(trim(text))) cache_key, count(*) asked FROM conversations WHERE length(trim(text)) >= 3 GROUP BY 1")
def classifier_cache(spark, d):
    """One classification for queries that are equal when trimmed and lower-cased."""
    from .catalog import table

    c = table(spark, d, "conversations").select(F.lower(F.trim("text")).alias("k")).where(F.length("k") >= 3)
    return c.groupBy("k").agg(F.count("*").alias("asked")).select("k", F.sha2("k", 256).alias("cache_key"), "asked")
