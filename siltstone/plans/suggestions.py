"""Suggestions. The log of queries is events: event type and the key of its properties."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import suggest as S
from .catalog import query, table
from .search import DOCS
from .texts import TOKENS

LOG = "SELECT event_type || ' ' || json_extract_string(props, '$.k') query, ts, user_id FROM events"
AS_OF = "2024-01-31 00:00:00"


def log(spark, d):
    return table(spark, d, "events").select(F.concat_ws(" ", "event_type", F.get_json_object("props", "$.k")).alias("query"), "ts", "user_id")


PREFIXES = ["cli", "click 1", "view 2", "pur", "signup 9", "err"]


@query(
    f"""WITH c AS (SELECT query, count(*) n FROM ({LOG}) GROUP BY 1), p(prefix) AS (SELECT unnest({PREFIXES}))
    SELECT prefix, query, n, round(0.3 * length(prefix) / length(query) + 0.7 * ln(n) / 10, 9) confidence, CAST(row_number() OVER (PARTITION BY prefix ORDER BY n DESC, query) AS INTEGER) AS rank FROM c JOIN p ON starts_with(query, prefix) AND query <> prefix
    QUALIFY row_number() OVER (PARTITION BY prefix ORDER BY n DESC, query) <= 10"""
)
def prefix_completions(spark, d):
    p = spark.createDataFrame([(x,) for x in PREFIXES], "prefix string")
    return S.completions(S.log_counts(log(spark, d)), p)


@query(f"SELECT query, round(sum(exp(-epoch(TIMESTAMP '{AS_OF}' - ts) / 3600.0 / 24)), 9) heat FROM ({LOG}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def trending_queries(spark, d):
    return S.trending(log(spark, d), F.lit(AS_OF))


WORDS = f"SELECT DISTINCT unnest({TOKENS.format('text')}) word FROM benchmark"
DICTIONARY = f"SELECT term word FROM (SELECT unnest(list_distinct(t)) term FROM ({DOCS})) GROUP BY 1 HAVING count(*) >= 40"


@query(f"SELECT a.word, b.word correction, levenshtein(a.word, b.word) distance FROM ({WORDS}) a JOIN ({DICTIONARY}) b ON abs(length(a.word) - length(b.word)) <= 2 WHERE length(a.word) >= 3 AND length(b.word) >= 3 AND levenshtein(a.word, b.word) BETWEEN 1 AND 2")
def typo_corrections(spark, d):
    """Words of the stated queries against the words of many documents."""
    words = table(spark, d, "benchmark").select(F.explode(T.ascii_tokens(F.col("text"))).alias("word")).distinct()
    often = table(spark, d, "documents").select(F.explode(F.array_distinct(T.ascii_tokens(F.coalesce("text", F.lit(""))))).alias("word")).groupBy("word").count().where("count >= 40").select("word")
    return S.corrections(words, often)


ASKED = ["search file", "find image", "machine learning file", "image search"]


@query(
    """SELECT q AS query, replace(lower(q), w, s) suggestion, 0.8 score FROM (SELECT q, unnest(list_distinct(regexp_split_to_array(lower(q), '[ \\t\\n\\x0B\\f\\r]+'))) w FROM (SELECT unnest(['search file', 'find image', 'machine learning file', 'image search']) q UNION ALL SELECT text FROM conversations UNION ALL SELECT text FROM benchmark)) a
    JOIN (VALUES ('search', 'find'), ('search', 'lookup'), ('search', 'query'), ('file', 'document'), ('file', 'doc'), ('image', 'picture'), ('image', 'photo')) v(k, s) ON k = w"""
)
def synonym_suggestions(spark, d):
    """Stated queries, turns of conversations and items of the benchmark with each known word replaced."""
    stated = spark.createDataFrame([(x,) for x in ASKED], "query string")
    return S.expanded(stated.union(table(spark, d, "conversations").select("text")).union(table(spark, d, "benchmark").select("text")))


@query(f"SELECT gram, list_sort(list(DISTINCT query)) queries FROM (SELECT query, unnest(list_transform(range(1, length(query) - 1), lambda i: substr(query, i, 3))) gram FROM ({LOG})) GROUP BY 1")
def ngram_index(spark, d):
    return S.gram_index(log(spark, d).select("query").distinct(), 3)


@query("SELECT pattern, count(*) n FROM (SELECT w[1] || ' {} ' || w[len(w)] pattern FROM (SELECT regexp_split_to_array(lower(text), '[ \\t\\n\\x0B\\f\\r]+') w FROM benchmark) WHERE len(w) >= 3) GROUP BY 1")
def pattern_learning(spark, d):
    return S.learned_patterns(table(spark, d, "benchmark").select(F.col("text").alias("query")))


@query(
    """WITH t AS (SELECT item_id query_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> ''))) word FROM benchmark), n AS (SELECT query_id, count(*) n FROM t GROUP BY 1),
    c AS (SELECT a.query_id a, b.query_id b, count(*) c FROM t a JOIN t b ON a.word = b.word AND a.query_id < b.query_id GROUP BY 1, 2) SELECT a, b, round(c / (x.n + y.n - c), 9) similarity FROM c JOIN n x ON x.query_id = a JOIN n y ON y.query_id = b WHERE round(c / (x.n + y.n - c), 9) > 0.1"""
)
def similar_past_queries(spark, d):
    return S.similar_queries(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), 0.1)


@query(f"SELECT query, count(*) n, count(DISTINCT user_id) users, max(ts) last_ts FROM ({LOG}) GROUP BY 1")
def popular_queries(spark, d):
    return log(spark, d).groupBy("query").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.max("ts").alias("last_ts"))


@query()
def ranked_suggestions(spark, d):
    """Completions, trends and synonyms for the stated queries, ranked together."""
    done = prefix_completions(spark, d).select(F.col("prefix").alias("query"), F.col("query").alias("suggestion"), F.lit("completion").alias("kind"), F.lit(0.0).alias("personal"), "n", F.lit(0.0).alias("context"), F.col("confidence").alias("similarity"))
    hot = trending_queries(spark, d).select(F.lit("cli").alias("query"), F.col("query").alias("suggestion"), F.lit("trending").alias("kind"), F.lit(0.0).alias("personal"), F.lit(1).cast("long").alias("n"), F.lit(0.0).alias("context"), F.least(F.col("heat"), F.lit(1.0)).alias("similarity"))
    syn = synonym_suggestions(spark, d).select("query", "suggestion", F.lit("synonym").alias("kind"), F.lit(0.0).alias("personal"), F.lit(1).cast("long").alias("n"), F.lit(0.0).alias("context"), F.col("score").alias("similarity"))
    return S.ranked(done.unionByName(hot).unionByName(syn))
