"""Suggestions from a log of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

#: Synonyms, slips and dictionary of the suggester, and its templates.
SYNONYMS = {"search": ["find", "lookup", "query"], "file": ["document", "doc"], "image": ["picture", "photo"]}
MISTAKES = {"teh": "the", "recieve": "receive"}
DICTIONARY = ["machine", "learning", "search", "file", "document", "python", "data", "analysis"]


def log_counts(log: DataFrame) -> DataFrame:
    """(query, n, last): how often each query was asked."""
    return log.groupBy("query").agg(F.count("*").alias("n"), F.max("ts").alias("last"))


def completions(counts: DataFrame, prefixes: DataFrame, k: int = 10) -> DataFrame:
    """(prefix, query, n, confidence, rank). Prefixes meet queries on their first three characters, then by startswith."""
    key = lambda c: F.left(F.lower(c), F.lit(3))
    q = counts.withColumn("key", key(F.col("query")))
    p = prefixes.withColumn("key", key(F.col("prefix")))
    hit = q.join(p, "key").where(F.startswith(F.lower("query"), F.lower("prefix")) & (F.lower("query") != F.lower("prefix")))
    conf = 0.3 * F.length("prefix") / F.length("query") + 0.7 * F.log(F.col("n").cast("double")) / 10
    w = Window.partitionBy("prefix").orderBy(F.desc("n"), "query")
    return hit.select("prefix", "query", "n", F.round(conf, 9).alias("confidence")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def trending(log: DataFrame, as_of: Column, k: int = 20) -> DataFrame:
    """(query, heat): asks weighed by exp(-age in hours / 24)."""
    hours = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 3_600_000_000
    return log.groupBy("query").agg(F.round(F.sum(F.exp(-hours / 24)), 9).alias("heat")).orderBy(F.desc("heat"), "query").limit(k)


def corrections(words: DataFrame, dictionary: DataFrame, most: int = 2) -> DataFrame:
    """(word, correction, distance): dictionary words one or two edits away, for words of three characters or more.

    Two edits leave a character bigram of words of six or more characters in place, and a character of
    shorter ones, so candidates meet on those and the dictionary isn't held against every word."""
    keys = lambda c: F.array_union(T.chargrams(c, 2), F.when(F.length(c) <= 7, T.chargrams(c, 1)).otherwise(F.array().cast("array<string>")))
    words, dictionary = (x.where(F.length("word") >= 3) for x in (words, dictionary))
    w = words.select("word", F.explode(keys(F.col("word"))).alias("gram"))
    d = dictionary.select(F.col("word").alias("correction"), F.explode(keys(F.col("word"))).alias("gram"))
    near = w.join(d, "gram").where(F.abs(F.length("word") - F.length("correction")) <= most).select("word", "correction").distinct()
    return near.withColumn("distance", F.levenshtein("word", "correction", most)).where((F.col("distance") >= 1) & (F.col("distance") <= most))


def expanded(queries: DataFrame) -> DataFrame:
    """(query, suggestion, score): each known word replaced by each synonym."""
    known = F.create_map(*[x for k, v in SYNONYMS.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    w = queries.select("query", F.explode(F.array_distinct(F.split(F.lower("query"), r"\s+"))).alias("word"))
    s = w.select("query", "word", F.explode(F.element_at(known, F.col("word"))).alias("synonym"))
    return s.select("query", F.replace(F.lower("query"), F.col("word"), F.col("synonym")).alias("suggestion"), F.lit(0.8).alias("score"))


def gram_index(queries: DataFrame, n: int) -> DataFrame:
    g = queries.select("query", F.explode(F.array_distinct(T.chargrams(F.lower("query"), n))).alias("gram"))
    return g.groupBy("gram").agg(F.array_sort(F.collect_set("query")).alias("queries"))


def learned_patterns(queries: DataFrame) -> DataFrame:
    """(pattern, n): first and last word of longer queries with a gap between."""
    w = F.split(F.lower("query"), r"\s+")
    return queries.where(F.size(w) >= 3).select(F.concat(F.element_at(w, 1), F.lit(" {} "), F.element_at(w, -1)).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n"))


def ranked(s: DataFrame, k: int = 10) -> DataFrame:
    """s(query, suggestion, kind, personal, n, context, similarity): one row a suggestion, best first."""
    base = 0.35 * F.col("personal") + 0.25 * F.log(F.col("n").cast("double") + 1) / 10 + 0.25 * F.col("context") + 0.15 * F.col("similarity")
    lift = F.when(F.col("kind") == "correction", 1.2).when(F.col("kind") == "trending", 1.1).otherwise(1.0)
    best = s.withColumn("score", F.round(base * lift, 9)).groupBy("query", "suggestion").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "suggestion")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def similar_queries(queries: DataFrame, least: float = 0.3) -> DataFrame:
    """(a, b, similarity): queries that share more than least of their words; they meet on shared words only.

    Words that most queries share are left to the aggregation, which adds partial sums first."""
    t = queries.select("query_id", F.explode(F.array_distinct(T.ascii_tokens(F.col("query")))).alias("word"))
    n = t.groupBy("query_id").agg(F.count("*").alias("n"))
    a, b = t.withColumnRenamed("query_id", "a"), t.withColumnRenamed("query_id", "b")
    both = a.join(b, "word").where("a < b").groupBy("a", "b").agg(F.count("*").alias("c"))
    both = both.join(n.select(F.col("query_id").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("query_id").alias("b"), F.col("n").alias("nb")), "b")
    return both.select("a", "b", F.round(F.col("c") / (F.col("na") + F.col("nb") - F.col("c")), 9).alias("similarity")).where(F.col("similarity") > least)
