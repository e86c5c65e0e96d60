"""Lexical search: postings with positions, BM25, prefix, phrase and boolean matches.

Queries come in as a table (query_id, term), so a batch of queries is one plan. ``bm25`` scores a table of texts
that has no index, in passes over the texts; ``inverted`` stores postings, and its searches read those of their terms only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

K1, B = 1.2, 0.75  # fixed values of the usual ranking function


def postings(docs: DataFrame, tokens: Column | None = None, key: str = "doc_id") -> DataFrame:
    """(term, key, tf, positions); positions count from 0.

    Texts are dealt by key, so that only they are shuffled, not their words."""
    tokens = T.ascii_tokens(F.coalesce("text", F.lit(""))) if tokens is None else tokens
    flat = docs.repartition(key).select(key, F.posexplode(tokens).alias("pos", "term"))
    return flat.groupBy("term", key).agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))


def lengths(docs: DataFrame, tokens: Column | None = None, key: str = "doc_id") -> DataFrame:
    tokens = T.ascii_tokens(F.coalesce("text", F.lit(""))) if tokens is None else tokens
    return docs.select(key, F.size(tokens).alias("len"))


def bm25(docs: DataFrame, queries: DataFrame, k: int | None = 20, tokens: Column | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank) for ``queries(query_id, term)``.

    Term frequencies of the asked terms are counted in one pass over the texts; the two numbers that
    describe the collection are one row. Ties go to the smaller doc_id."""
    tokens = T.ascii_tokens(F.coalesce("text", F.lit(""))) if tokens is None else tokens
    asked = queries.select("query_id", "term").distinct()
    words = docs.select("doc_id", F.size(tokens).alias("len"), tokens.alias("tokens"))
    corpus = words.agg(F.count("*").alias("n"), F.avg("len").alias("mean_len"))
    tf = words.select("doc_id", "len", F.explode("tokens").alias("term")).join(asked.select("term").distinct(), "term", "left_semi").groupBy("term", "doc_id", "len").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    return ranked(tf.join(df, "term").join(asked, "term"), corpus, k)


def ranked(found: DataFrame, corpus: DataFrame, k: int | None) -> DataFrame:
    """The best documents of each query from (query_id, term, doc_id, len, tf, df) and the one row (n, mean_len)."""
    return top_k(scored(found, corpus), k)


def scored(found: DataFrame, corpus: DataFrame, boost: Column | float = 1.0) -> DataFrame:
    """(query_id, doc_id, score) of all documents that hold an asked term."""
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    score = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean_len")))
    hits = found.crossJoin(F.broadcast(corpus))  # corpus is one row
    return hits.withColumn("s", score * boost).groupBy("query_id", "doc_id").agg(F.sum("s").alias("score"))


def top_k(scored: DataFrame, k: int | None) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id")
    out = scored.withColumn("rank", F.row_number().over(w))
    return out if k is None else out.where(F.col("rank") <= k)


def prefix_matches(docs: DataFrame, prefix: str) -> DataFrame:
    tokens = T.ascii_tokens(F.coalesce("text", F.lit("")))
    return docs.select("doc_id", F.size(F.filter(tokens, lambda t: t.startswith(prefix))).alias("hits")).where("hits > 0")


def phrase_matches(posts: DataFrame, phrase: list[str], key: str = "doc_id") -> DataFrame:
    """(key, hits): places where the words follow each other, by arithmetic on positions."""
    wanted = posts.where(F.col("term").isin(phrase))
    own_row = [key, *(c for c in ("len",) if c in posts.columns)]  # stored postings keep rows of one key apart by their length
    starts = None
    for i, w in enumerate(phrase):
        own = wanted.where(F.col("term") == w).select(*own_row, F.expr(f"transform(positions, p -> p - {i})").alias(f"p{i}"))
        starts = own if starts is None else starts.join(own, own_row)
    both = F.col("p0")
    for i in range(1, len(phrase)):
        both = F.array_intersect(both, F.col(f"p{i}"))
    return starts.select(key, F.size(both).alias("hits")).where("hits > 0")


def all_of(posts: DataFrame, terms: list[str], key: str = "doc_id") -> DataFrame:
    n = len(set(terms))
    return posts.where(F.col("term").isin(terms)).groupBy(key).agg(F.countDistinct("term").alias("n")).where(F.col("n") == n).select(key)


def any_of(posts: DataFrame, terms: list[str], key: str = "doc_id") -> DataFrame:
    return posts.where(F.col("term").isin(terms)).select(key).distinct()
