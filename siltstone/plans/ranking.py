"""Ranking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rank as R
from .catalog import query, table
from .search import BATCH_TERMS, bm25_batch, bm25_sql

AS_OF = "2024-01-31"
FEATURES = f"""SELECT d.doc_id, d.n_chars, coalesce(l.quality, 0.5) quality, least(coalesce(u.n, 0) / 10, 1.0) frequency, coalesce(exp(-date_diff('day', u.last, DATE '{AS_OF}') / 30.0), 0.0) recency,
  least(d.n_chars / 5000, 1.0) "text", coalesce(abs(CAST(e.embedding[1] AS DOUBLE)), 0.0) vector, exp(-power(ln(d.n_chars / 1048576 + 1) - 2, 2) / 4) size_factor
FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN (SELECT CAST(json_extract(props, '$.k') AS BIGINT) doc_id, count(*) n, max(CAST(ts AS DATE)) "last" FROM events GROUP BY 1) u USING (doc_id) LEFT JOIN embeddings e ON e.vec_id = d.doc_id"""


def features(spark, d):
    used = table(spark, d, "events").select(F.get_json_object("props", "$.k").cast("long").alias("doc_id"), F.to_date("ts").alias("day")).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("day").alias("last"))
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.abs(F.element_at("embedding", 1)).cast("double").alias("v"))
    docs = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left").join(used, "doc_id", "left").join(e, "doc_id", "left")
    days = F.datediff(F.to_date(F.lit(AS_OF)), "last")
    return docs.select(
        "doc_id", "n_chars", F.coalesce(F.col("quality").cast("double"), F.lit(0.5)).alias("quality"), R.frequency(F.coalesce("n", F.lit(0))).alias("frequency"),
        F.coalesce(R.recency(days), F.lit(0.0)).alias("recency"), F.least(F.col("n_chars") / 5000, F.lit(1.0)).alias("text"), F.coalesce("v", F.lit(0.0)).alias("vector"), R.size_factor(F.col("n_chars")).alias("size_factor"),
    )


@query(FEATURES)
def ranking_features(spark, d):
    return features(spark, d)


PREDICTED = 'greatest(0, least(1, "text" * 0.4 + vector * 0.3 + recency * 0.15 + quality * 0.1 + frequency * 0.05))'


@query(f"SELECT doc_id, round({PREDICTED}, 9) score, CAST(row_number() OVER (ORDER BY round({PREDICTED}, 9) DESC, doc_id) AS INTEGER) AS rank FROM ({FEATURES}) QUALIFY row_number() OVER (ORDER BY round({PREDICTED}, 9) DESC, doc_id) <= 50")
def linear_ranking(spark, d):
    """Top 50 by the linear model."""
    s = features(spark, d).select("doc_id", F.round(R.predicted(), 9).alias("score")).orderBy(F.desc("score"), "doc_id").limit(50)
    from pyspark.sql.window import Window

    return s.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))


@query(
    f"""SELECT doc_id, list_transform(list_sort([{{'v': -"text" * 0.4, 'n': 'text'}}, {{'v': -vector * 0.3, 'n': 'vector'}}, {{'v': -recency * 0.15, 'n': 'recency'}}, {{'v': -quality * 0.1, 'n': 'quality'}}, {{'v': -frequency * 0.05, 'n': 'frequency'}}])[1:3], lambda x: x.n) reasons FROM ({FEATURES})"""
)
def ranking_reasons(spark, d):
    return features(spark, d).select("doc_id", R.explained().alias("reasons"))


TYPES = "(ARRAY['pdf', 'doc', 'txt', 'jpg', 'md'])[1 + doc_id % 5]"


@query(f"SELECT doc_id, {TYPES} kind, CASE {TYPES} WHEN 'pdf' THEN 0.8 WHEN 'doc' THEN 0.7 WHEN 'txt' THEN 0.6 WHEN 'jpg' THEN 0.5 ELSE 0.4 END preference, CASE {TYPES} WHEN 'md' THEN 0.85 WHEN 'jpg' THEN 0.3 ELSE 0.95 END alignment FROM documents")
def type_preferences(spark, d):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("pdf", "doc", "txt", "jpg", "md")]), (F.col("doc_id") % 5 + 1).cast("int"))
    k = table(spark, d, "documents").select("doc_id", kind.alias("kind"))
    return k.select("doc_id", "kind", R.type_preference(F.col("kind")).alias("preference"), R.alignment(F.lit("DocumentSearch"), F.col("kind")).alias("alignment"))


@query()
def mmr_diversity(spark, d):
    """Greedy choice among the fifty best of each language; checked against a plain loop in the tests."""
    f = features(spark, d).withColumn("relevance", F.round(R.predicted(), 9)).join(table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id")
    q = F.when(F.col("lang") == "en", 1).when(F.col("lang") == "fr", 2).when(F.col("lang") == "de", 3).otherwise(4).cast("long")
    return R.mmr(f.select(q.alias("query_id"), F.col("doc_id").alias("id"), "relevance", F.col("vector").alias("vec"), F.col("source").alias("kind")))


PAIRWISE = f"""WITH h AS (SELECT query_id, doc_id, source, CAST(embedding[1] AS DOUBLE) x FROM ({bm25_sql(BATCH_TERMS, 5)}) JOIN documents USING (doc_id) JOIN embeddings ON vec_id = doc_id)
    SELECT a.query_id, a.doc_id a_id, b.doc_id b_id, round(0.7 * (1 - abs(a.x - b.x)) + CASE WHEN a.source = b.source THEN 0.3 ELSE 0 END, 9) similarity FROM h a JOIN h b ON a.query_id = b.query_id AND a.doc_id < b.doc_id"""


@query(PAIRWISE)
def pairwise_similarity(spark, d):
    """Likeness of the hits of each query (the five best of bm25_batch) by pairs."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.element_at("embedding", 1).cast("double").alias("x"))
    a = bm25_batch(spark, d).select("query_id", "doc_id").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").join(e, "doc_id")
    b = a.select("query_id", F.col("doc_id").alias("b_id"), F.col("source").alias("b_source"), F.col("x").alias("y"))
    s = 0.7 * (1 - F.abs(F.col("x") - F.col("y"))) + F.when(F.col("source") == F.col("b_source"), 0.3).otherwise(0.0)
    return a.join(b, "query_id").where("doc_id < b_id").select("query_id", F.col("doc_id").alias("a_id"), "b_id", F.round(s, 9).alias("similarity"))
