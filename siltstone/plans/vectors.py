"""Vector queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import metricjoin as J
from ..operators import vectors as O
from .catalog import query, table

COS = "coalesce(list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), 0)"


def _e(spark, d):
    return table(spark, d, "embeddings")


def _one(spark, d, i=0):
    return _e(spark, d).where(f"vec_id = {i}").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


@query(
    f"""SELECT query_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT q.vec_id query_id, e.vec_id, {COS.format(a='q.embedding', b='e.embedding')} score,
    row_number() OVER (ORDER BY round({COS.format(a='q.embedding', b='e.embedding')}, 9) DESC, e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id = 0) WHERE rank <= 10"""
)
def vector_knn(spark, d):
    return O.knn(_e(spark, d), _one(spark, d), 10)


@query(f"SELECT q.vec_id query_id, e.vec_id, {COS.format(a='q.embedding', b='e.embedding')} score FROM embeddings e, embeddings q WHERE q.vec_id = 0 AND {COS.format(a='q.embedding', b='e.embedding')} >= 0.2")
def vector_threshold(spark, d):
    return O.knn(_e(spark, d), _one(spark, d), 1 << 30, 0.2).drop("rank")


@query(
    f"""SELECT query_id, vec_id, round(score, 6) score, CAST(rank AS INTEGER) AS rank FROM (SELECT q.vec_id query_id, e.vec_id, {COS.format(a='q.embedding', b='e.embedding')} score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY round({COS.format(a='q.embedding', b='e.embedding')}, 9) DESC, e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.label = 7) WHERE rank <= 5"""
)
def vector_knn_batch(spark, d):
    q = _e(spark, d).where("label = 7").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return O.knn_blocks(_e(spark, d), q, 5).withColumn("score", F.round("score", 6))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 9) length, round(CAST(embedding[1] AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 9) first_component FROM embeddings")
def vector_normalise(spark, d):
    return _e(spark, d).select("vec_id", F.round(V.norm(F.col("embedding")), 9).alias("length"), F.round(F.element_at(V.normalised(F.col("embedding")), 1), 9).alias("first_component"))


@query("SELECT label, CAST(pos - 1 AS INTEGER) pos, avg(CAST(x AS DOUBLE)) mean FROM (SELECT label, unnest(embedding) x, unnest(range(1, len(embedding) + 1)) pos FROM embeddings) GROUP BY 1, 2")
def vector_centroids(spark, d):
    return O.centroids(_e(spark, d), "label")


ALIKE = f"SELECT a.vec_id a, b.vec_id b, round({COS.format(a='a.embedding', b='b.embedding')}, 9) score FROM (SELECT min(vec_id) vec_id, embedding FROM embeddings GROUP BY embedding) a JOIN (SELECT min(vec_id) vec_id, embedding FROM embeddings GROUP BY embedding) b ON a.vec_id < b.vec_id"


@query(f"SELECT a, b, score, CASE WHEN score > 0.9 THEN 'Duplicate' WHEN score > 0.7 THEN 'VerySimilar' ELSE 'Similar' END AS class FROM ({ALIKE}) WHERE score >= 0.5")
def similarity_classes(spark, d):
    """Every vector against every other: pairs beyond 0.5 and their class."""
    s = J.cosine_join(_e(spark, d), 0.5).withColumn("score", F.round("cosine", 9))
    return s.select("a", "b", "score", O.similarity_class(F.col("score")).alias("class"))


@query(f"SELECT a.doc_id, round({COS.format(a='e.embedding', b='f.embedding')}, 9) similarity FROM documents a JOIN embeddings e ON e.vec_id = a.doc_id JOIN embeddings f ON f.vec_id = a.doc_id + 1")
def text_pair_similarity(spark, d):
    e = _e(spark, d)
    a = table(spark, d, "documents").select("doc_id").join(e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("x")), "doc_id")
    b = e.select((F.col("vec_id") - 1).alias("doc_id"), F.col("embedding").alias("y"))
    return a.join(b, "doc_id").select("doc_id", F.round(V.cosine(F.col("x"), F.col("y")), 9).alias("similarity"))


@query()
def regenerated_embeddings(spark, d):
    """Vectors for the documents that lack one, by the stand-in model."""
    have = _e(spark, d).select(F.col("vec_id").alias("doc_id"))
    lacking = table(spark, d, "documents").join(have, "doc_id", "left_anti")
    return O.embed_texts(lacking, O.hashed_embedding)


@query("SELECT label, count(*) n, count(*) * 64 * 4 bytes FROM embeddings GROUP BY label")
def cache_memory_by_model(spark, d):
    return _e(spark, d).groupBy("label").agg(F.count("*").alias("n"), F.sum(F.size("embedding") * 4).alias("bytes"))


@query("SELECT d.doc_id, e.label FROM (SELECT doc_id, sha256(lower(trim(text))) k FROM documents) d JOIN (SELECT sha256(lower(trim(text))) k, min(doc_id) i FROM documents GROUP BY 1) c USING (k) JOIN embeddings e ON e.vec_id = c.i")
def embedding_cache_lookup(spark, d):
    """Vectors found by the hash of the lower-cased, trimmed text."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2(F.lower(F.trim("text")), 256).alias("k"))
    cache = docs.groupBy("k").agg(F.min("doc_id").alias("vec_id")).join(_e(spark, d).select("vec_id", "label"), "vec_id")
    return docs.join(cache, "k").select("doc_id", "label")
