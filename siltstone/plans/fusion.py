"""Hybrid search queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..operators import hybrid as H
from ..operators import vectors
from ..operators.inverted import stored
from .catalog import query, table
from .search import bm25_sql
from .vectors import COS

ASKED = [(1, "the"), (1, "of")]
LEX = f"SELECT query_id, doc_id AS id, score, rank FROM ({bm25_sql('VALUES ' + ', '.join(f'({i}, {chr(39)}{t}{chr(39)})' for i, t in ASKED), 20)})"
VEC = f"""SELECT 1 query_id, id, score, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM (SELECT e.vec_id id, {COS.format(a='q.embedding', b='e.embedding')} score FROM embeddings e, embeddings q WHERE q.vec_id = 0) WHERE score >= 0.2 QUALIFY row_number() OVER (ORDER BY round(score, 9) DESC, id) <= 20"""


def _sides(spark, d):
    docs, e = table(spark, d, "documents"), table(spark, d, "embeddings")
    lex = stored(docs).search(spark.createDataFrame(ASKED, "query_id int, term string"), 20).withColumnRenamed("doc_id", "id")
    q = e.where("vec_id = 0").select(F.lit(1).alias("query_id"), F.col("embedding").alias("q"))
    return lex, vectors.knn(e, q, 20, 0.2).withColumnRenamed("vec_id", "id")


@query(
    f"""WITH a AS ({LEX}), b AS ({VEC}), f AS (SELECT coalesce(a.query_id, b.query_id) query_id, coalesce(a.id, b.id) id, coalesce(0.4 / (60 + a.rank), 0) + coalesce(0.6 / (60 + b.rank), 0) score, a.rank ar, b.rank br FROM a FULL JOIN b ON a.id = b.id)
    SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank, CASE WHEN ar IS NOT NULL AND br IS NOT NULL THEN 'hybrid' WHEN ar IS NOT NULL THEN 'exact' ELSE 'semantic' END match_type FROM (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM f) WHERE rank <= 10"""
)
def hybrid_rrf_fusion(spark, d):
    f = H.rrf(*_sides(spark, d), H.MODES["balanced"])
    return f.select("query_id", "id", "score", "rank", H.match_label(F.col("text_rank"), F.col("vector_rank")).alias("match_type"))


def primary_sql(first, second, fw, sw, out):
    return f"""WITH a AS ({first}), b AS ({second}), u AS (SELECT query_id, id, max(score) score FROM (SELECT query_id, id, score * {fw} score FROM a UNION ALL SELECT query_id, id, score * {sw} * 0.3 FROM b) GROUP BY 1, 2)
    SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM u) WHERE rank <= {out}"""


@query(primary_sql(LEX, VEC, 0.8, 0.2, 8))
def lexical_primary(spark, d):
    m = H.MODES["precise"]
    return H.primary(*_sides(spark, d), m.text, m.vector, m.out)


@query(primary_sql(VEC, LEX, 0.8, 0.2, 12))
def semantic_primary(spark, d):
    lex, vec = _sides(spark, d)
    m = H.MODES["exploratory"]
    return H.primary(vec, lex, m.vector, m.text, m.out)


QUERY_TEXTS = [
    "What is machine learning?", "similar approaches to neural network training", "machine learning AND neural networks", '"deep learning" applications', "machine learning algorithms",
    "find documents by john", "author:john AND type:pdf", "machine learning python", "find documents by John from last week", "find documents similar to this report", "files from yesterday",
]


def asked_queries(spark, d):
    """Stated queries and the benchmark's items as queries."""
    own = spark.createDataFrame([(-i - 1, t) for i, t in enumerate(QUERY_TEXTS)], "query_id long, text string")
    return own.unionByName(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"))


ASKED_SQL = "SELECT -(row_number() OVER ()) query_id, text FROM (SELECT unnest([" + ", ".join("'" + t.replace("'", "''") + "'" for t in QUERY_TEXTS) + "]) text) UNION ALL SELECT item_id, text FROM benchmark"


def _in(words):
    return "len(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: w IN (" + ", ".join(f"'{w}'" for w in words) + "))) > 0"


ANALYSIS = f"""WITH q AS ({ASKED_SQL}), a AS (SELECT query_id, text, len(regexp_extract_all(text, '"[^"]*"')) n_phrases,
  len(list_filter(list_transform(regexp_split_to_array(lower(regexp_replace(regexp_replace(text, '"[^"]*"', ' ', 'g'), '\\b(AND|OR|NOT)\\b', ' ', 'g')), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: regexp_replace(w, '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g')), lambda w: length(w) > 2 AND regexp_matches(w, '[a-z]'))) n_keywords,
  regexp_matches(text, '\\b(AND|OR|NOT)\\b') has_boolean, {_in(H.QUESTION_WORDS + H.FACTUAL_WORDS)} factual, {_in(H.CONCEPTUAL_WORDS)} conceptual FROM q),
c AS (SELECT *, round(n_keywords * 0.1 + n_phrases * 0.3 + CASE WHEN has_boolean THEN 0.4 ELSE 0 END + CASE WHEN factual THEN 0.2 ELSE 0 END + CASE WHEN conceptual THEN 0.3 ELSE 0 END, 6) complexity FROM a)
SELECT query_id, n_phrases, n_keywords, has_boolean, factual, conceptual, complexity, CASE WHEN has_boolean OR n_phrases > 0 OR (factual AND complexity < 0.5) THEN 'precise' WHEN conceptual OR complexity > 0.8 THEN 'exploratory' ELSE 'balanced' END mode FROM c"""


@query(ANALYSIS)
def query_analysis(spark, d):
    a = H.analysed(asked_queries(spark, d))
    return a.select("query_id", F.size("phrases").alias("n_phrases"), F.size("keywords").alias("n_keywords"), "has_boolean", "factual", "conceptual", "complexity", "mode")


@query(f"SELECT mode, CASE WHEN mode = 'precise' AND (has_boolean OR n_phrases > 0) THEN 'lexical' WHEN mode = 'exploratory' AND conceptual THEN 'semantic' ELSE 'fusion' END AS strategy, count(*) n FROM ({ANALYSIS}) GROUP BY 1, 2")
def query_routing(spark, d):
    a = H.analysed(asked_queries(spark, d))
    structured = F.col("has_boolean") | (F.size("phrases") > 0)
    s = F.when((F.col("mode") == "precise") & structured, "lexical").when((F.col("mode") == "exploratory") & F.col("conceptual"), "semantic").otherwise("fusion")
    return a.groupBy("mode", s.alias("strategy")).agg(F.count("*").alias("n"))


@query()
def prepared_queries(spark, d):
    """What the index is asked, by both builders, for the stated queries and the benchmark's items."""
    a = H.analysed(asked_queries(spark, d)).select("query_id", "text", "keywords", "phrases", "factual", "has_boolean", "conceptual", "mode")

    def run(frames):
        for x in frames:
            rows = [(r.query_id, H.prepared_fts(r.text), H.built_fts(list(r.keywords), list(r.phrases), r.factual, r.text), H.route(r.has_boolean or len(r.phrases) > 0, r.conceptual, r.mode)) for r in x.itertuples()]
            yield pd.DataFrame(rows, columns=["query_id", "prepared", "built", "route"])

    return a.mapInPandas(run, "query_id long, prepared string, built string, route string")


@query(
    f"""WITH h AS (SELECT id, score FROM ({LEX})) SELECT d.doc_id, d.lang, least(greatest(h.score, 0), 1) score, CAST(row_number() OVER (ORDER BY round(h.score, 9) DESC, d.doc_id) AS INTEGER) ordinal FROM h JOIN documents d ON d.doc_id = h.id WHERE d.lang IN ('en', 'de') AND d.n_chars < 3000"""
)
def filtered_hits(spark, d):
    """Hits joined to their documents, filtered before the limit, scores clamped, numbered."""
    lex, _ = _sides(spark, d)
    docs = table(spark, d, "documents").where(F.col("lang").isin("en", "de") & (F.col("n_chars") < 3000)).select("doc_id", "lang")
    hits = H.ranked(lex.join(docs, lex["id"] == docs["doc_id"]).select("query_id", "doc_id", "lang", "score"), "doc_id")
    return hits.select("doc_id", "lang", F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)).alias("score"), F.col("rank").alias("ordinal"))


@query("SELECT event_id, event_type, CASE WHEN ts >= TIMESTAMP '2024-01-30 00:00:00' THEN 'today' WHEN ts >= TIMESTAMP '2024-01-24 00:00:00' THEN 'week' ELSE 'month' END date_window FROM events WHERE ts >= TIMESTAMP '2024-01-01 00:00:00'")
def date_windows(spark, d):
    """Date filters as of a stated instant."""
    ts = F.col("ts")
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    w = F.when(ts >= at("2024-01-30 00:00:00"), "today").when(ts >= at("2024-01-24 00:00:00"), "week").otherwise("month")
    return table(spark, d, "events").where(ts >= at("2024-01-01 00:00:00")).select("event_id", "event_type", w.alias("date_window"))


@query(f"WITH q AS ({ASKED_SQL}) SELECT query_id, CASE WHEN contains(text, ' AND ') OR contains(text, ' OR ') THEN 'boolean' WHEN contains(text, 'type:') OR contains(text, 'author:') THEN 'field' ELSE 'plain' END banner FROM q")
def intent_banner(spark, d):
    t = F.col("text")
    return asked_queries(spark, d).select("query_id", F.when(t.contains(" AND ") | t.contains(" OR "), "boolean").when(t.contains("type:") | t.contains("author:"), "field").otherwise("plain").alias("banner"))


@query("SELECT unnest(['tutorial', 'examples', 'guide', 'best practices', 'documentation']) suffix, doc_id, left(text, 20) || ' ' || unnest(['tutorial', 'examples', 'guide', 'best practices', 'documentation']) suggestion FROM (SELECT item_id doc_id, text FROM benchmark)")
def static_suggestions(spark, d):
    five = F.array(*[F.lit(x) for x in ("tutorial", "examples", "guide", "best practices", "documentation")])
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text", F.explode(five).alias("suffix"))
    return b.select("doc_id", "suffix", F.concat(F.left("text", F.lit(20)), F.lit(" "), "suffix").alias("suggestion"))
