"""Chunk queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunk
from .catalog import query, table
from .texts import FOLDED

SENTENCES = f"""SELECT doc_id, CAST(unnest(range(len(s))) AS INTEGER) chunk_index, unnest(s) content FROM (
  SELECT doc_id, list_filter(list_transform(string_split(regexp_replace({FOLDED.format("coalesce(text, '')")}, '([.!?]+) ', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: x <> '') s FROM documents)"""


def _sentence_rows(spark, d):
    s = table(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(T.folded(F.coalesce("text", F.lit(""))))).alias("chunk_index", "content"))
    return s


@query()
def sentence_chunks(spark, d):
    """The fold with overlap; checked against a plain loop in the tests."""
    return chunk.sentence_chunks(table(spark, d, "documents"))


@query()
def character_chunks(spark, d):
    return chunk.character_chunks(table(spark, d, "documents")).select("doc_id", "chunk_index", "start_char", "end_char")


@query(
    f"""WITH RECURSIVE s AS ({SENTENCES}), n AS (SELECT doc_id, max(chunk_index) last FROM s GROUP BY 1),
    r AS (SELECT doc_id, 0 AS i, 0 AS chunk, length(content) AS size FROM s WHERE chunk_index = 0
      UNION ALL SELECT r.doc_id, r.i + 1, CASE WHEN r.size + 1 + length(s.content) > 1500 THEN r.chunk + 1 ELSE r.chunk END, CASE WHEN r.size + 1 + length(s.content) > 1500 THEN length(s.content) ELSE r.size + 1 + length(s.content) END
      FROM r JOIN s ON s.doc_id = r.doc_id AND s.chunk_index = r.i + 1)
    SELECT doc_id, CAST(chunk AS INTEGER) chunk_index, CAST(max(size) AS INTEGER) size, count(*) sentences FROM r GROUP BY 1, 2"""
)
def chunk_packing(spark, d):
    """The packing rule without overlap: sizes and sentence counts of the chunks."""
    c = chunk.packed(table(spark, d, "documents"), chunk.ChunkOptions(overlap=0.0)).select("doc_id", F.posexplode("parts").alias("chunk_index", "part"))
    return c.select("doc_id", "chunk_index", F.length("part.content").alias("size"), F.col("part.sentences").cast("long").alias("sentences"))


@query(f"WITH s AS ({SENTENCES}) SELECT doc_id, chunk_index, sha256(string_agg(content, ' ') OVER (PARTITION BY doc_id ORDER BY chunk_index ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) context FROM s")
def chunk_context(spark, d):
    c = chunk.with_context(_sentence_rows(spark, d), 1)
    return c.select("doc_id", "chunk_index", F.sha2("context", 256).alias("context"))


@query(f"WITH s AS ({SENTENCES}) SELECT doc_id, count(*) n_chunks, sha256(string_agg(content, ' ' ORDER BY chunk_index)) content FROM s GROUP BY doc_id")
def chunk_merge(spark, d):
    return chunk.merged(_sentence_rows(spark, d)).select("doc_id", "n_chunks", F.sha2("content", 256).alias("content"))


@query(f"WITH s AS ({SENTENCES}), f AS (SELECT doc_id, length(content) <= 1500 AND (count(*) OVER (PARTITION BY doc_id) = 1 OR length(content) >= 100) valid FROM s) SELECT doc_id, count(*) FILTER (WHERE valid) n_valid, count(*) n, bool_and(valid) accepted FROM f GROUP BY 1")
def chunk_validation(spark, d):
    v = chunk.validated(_sentence_rows(spark, d))
    return v.groupBy("doc_id").agg(F.count_if("valid").alias("n_valid"), F.count("*").alias("n"), F.bool_and("valid").alias("accepted"))


@query(
    """WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) i, turn * 1000 a, turn * 1000 + 900 b, length(coalesce(text, '')) n FROM conversations),
    r AS (SELECT conv_id, i, 0 chunk, CASE WHEN n >= 400 THEN 0 ELSE n END held, a, b, n >= 400 AS full_, a AS first_ FROM t WHERE i = 1
      UNION ALL SELECT r.conv_id, t.i, CASE WHEN r.full_ THEN r.chunk + 1 ELSE r.chunk END, CASE WHEN r.held + (CASE WHEN r.held > 0 THEN 1 ELSE 0 END) + t.n >= 400 THEN 0 ELSE r.held + (CASE WHEN r.held > 0 THEN 1 ELSE 0 END) + t.n END, t.a, t.b,
        r.held + (CASE WHEN r.held > 0 THEN 1 ELSE 0 END) + t.n >= 400, CASE WHEN r.full_ THEN t.a ELSE r.first_ END FROM r JOIN t ON t.conv_id = r.conv_id AND t.i = r.i + 1)
    SELECT conv_id media_id, CAST(chunk AS INTEGER) chunk_index, CAST(min(first_) AS BIGINT) start_ms, CAST(max(b) AS BIGINT) end_ms FROM r GROUP BY 1, 2"""
)
def timed_chunks(spark, d):
    """Turns of conversations as segments of a recording, packed to 400 characters without overlap."""
    s = table(spark, d, "conversations").select(F.col("conv_id").alias("media_id"), (F.col("turn") * 1000).alias("start_ms"), (F.col("turn") * 1000 + 900).alias("end_ms"), F.coalesce("text", F.lit("")).alias("text"))
    return chunk.timed_chunks(s, 400, 0).select("media_id", "chunk_index", "start_ms", "end_ms")
