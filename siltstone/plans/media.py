"""Sources, sound and images. Pages stand for files, vectors for samples and 8 x 8 pictures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import media as M
from ..sources import files as S
from ..storage import Tables, delete_at_exit, scratch
from .catalog import query, table
from .texts import FOLDED


@query("SELECT page_id, CASE WHEN starts_with(hex(encode(html))[1:16], '3C21444F43545950') OR starts_with(hex(encode(html))[1:16], '3C68746D6C') THEN 'Html' ELSE 'other' END kind, lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) extension FROM pages")
def type_detection(spark, d):
    c = F.encode("html", "UTF-8")
    k = S.detected(F.col("url"), c)["kind"]
    return table(spark, d, "pages").select("page_id", F.when(k == "Html", "Html").otherwise("other").alias("kind"), S.extension(F.col("url")).alias("extension"))


@query("SELECT vec_id, round(len(list_filter(embedding, lambda x: abs(x) > 0.1::FLOAT)) / 64, 9) speech_ratio, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) / 64), 9) loudness FROM embeddings")
def audio_quality(spark, d):
    e = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.round(F.size(F.filter(e, lambda x: F.abs(x) > F.lit(0.1).cast("float"))) / 64, 9).alias("speech_ratio"), F.round(M.loudness(e), 9).alias("loudness"))


@query("SELECT vec_id, list_aggregate(list_transform(embedding, lambda x: CASE WHEN CAST(x AS DOUBLE) > list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE))) / 64 THEN '1' ELSE '0' END), 'string_agg', '') hash FROM embeddings")
def average_hashes(spark, d):
    return table(spark, d, "embeddings").select("vec_id", M.average_hash(F.col("embedding")).alias("hash"))


@query()
def image_features(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", M.image_features("embedding", F.lit(8)).alias("f"))
    return e.select("vec_id", "f.*", M.screenshot_class(F.col("f")).alias("class"), M.ocr_gate(F.col("f")).alias("second_pass"))


@query("SELECT page_id, sha256(html) content_hash, strlen(html) n_bytes FROM pages")
def file_hashes(spark, d):
    c = F.encode("html", "UTF-8")
    return table(spark, d, "pages").select("page_id", S.partial_hash(c).alias("content_hash"), F.octet_length(c).cast("long").alias("n_bytes"))


@query(f"SELECT doc_id, 'Text' kind, strlen(text) + 1 n_bytes, sha256(text || chr(10)) content_hash, sha256({FOLDED.format('text')}) folded, CAST(NULL AS VARCHAR) problem FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL")
def files_read_back(spark, d):
    """Every document written as a text file of its own, then the files listed and read as documents."""
    root = scratch(spark, "files")
    delete_at_exit(spark, root)
    S.write_files(table(spark, d, "documents").where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.col("text").alias("value")), root, "doc_id")
    own = F.regexp_extract("path", r"/doc_id=(-?\d+),[^/]*$", 1).cast("long")
    with Tables(spark, "files") as tables:
        read = S.documents(tables.release(S.read_once(tables, S.listing(spark, root))))
    return read.select(own.alias("doc_id"), "kind", F.col("length").alias("n_bytes"), "content_hash", F.sha2("text", 256).alias("folded"), "problem")
