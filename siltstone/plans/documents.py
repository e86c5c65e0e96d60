"""Catalogue, paging, joins and keyed changes on the document tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import store
from .catalog import query, table

CATEGORY = "CASE WHEN n_chars = 0 THEN 'empty' WHEN n_chars <= 1024 THEN 'tiny' WHEN n_chars <= 10240 THEN 'small' WHEN n_chars <= 1048576 THEN 'medium' WHEN n_chars <= 104857600 THEN 'large' ELSE 'huge' END"


@query("SELECT lang, count(*) n, sum(n_chars) chars, avg(n_chars) mean_chars, max(n_chars) longest FROM documents GROUP BY lang")
def counts_by_language(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.avg("n_chars").alias("mean_chars"), F.max("n_chars").alias("longest"))


@query("SELECT source AS file_type, count(*) n FROM documents GROUP BY source")
def counts_by_type(spark, d):
    return table(spark, d, "documents").groupBy(F.col("source").alias("file_type")).agg(F.count("*").alias("n"))


@query(f"SELECT {CATEGORY} AS size_category, count(*) n, sum(n_chars) chars FROM documents GROUP BY 1")
def size_categories(spark, d):
    return table(spark, d, "documents").groupBy(store.size_category(F.col("n_chars")).alias("size_category")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT 'documents' name, count(*) n FROM documents UNION ALL SELECT 'embeddings', count(*) FROM embeddings UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'conversations', count(*) FROM conversations")
def total_counts(spark, d):
    parts = [table(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in ("documents", "embeddings", "pages", "conversations")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id = 42")
def point_lookup(spark, d):
    return table(spark, d, "documents").where("doc_id = 42").select("doc_id", "lang", "source", "n_chars").limit(1)


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 40")
def paged_scan(spark, d):
    return store.page(table(spark, d, "documents").select("doc_id", "n_chars"), [F.desc("n_chars"), F.asc("doc_id")], 40, 20)


@query("SELECT event_id, ts, user_id FROM events WHERE ts > TIMESTAMP '2024-01-25 00:00:00' ORDER BY ts DESC, event_id")
def modified_since(spark, d):
    return table(spark, d, "events").where(F.col("ts") > F.lit("2024-01-25 00:00:00").cast("timestamp_ntz")).select("event_id", "ts", "user_id").orderBy(F.desc("ts"), "event_id")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id)")
def missing_embeddings(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return table(spark, d, "documents").select("doc_id").join(e, "doc_id", "left_anti")


@query("SELECT d.doc_id, d.lang, e.label, e.vec_id IS NOT NULL has_vector FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id")
def documents_with_embeddings(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label")
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return docs.join(e, docs["doc_id"] == e["vec_id"], "left").select("doc_id", "lang", "label", F.col("vec_id").isNotNull().alias("has_vector"))


@query("SELECT d.doc_id, e.embedding[1] first_component FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id WHERE e.label = 3")
def embeddings_of_a_model(spark, d):
    e = table(spark, d, "embeddings").where("label = 3").select(F.col("vec_id").alias("doc_id"), F.element_at("embedding", 1).alias("first_component"))
    return table(spark, d, "documents").select("doc_id").join(e, "doc_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_join_selected(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").where("quality = 1"), "doc_id", "left_semi")


@query(
    """SELECT 'vectors_without_document' check_name, count(*) n FROM embeddings e ANTI JOIN documents d ON d.doc_id = e.vec_id
    UNION ALL SELECT 'labels_without_document', count(*) FROM labels l ANTI JOIN documents d ON d.doc_id = l.doc_id
    UNION ALL SELECT 'documents_without_vector', count(*) FROM documents d ANTI JOIN embeddings e ON d.doc_id = e.vec_id
    UNION ALL SELECT 'empty_documents', count(*) FROM documents WHERE coalesce(text, '') = ''"""
)
def index_health(spark, d):
    docs, e, lab = table(spark, d, "documents"), table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), table(spark, d, "labels").select("doc_id")
    ids = docs.select("doc_id")
    n = F.count("*").alias("n")
    parts = [
        ("vectors_without_document", e.join(ids, "doc_id", "left_anti")),
        ("labels_without_document", lab.join(ids, "doc_id", "left_anti")),
        ("documents_without_vector", ids.join(e, "doc_id", "left_anti")),
        ("empty_documents", docs.where(F.coalesce("text", F.lit("")) == "")),
    ]
    out = None
    for name, p in parts:
        p = p.agg(n).select(F.lit(name).alias("check_name"), "n")
        out = p if out is None else out.unionByName(p)
    return out


@query(
    """WITH new AS (SELECT doc_id, lang, 'moved' source, n_chars + 1 n_chars FROM documents WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id + 1000000, lang, source, n_chars FROM documents WHERE doc_id % 50 = 0)
    SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM new)
    UNION ALL SELECT n.doc_id, coalesce(d.lang, n.lang), n.source, n.n_chars FROM new n LEFT JOIN documents d USING (doc_id)"""
)
def upsert_by_key(spark, d):
    old = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    new = old.where("doc_id % 5 = 0").select("doc_id", "lang", F.lit("moved").alias("source"), (F.col("n_chars") + 1).alias("n_chars")).union(old.where("doc_id % 50 = 0").select((F.col("doc_id") + 1000000).alias("doc_id"), "lang", "source", "n_chars"))
    return store.upsert(old, new, "doc_id", ["lang"])


@query(
    """SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) n FROM events) WHERE n = 1"""
)
def insert_or_replace(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return store.latest(e, ["user_id", "event_type"], F.desc("ts"), F.desc("event_id")).drop("ts")


@query("SELECT l.doc_id, l.quality FROM labels l WHERE l.doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'de')")
def cascade_delete(spark, d):
    gone = table(spark, d, "documents").where("lang = 'de'")
    return store.without(table(spark, d, "labels").select("doc_id", "quality"), gone, "doc_id")


@query("SELECT count(*) FILTER (WHERE doc_id % 7 = 0) removed, count(*) FILTER (WHERE doc_id % 7 <> 0) left_over FROM documents")
def missing_file_cleanup(spark, d):
    """Documents whose file is gone from the current listing (here: ids divisible by 7)."""
    docs = table(spark, d, "documents").select("doc_id")
    listing = docs.where("doc_id % 7 <> 0").withColumn("there", F.lit(1))
    return docs.join(listing, "doc_id", "left").agg(F.count_if(F.col("there").isNull()).alias("removed"), F.count_if(F.col("there").isNotNull()).alias("left_over"))


@query(
    """SELECT decision, count(*) n FROM (
      SELECT CASE WHEN i.doc_id IS NULL THEN 'new' WHEN l.mtime > i.indexed_at AND l.h IS DISTINCT FROM i.h THEN 'changed' ELSE 'unchanged' END decision
      FROM (SELECT doc_id, n_chars % 10 mtime, sha256(text) h FROM documents) l LEFT JOIN (SELECT doc_id, 5 indexed_at, sha256(CASE WHEN doc_id % 2 = 0 THEN text ELSE 'old' END) h FROM documents WHERE doc_id % 3 <> 0) i USING (doc_id)) GROUP BY 1"""
)
def reindex_decision(spark, d):
    docs = table(spark, d, "documents")
    listing = docs.select("doc_id", (F.col("n_chars") % 10).alias("mtime"), F.sha2("text", 256).alias("hash"))
    had = docs.where("doc_id % 3 <> 0").select("doc_id", F.lit(5).alias("indexed_at"), F.sha2(F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise("old"), 256).alias("hash"))
    return store.reindex_decisions(listing, had, "doc_id").groupBy("decision").agg(F.count("*").alias("n"))


@query("SELECT sha256(text) content_hash, n_chars, list_sort(list(doc_id)) ids, count(*) n FROM documents GROUP BY 1, 2 HAVING count(*) > 1")
def exact_duplicate_groups(spark, d):
    docs = table(spark, d, "documents").select(F.sha2("text", 256).alias("content_hash"), "n_chars", "doc_id")
    return docs.groupBy("content_hash", "n_chars").agg(F.array_sort(F.collect_list("doc_id")).alias("ids"), F.count("*").alias("n")).where("n > 1")


@query("SELECT a.doc_id a_id, b.doc_id b_id FROM documents a JOIN documents b ON a.n_chars = b.n_chars AND a.source = b.source AND a.doc_id < b.doc_id")
def likely_identical(spark, d):
    """Same size and same stamp; the equi-join keeps it linear in the matches."""
    a = table(spark, d, "documents").select(F.col("doc_id").alias("a_id"), "n_chars", "source")
    b = a.withColumnRenamed("a_id", "b_id")
    return a.join(b, ["n_chars", "source"]).where("a_id < b_id").select("a_id", "b_id")


@query(
    """SELECT doc_id, CASE WHEN length(text) <= 2000 THEN sha256(text) ELSE sha256(concat(left(text, 500), right(text, 500))) END partial_hash FROM documents"""
)
def tiered_content_hash(spark, d):
    """Whole texts up to a size, else their beginning and end (sizes scaled down to the tables')."""
    docs = table(spark, d, "documents")
    long = F.concat(F.left("text", F.lit(500)), F.right("text", F.lit(500)))
    return docs.select("doc_id", F.when(F.length("text") <= 2000, F.sha2("text", 256)).otherwise(F.sha2(long, 256)).alias("partial_hash"))


@query("SELECT count(*) documents, sum(n_chars) total_chars, avg(n_chars) mean_chars, count(*) FILTER (WHERE n_chars < 50) gated, count(DISTINCT source) types FROM documents")
def processing_statistics(spark, d):
    return table(spark, d, "documents").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("total_chars"), F.avg("n_chars").alias("mean_chars"), F.count_if(F.col("n_chars") < 50).alias("gated"), F.countDistinct("source").alias("types"))


@query("SELECT doc_id, source, n_chars FROM documents WHERE source IN ('src1', 'src2') ORDER BY n_chars DESC, doc_id LIMIT 25")
def browse_by_type(spark, d):
    return table(spark, d, "documents").where(F.col("source").isin("src1", "src2")).select("doc_id", "source", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(25)


@query("SELECT c_mktsegment || ':' || n_name AS name, coalesce(max(o_orderkey), 0) AS versions FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY 1")
def schema_version(spark, d):
    """Highest applied version of each component, 0 where there is none: segments of nations stand for components, open orders for what was applied."""
    names = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", F.concat_ws(":", "c_mktsegment", "n_name").alias("name"))
    applied = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("version"))
    return names.join(applied, "c_custkey", "left").groupBy("name").agg(F.coalesce(F.max("version"), F.lit(0)).alias("versions"))


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars >= 50")
def document_gate(spark, d):
    return table(spark, d, "documents").where("n_chars >= 50").select("doc_id", "n_chars")


@query(
    """SELECT c_mktsegment, o_orderpriority, count(*) n, sum(o_totalprice) total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"""
)
def join_aggregate(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy("c_mktsegment", "o_orderpriority").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))


@query(
    """SELECT 'union' op, count(*) n FROM (SELECT doc_id FROM documents WHERE lang = 'en' UNION SELECT doc_id FROM labels WHERE quality = 1)
    UNION ALL SELECT 'intersect', count(*) FROM (SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels WHERE quality = 1)
    UNION ALL SELECT 'except', count(*) FROM (SELECT doc_id FROM documents WHERE lang = 'en' EXCEPT SELECT doc_id FROM labels WHERE quality = 1)"""
)
def set_operations(spark, d):
    a = table(spark, d, "documents").where("lang = 'en'").select("doc_id")
    b = table(spark, d, "labels").where("quality = 1").select("doc_id")
    n = F.count("*").alias("n")
    parts = [a.union(b).distinct(), a.intersect(b), a.subtract(b)]
    parts = [p.agg(n).select(F.lit(o).alias("op"), "n") for o, p in zip(("union", "intersect", "except"), parts, strict=True)]
    return parts[0].union(parts[1]).union(parts[2])


@query("SELECT doc_id, coalesce(CASE WHEN doc_id % 10 = 0 THEN 'fixed' END, source) source, lang FROM documents")
def update_by_id(spark, d):
    """Mutable columns take the new value where there is one."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    new = docs.where("doc_id % 10 = 0").select("doc_id", F.lit("fixed").alias("new_source"))
    return docs.join(new, "doc_id", "left").select("doc_id", F.coalesce("new_source", "source").alias("source"), "lang")
