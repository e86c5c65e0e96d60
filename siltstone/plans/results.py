"""Result processing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import alike as A
from ..operators import rank as R
from ..operators import results as O
from ..operators import setjoin as J
from ..operators.inverted import ASKED_ROWS
from ..operators.nearhits import near_hits
from ..storage import Tables
from .catalog import query, table
from .search import DOCS, bm25_batch
from .texts import STOPS, WORDS


def _docs(spark, d):
    return table(spark, d, "documents")


KEY = "sha256(regexp_replace(lower(text), '[^a-z0-9\\s]', '', 'g'))"


@query(f"SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY {KEY} ORDER BY n_chars DESC, doc_id) n FROM documents) WHERE n = 1")
def exact_dedup(spark, d):
    return O.first_of_duplicates(_docs(spark, d).select("doc_id", "lang", "n_chars", "text"), T.content_key(F.col("text")), [F.desc("n_chars"), F.asc("doc_id")]).select("doc_id", "lang")


@query(f"SELECT {KEY} content_key, list_sort(list(doc_id)) members, count(*) n FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_duplicate_groups(spark, d):
    return O.duplicate_groups(_docs(spark, d))


ALIKE = 0.75  # least Jaccard similarity of the pairs below
MEASURED = f"""SELECT p.a, p.b, n.k ka, m.k kb, common / (n.n + m.n - common) jaccard, dot / (n.l * m.l) cosine FROM
    (SELECT x.id a, y.id b, count(*) common, sum(x.tf * y.tf) dot FROM tf x JOIN tf y ON x.term = y.term AND x.id < y.id GROUP BY 1, 2) p JOIN size n ON n.id = p.a JOIN size m ON m.id = p.b"""
CLASSES = f"""reps AS (SELECT min(doc_id) id, k FROM (SELECT doc_id, list_aggregate(t, 'string_agg', ' ') k FROM ({DOCS}) WHERE len(t) > 0) GROUP BY k),
    tf AS (SELECT id, term, count(*) tf FROM (SELECT id, unnest(string_split(k, ' ')) term FROM reps) GROUP BY 1, 2), size AS (SELECT id, any_value(k) k, count(*) n, sqrt(sum(tf * tf)) l FROM tf JOIN reps USING (id) GROUP BY 1)"""
PAIRS = f"SELECT a, b FROM (WITH {CLASSES} {MEASURED}) WHERE round(jaccard, 9) >= {ALIKE}"


def alike(spark, d):
    """(a, b, jaccard, cosine, bigrams): all pairs of documents of different words whose word sets are alike by ALIKE or more. Of documents of equal words the first stands for all (``word_classes``)."""
    return A.alike(_docs(spark, d), ALIKE)


@query(f"SELECT doc_id, min(doc_id) OVER (PARTITION BY list_aggregate(t, 'string_agg', ' ')) AS rep FROM ({DOCS}) WHERE len(t) > 0")
def word_classes(spark, d):
    """The document that stands for each in the pairs below."""
    return J.token_classes(_docs(spark, d))


@query(f"SELECT a, b, round(cosine, 9) AS cosine FROM (WITH {CLASSES} {MEASURED}) WHERE round(jaccard, 9) >= {ALIKE}")
def tf_cosine_similarity(spark, d):
    """The cosine of term counts of all pairs that are alike."""
    return alike(spark, d).select("a", "b", F.round("cosine", 9).alias("cosine"))


BIGRAMS = f"""SELECT a, b, jaccard, cosine, CASE WHEN len(list_distinct(ga || gb)) = 0 THEN 0 ELSE len(list_intersect(list_distinct(ga), list_distinct(gb))) / len(list_distinct(ga || gb)) END bigrams FROM
    (SELECT *, list_transform(range(1, greatest(1, len(ta))), lambda i: ta[i] || ' ' || ta[i + 1]) ga, list_transform(range(1, greatest(1, len(tb))), lambda i: tb[i] || ' ' || tb[i + 1]) gb FROM
    (SELECT *, string_split(ka, ' ') ta, string_split(kb, ' ') tb FROM (WITH {CLASSES} {MEASURED}) WHERE round(jaccard, 9) >= {ALIKE}))"""


@query(f"SELECT a, b, round(jaccard, 9) words, round(bigrams, 9) bigrams FROM ({BIGRAMS})")
def jaccard_similarity(spark, d):
    return alike(spark, d).select("a", "b", F.round("jaccard", 9).alias("words"), F.round("bigrams", 9).alias("bigrams"))


@query()
def near_duplicate_hits(spark, d):
    """0.6 Jaccard + 0.4 cosine beyond 0.85 to a document kept before, over all documents; against brute force in the tests."""
    return near_hits(_docs(spark, d))


@query(f"SELECT a, b, round(0.5 * cosine + 0.3 * jaccard + 0.2 * bigrams, 9) similarity FROM ({BIGRAMS})")
def enhanced_similarity(spark, d):
    """0.5 cosine + 0.3 Jaccard + 0.2 of bigrams."""
    return alike(spark, d).select("a", "b", F.round(0.5 * F.col("cosine") + 0.3 * F.col("jaccard") + 0.2 * F.col("bigrams"), 9).alias("similarity"))


@query(
    f"""WITH k AS (SELECT doc_id, list(term ORDER BY n DESC, term) kt FROM (SELECT doc_id, term, count(*) n, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, term) r FROM (SELECT doc_id, unnest(t) term FROM ({DOCS})) WHERE length(term) > 4 GROUP BY 1, 2) WHERE r <= 5 GROUP BY 1)
    SELECT d.doc_id, coalesce(kt, []) key_terms FROM documents d LEFT JOIN k USING (doc_id)"""
)
def key_terms(spark, d):
    docs = _docs(spark, d)
    terms = O.top_terms(docs, "doc_id", 5).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("k"))
    return docs.select("doc_id").join(terms, "doc_id", "left").select("doc_id", F.coalesce("k", F.array().cast("array<string>")).alias("key_terms"))


@query(f"SELECT source, term, n, CAST(r AS INTEGER) AS rank FROM (SELECT source, term, count(*) n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, term) r FROM (SELECT source, unnest(t) term FROM ({DOCS})) WHERE length(term) > 4 GROUP BY 1, 2) WHERE r <= 3")
def key_topics(spark, d):
    return O.top_terms(_docs(spark, d), "source", 3)


@query(f"SELECT label, list_aggregate(list_transform(ts, lambda x: upper(x[1]) || substr(x, 2)), 'string_agg', ' & ') name, ts[1] first_word FROM (SELECT lang label, list(term ORDER BY n DESC, term) ts FROM (SELECT lang, term, count(*) n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, term) r FROM (SELECT lang, unnest(t) term FROM ({DOCS})) WHERE length(term) > 3 GROUP BY 1, 2) WHERE r <= 2 GROUP BY 1)")
def cluster_labels(spark, d):
    t = O.top_terms(_docs(spark, d), "lang", 2, 3).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("ts"))
    names = F.transform("ts", lambda x: F.concat(F.upper(F.left(x["term"], F.lit(1))), F.substring(x["term"], 2, 1 << 20)))
    return t.select(F.col("lang").alias("label"), F.array_join(names, " & ").alias("name"), F.element_at("ts", 1)["term"].alias("first_word"))


@query(
    f"""WITH s AS (SELECT doc_id, unnest(range(len(x))) pos, unnest(x) sentence FROM (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), '. '), lambda v: trim(v, ' ')), lambda v: length(v) > 10) x FROM documents)),
    m AS (SELECT *, len({WORDS.format('sentence')}) n, len(list_filter(list_transform(list_filter({WORDS.format('lower(sentence)')}, lambda w: length(w) > 2 AND w NOT IN ({STOPS})), lambda w: regexp_replace(w, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g')), lambda w: w <> '')) k FROM s),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(1.0 / (pos + 1) + CASE WHEN n BETWEEN 10 AND 30 THEN 0.5 ELSE 0.0 END + k / greatest(n, 1), 9) DESC, pos) r FROM m),
    t AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) total FROM r WHERE r <= 3)
    SELECT doc_id, string_agg(sentence, '. ' ORDER BY pos) summary, count(*) n_sentences FROM t WHERE total <= 150 OR total = n GROUP BY 1"""
)
def extractive_summaries(spark, d):
    return O.summaries(_docs(spark, d))


@query("SELECT lang AS label, avg(n_chars) mean_chars, avg(quality) mean_quality, count(*) n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def cluster_centroids(spark, d):
    return _docs(spark, d).join(table(spark, d, "labels"), "doc_id", "left").groupBy(F.col("lang").alias("label")).agg(F.avg("n_chars").alias("mean_chars"), F.avg("quality").alias("mean_quality"), F.count("*").alias("n"))


@query("SELECT a, b, CASE WHEN list_aggregate(x[1:len(x) - 1], 'string_agg', '/') = list_aggregate(y[1:len(y) - 1], 'string_agg', '/') THEN 0.9 ELSE (CASE WHEN x[1] <> y[1] THEN 0 WHEN x[2] <> y[2] THEN 1 WHEN x[3] <> y[3] THEN 2 ELSE 3 END) / 3.0 END similarity FROM (SELECT p.a, p.b, string_split(u.source || '/' || u.lang || '/' || u.doc_id, '/') x, string_split(v.source || '/' || v.lang || '/' || v.doc_id, '/') y FROM (" + PAIRS + ") p JOIN documents u ON u.doc_id = a JOIN documents v ON v.doc_id = b)")
def path_similarity(spark, d):
    path = _docs(spark, d).select("doc_id", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("p"))
    x, y = path.select(F.col("doc_id").alias("a"), F.col("p").alias("pa")), path.select(F.col("doc_id").alias("b"), F.col("p").alias("pb"))
    return alike(spark, d).join(x, "a").join(y, "b").select("a", "b", O.path_similarity(F.col("pa"), F.col("pb")).alias("similarity"))


@query()
def leader_clusters(spark, d):
    """Greedy clusters by shared words within the five best hits that bm25_batch finds for each benchmark item."""
    hits = bm25_batch(spark, d).select(F.col("query_id").cast("long").alias("query_id"), "doc_id")
    with Tables(spark, "leaders") as tables:
        hits = tables.release(tables.write(hits))
    few = hits.limit(ASKED_ROWS + 1).count() <= ASKED_ROWS
    # texts aren't shuffled to meet a few hits, and are cut into words behind the join
    met = _docs(spark, d).select("doc_id", "text").join(F.broadcast(hits) if few else hits, "doc_id")
    rows = met.select("query_id", F.col("doc_id").alias("id"), F.array_distinct(T.ascii_tokens(F.coalesce("text", F.lit("")))).alias("tokens"))

    def similar(a, b):
        x, y = set(a["tokens"]), set(b["tokens"])
        return bool(x | y) and len(x & y) / len(x | y) > 0.3

    return R.greedy_leaders(rows, similar)


@query()
def result_pipeline(spark, d):
    """Exact duplicates out, then summary, topics and highlights of what is left."""
    best = O.best_sentences(F.coalesce("text", F.lit(""))).alias("best")
    rows = _docs(spark, d).select("doc_id", T.content_key(F.col("text")).alias("key"), best)  # what is shuffled instead of the texts
    s = O.joined_summaries(O.first_of_duplicates(rows, F.col("key"), [F.asc("doc_id")]))
    return s.select("doc_id", T.highlight(F.col("summary"), ["the"]).alias("summary"), O.key_terms(T.ascii_tokens(F.col("summary")), 3).alias("topics"))
