"""Text functions over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stemming
from ..functions import text as T
from .catalog import query, table

FOLDED = "trim(regexp_replace({}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ')"
WORDS = "list_filter(regexp_split_to_array({}, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')"
TOKENS = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda w: w <> '')"
STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


@query(f"SELECT doc_id, sha256({FOLDED.format('text')}) folded, len({WORDS.format('text')}) n_words, greatest(len(regexp_extract_all(text, '[.!?]+[ \\t\\n\\x0B\\f\\r]+')), 1) n_sentences FROM documents")
def text_measures(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.sha2(T.folded(t), 256).alias("folded"), T.word_count(t).alias("n_words"), T.sentence_count(t).alias("n_sentences"))


@query(f"SELECT doc_id, len({WORDS.format('text')}) >= 3 AND length(trim(text)) >= 20 AND length(text) / greatest(len({WORDS.format('text')}), 1) > 2.0 meaningful FROM documents")
def meaningful_content(spark, d):
    return table(spark, d, "documents").select("doc_id", T.meaningful(F.col("text")).alias("meaningful"))


@query(
    f"""SELECT doc_id, lang, CASE WHEN length(text) < 50 THEN NULL WHEN len(list_filter(w, lambda x: x IN ('the', 'and', 'or', 'is', 'are', 'was', 'were'))) > len(w) // 10 THEN 'en' ELSE 'unknown' END guessed
    FROM (SELECT doc_id, lang, text, ({WORDS.format('lower(text)')})[1:100] w FROM documents)"""
)
def language_detection(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", T.language(F.col("text")).alias("guessed"))


@query(
    f"""WITH g AS (SELECT lang, CASE WHEN length(text) < 50 THEN NULL WHEN len(list_filter(w, lambda x: x IN ('the', 'and', 'or', 'is', 'are', 'was', 'were'))) > len(w) // 10 THEN 'en' ELSE 'unknown' END guessed
    FROM (SELECT lang, text, ({WORDS.format('lower(text)')})[1:100] w FROM documents)) SELECT lang, guessed, count(*) n FROM g GROUP BY ALL"""
)
def language_confusion(spark, d):
    return table(spark, d, "documents").select("lang", T.language(F.col("text")).alias("guessed")).groupBy("lang", "guessed").agg(F.count("*").alias("n"))


@query("SELECT doc_id, sha256(list_aggregate(s, 'string_agg', '|')) sentences, len(s) n FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?]+)[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: x <> '') s FROM documents) WHERE len(s) > 0")
def sentence_split(spark, d):
    s = table(spark, d, "documents").select("doc_id", T.sentences(F.col("text")).alias("s")).where(F.size("s") > 0)
    return s.select("doc_id", F.sha2(F.array_join("s", "|"), 256).alias("sentences"), F.size("s").alias("n"))


@query("SELECT doc_id, len(list_filter(list_transform(string_split(text, '. '), lambda x: trim(x, ' ')), lambda x: length(x) > 10)) n FROM documents")
def summary_sentence_split(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.summary_sentences(F.col("text"))).alias("n"))


def _checked(sql: str, pattern: str, right: str, mark: str) -> str:
    """What matches and passes a test on x, replaced by a mark."""
    cut = f"string_split(regexp_replace(replace({sql}, chr(1), ''), '({pattern})', chr(1) || '\\1' || chr(1), 'g'), chr(1))"
    return f"array_to_string(list_transform({cut}, lambda x, i: CASE WHEN i % 2 = 0 AND {right} THEN '{mark}' ELSE x END), '')"


DIGITS = "regexp_replace(x, '[ -]', '', 'g')"
LUHN = f"list_sum(list_transform(range(1, length({DIGITS}) + 1), lambda k: CASE WHEN (length({DIGITS}) - k) % 2 = 1 THEN CAST({DIGITS}[k] AS INT) * 2 // 10 + CAST({DIGITS}[k] AS INT) * 2 % 10 ELSE CAST({DIGITS}[k] AS INT) END)) % 10 = 0"
KEY = "regexp_matches(x, '[A-Za-z]') AND regexp_matches(x, '[0-9]')"
SECRET_CARDS = _checked("text", T.CARD_LIKE, LUHN, "[REDACTED-CARD]")
SENSITIVE_MARKS = _checked(_checked("text", T.CARD_LIKE, LUHN, "[REDACTED]"), T.KEY_LIKE, KEY, "[REDACTED]")


def _nested(sql: str, patterns) -> str:
    for p, r in patterns:
        sql = "regexp_replace({}, '{}', '{}', 'g')".format(sql, p.replace("'", "''"), r)
    return sql


@query(f"SELECT doc_id, sha256(r) redacted, r <> text changed FROM (SELECT doc_id, text, {_nested(SECRET_CARDS, T.SECRET_PATTERNS)} r FROM documents)")
def secret_redaction(spark, d):
    r = table(spark, d, "documents").select("doc_id", "text", T.redact_secrets(F.col("text")).alias("r"))
    return r.select("doc_id", F.sha2("r", 256).alias("redacted"), (F.col("r") != F.col("text")).alias("changed"))


@query(f"SELECT doc_id, sha256(r) redacted, r <> text changed FROM (SELECT doc_id, text, {_nested(SENSITIVE_MARKS, [(p, '[REDACTED]') for p in T.SENSITIVE_PATTERNS])} r FROM documents)")
def sensitive_redaction(spark, d):
    r = table(spark, d, "documents").select("doc_id", "text", T.redact_sensitive(F.col("text")).alias("r"))
    return r.select("doc_id", F.sha2("r", 256).alias("redacted"), (F.col("r") != F.col("text")).alias("changed"))


@query("SELECT doc_id, len(regexp_extract_all(h, '<mark>')) marks, sha256(h) highlighted FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '(?i)\\b(the)\\b', '<mark>\\1</mark>', 'g'), '(?i)\\b(was)\\b', '<mark>\\1</mark>', 'g') h FROM documents)")
def highlighting(spark, d):
    h = table(spark, d, "documents").select("doc_id", T.highlight(F.col("text"), ["the", "was"]).alias("h"))
    return h.select("doc_id", F.regexp_count("h", F.lit("<mark>")).alias("marks"), F.sha2("h", 256).alias("highlighted"))


@query("SELECT doc_id, CASE WHEN p > 0 THEN replace(substr(text, s, 150 + p - s), 'with', '<mark>with</mark>') ELSE substr(text, 1, 200) END snippet FROM (SELECT doc_id, text, p, greatest(p - 50, 1) s FROM (SELECT doc_id, text, instr(lower(text), 'with') p FROM documents))")
def snippets(spark, d):
    return table(spark, d, "documents").select("doc_id", T.snippet(F.col("text"), "with").alias("snippet"))


@query(
    """SELECT page_id, sha256(trim(regexp_replace(x, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ')) plain FROM (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(
    regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'),
    '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') x FROM pages)"""
)
def html_to_text(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(T.strip_html(F.col("html")), 256).alias("plain"))


@query("SELECT doc_id, sha256(regexp_replace(lower(text), '[^a-z0-9\\s]', '', 'g')) content_key FROM documents WHERE false OR true")
def content_keys(spark, d):
    return table(spark, d, "documents").select("doc_id", T.content_key(F.col("text")).alias("content_key"))


@query(f"SELECT doc_id, len(t) n_tokens, len(list_distinct(t)) n_distinct FROM (SELECT doc_id, {TOKENS.format('text')} t FROM documents)")
def tokenised(spark, d):
    t = table(spark, d, "documents").select("doc_id", T.ascii_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"))


@query(
    f"""SELECT doc_id, len(list_filter(list_transform(list_filter({WORDS.format('lower(text)')}, lambda w: length(w) > 2 AND w NOT IN ({STOPS})), lambda w: regexp_replace(w, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g')), lambda w: w <> '')) n FROM documents"""
)
def meaningful_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.meaningful_tokens(F.col("text"))).alias("n"))


@query()
def stemmed_vocabulary(spark, d):
    """Document frequency of Porter stems; checked against a table of stems in the tests."""
    t = table(spark, d, "documents").select("doc_id", F.explode(stemming.stems(F.array_distinct(T.ascii_tokens(F.col("text"))))).alias("stem"))
    return t.groupBy("stem").agg(F.countDistinct("doc_id").alias("df"))


@query("SELECT turn, role, count(*) n, avg(length(text)) mean_length FROM conversations GROUP BY turn, role")
def conversation_turns(spark, d):
    return table(spark, d, "conversations").groupBy("turn", "role").agg(F.count("*").alias("n"), F.avg(F.length("text")).alias("mean_length"))
