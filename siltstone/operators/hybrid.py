"""Query analysis, routing and fusion of lexical and vector hits."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words that mark kinds of queries.
QUESTION_WORDS = ["what", "when", "where", "who", "why", "how", "which"]
FACTUAL_WORDS = ["define", "definition", "meaning", "explain", "describe", "list", "name"]
CONCEPTUAL_WORDS = ["similar", "like", "related", "about", "concept", "idea", "theory", "approach"]
RRF_K = 60


@dataclass(frozen=True)
class Mode:
    text: float
    vector: float
    threshold: float
    k: int
    out: int


#: Weights, similarity threshold, candidates and results of each mode.
MODES = {"precise": Mode(0.8, 0.2, 0.5, 15, 8), "balanced": Mode(0.4, 0.6, 0.3, 20, 10), "exploratory": Mode(0.2, 0.8, 0.2, 25, 12)}


def analysed(queries: DataFrame, text: str = "text") -> DataFrame:
    """keywords, phrases, flags, complexity and suggested mode for each query."""
    q = F.col(text)
    low = F.lower(q)
    phrases = F.regexp_extract_all(q, F.lit(r'"([^"]*)"'), 1)
    bare = F.regexp_replace(F.regexp_replace(q, r'"[^"]*"', " "), r"\b(AND|OR|NOT)\b", " ")
    keywords = F.filter(F.transform(F.split(F.lower(bare), r"\s+"), lambda w: F.regexp_replace(w, r"^[^a-z0-9]+|[^a-z0-9]+$", "")), lambda w: (F.length(w) > 2) & w.rlike("[a-z]"))
    any_of = lambda ws: F.exists(F.split(low, r"[^a-z]+"), lambda w: w.isin(ws))
    out = queries.select(
        "*", phrases.alias("phrases"), keywords.alias("keywords"), q.rlike(r"\b(AND|OR|NOT)\b").alias("has_boolean"),
        any_of(QUESTION_WORDS + FACTUAL_WORDS).alias("factual"), any_of(CONCEPTUAL_WORDS).alias("conceptual"),
    )
    num = lambda c, w: F.when(F.col(c), F.lit(w)).otherwise(F.lit(0.0))
    complexity = F.size("keywords") * 0.1 + F.size("phrases") * 0.3 + num("has_boolean", 0.4) + num("factual", 0.2) + num("conceptual", 0.3)
    out = out.withColumn("complexity", F.round(complexity, 6))
    exact = F.col("has_boolean") | (F.size("phrases") > 0) | (F.col("factual") & (F.col("complexity") < 0.5))
    return out.withColumn("mode", F.when(exact, "precise").when(F.col("conceptual") | (F.col("complexity") > 0.8), "exploratory").otherwise("balanced"))


def route(has_structure: bool, conceptual: bool, mode: str) -> str:
    if mode == "precise" and has_structure:
        return "lexical"
    return "semantic" if mode == "exploratory" and conceptual else "fusion"


def prepared_fts(text: str) -> str:
    """A query for a full-text index: as it is if it has quotes or operators, else its words as alternatives by prefix."""
    if '"' in text or " AND " in text or " OR " in text:
        return text
    words = [re.sub(r"[*:()]", "", w).replace('"', '""') for w in text.split()]
    return " OR ".join(f"{w}*" for w in words if w)


def built_fts(keywords: list[str], phrases: list[str], factual: bool, raw: str) -> str:
    """Quoted phrases win; two keywords are a phrase or both; up to three a phrase; more a chain of ANDs."""
    if phrases:
        return " AND ".join(f'"{p}"' for p in phrases)
    if len(keywords) == 2 and not factual:
        a, b = keywords
        return f'"{a} {b}" OR ({a} AND {b})'
    if keywords and len(keywords) <= 3:
        return '"' + " ".join(keywords) + '"'
    return " AND ".join(keywords) if keywords else raw


def ranked(hits: DataFrame, id_: str, score: str = "score") -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round(score, 9)), id_)
    return hits.withColumn("rank", F.row_number().over(w))


def rrf(lexical: DataFrame, vector: DataFrame, mode: Mode, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two ranked hit lists (query_id, id, rank); ties to the smaller id."""
    a = lexical.select("query_id", "id", F.col("rank").alias("text_rank"))
    b = vector.select("query_id", "id", F.col("rank").alias("vector_rank"))
    both = a.join(b, ["query_id", "id"], "full")
    score = F.coalesce(mode.text / (k + F.col("text_rank")), F.lit(0.0)) + F.coalesce(mode.vector / (k + F.col("vector_rank")), F.lit(0.0))
    out = ranked(both.withColumn("score", score), "id")
    return out.where(F.col("rank") <= mode.out)


def primary(first: DataFrame, second: DataFrame, first_weight: float, second_weight: float, out: int, dedupe: bool = True) -> DataFrame:
    """One side leads, the other adds at 0.3 of its weight; an item of both counts once unless dedupe is off."""
    both = first.select("query_id", "id", (F.col("score") * first_weight).alias("score")).unionByName(second.select("query_id", "id", (F.col("score") * second_weight * 0.3).alias("score")))
    if dedupe:
        both = both.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return ranked(both, "id").where(F.col("rank") <= out)


def match_label(text_rank: Column, vector_rank: Column) -> Column:
    return F.when(text_rank.isNotNull() & vector_rank.isNotNull(), "hybrid").when(text_rank.isNotNull(), "exact").otherwise("semantic")
