"""Boolean queries as ranked searches: relevance, plan records, and what to do with text that isn't a query."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import storage
from ..operators import lexical
from ..operators.inverted import InvertedIndex
from . import ast, postings
from .ast import And, Node, Not, Or, Term
from .compile import boolean_search
from .parser import QueryError, parse

ASSUMED_DOCUMENTS = 1000  # of a plan record, before anything is counted


def scoring_terms(tree: Node) -> dict[str, float]:
    """Words of content that stand under an even number of NOTs, with the sum of their boosts."""
    out: dict[str, float] = {}
    todo = [(tree, True)]
    while todo:
        n, asked = todo.pop()
        match n:
            case And() | Or():
                todo += [(n.left, asked), (n.right, asked)]
            case Not():
                todo.append((n.inner, not asked))
            case Term(kind="word" | "phrase" | "near") if asked and n.field in (None, "content"):
                for w in re.findall("[a-z0-9]+", n.value.lower()):
                    out[w] = out.get(w, 0.0) + n.boost
    return out


def ranked_search(docs: DataFrame, index: InvertedIndex, text: str, fields: dict[str, str], k: int | None = 20) -> DataFrame:
    """(doc_id, score, rank): what the query matches, by the sum of boost * BM25 of its asked words.

    Matches without such a word (ranges, NOT) score 0; ties go to the smaller doc_id; rows of one doc_id count once."""
    tree = parse(text)
    weights = scoring_terms(tree)
    counts = index.document_counts(weights)
    told = lambda of: F.coalesce(F.lit(None), *(F.when(F.col("term") == w, F.lit(of[w])) for w in sorted(counts)))  # noqa: E731  a number for each word of the query, without a join
    found = index.of_terms(index.postings, counts).select(F.lit(1).alias("query_id"), "doc_id", "len", "tf", told(counts).alias("df"), told(weights).alias("boost"))
    scores = lexical.scored(found, index.corpus, F.col("boost")).select("doc_id", "score")
    hits = postings.search(docs, index, text, fields).distinct().join(scores, "doc_id", "left")
    full = hits.select(F.lit(1).alias("query_id"), "doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))
    return lexical.top_k(full, k).select("doc_id", "score", "rank")


def fallback(text: str) -> str:
    """Every word of a text that isn't a query, asked of the content. Words that are operators count as words."""
    words = re.findall(r"[^\W_]+", text)
    return " AND ".join(f'content:"{w}"' for w in words)


def answered(docs: DataFrame, text: str, fields: dict[str, str], intent_filters: list[str] = ()) -> DataFrame:
    """The hybrid executor: the text as a boolean query if it is one, else its words; filters of the intent narrow both."""
    try:
        parse(text)
    except QueryError:
        text = fallback(text)
    asked = [f"({text})"] * bool(text.strip()) + list(intent_filters)
    return boolean_search(docs, " AND ".join(asked), fields)


def steps(tree: Node, documents: int = ASSUMED_DOCUMENTS) -> Iterator[tuple[str, str, float, int, float]]:
    """(step, operation, selectivity, documents out, cost) of each node, operands first."""
    match tree:
        case And() | Or():
            yield from steps(tree.left, documents)
            yield from steps(tree.right, documents)
        case Not():
            yield from steps(tree.inner, documents)
    kind = "TermSearch" if isinstance(tree, Term) else "BooleanOperation" if isinstance(tree, And | Or | Not) else "IndexLookup"
    share = ast.selectivity(tree)
    yield kind, str(tree), round(share, 9), round(share * documents), ast.complexity(tree)


def cached_search(index: InvertedIndex, text: str, fields: dict[str, str]) -> DataFrame:
    """(doc_id) of what the query matches, computed once: saved beside the index under the canonical form of the query and the index's generation.

    Queries of one canonical form share a result; another generation, or the index of another file, has its own. Two who compute
    one at the same time write the same rows, each to a folder of its own, and the first that is published stays."""
    form = ast.show(ast.canonical(parse(text)))
    key = hashlib.sha256(json.dumps([form, sorted(fields.items()), index.folder, index.manifest.generation]).encode()).hexdigest()
    place = f"{index.folder}/results/{key}"
    published = storage.listed(index.spark, place)
    if not published:
        own = f"{index.folder}/result-tables/{uuid.uuid4().hex}"
        postings.indexed_search(index, text, fields).select("doc_id").write.parquet(own)
        try:
            storage.create(index.spark, f"{place}/table", own)
        except Exception:  # noqa: BLE001  somebody else was first
            storage.delete(index.spark, own)
            if not storage.listed(index.spark, place):
                raise
        published = storage.listed(index.spark, place)
    kind = f"doc_id {index.manifest.id_type}"
    return index.spark.read.schema(kind).parquet(storage.read(index.spark, published[0]))
