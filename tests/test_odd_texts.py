"""Queries against their SQL on texts without words, with control signs and with letters whose lower case is two signs."""

from __future__ import annotations

import duckdb
import pyarrow as pa
import pytest

from siltstone.operators import inverted, lexical
from siltstone.plans.catalog import load

from .conftest import same

TEXTS = [None, "", " ", "...", "éé", "the cat", "a dog", "İthe cat", "theİ dog. The İb word here of it. And so it goes on", "a\u0001b", "\u0001", "one.\u0001 two\u0001", "x. \u0001y! z", "No. 1 İİ ab. aa bb cc dd ee. " * 3]


@pytest.mark.parametrize("name", ["boolean_not", "boolean_symbols", "extractive_summaries", "chunk_packing", "chunk_merge", "chunk_validation", "sentence_split"])
def test_equals_sql_on_odd_texts(spark, tmp_path, name):
    docs = spark.createDataFrame([(i, t, "en", "src1", len(t or "")) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    q = load()[name]
    same(q.build(spark, str(tmp_path)), duck.execute(q.sql))


def test_postings_shuffle_texts_not_words(spark):
    docs = spark.createDataFrame([(1, "a b a"), (1, "b"), (2, None)], "doc_id long, text string")
    posts = lexical.postings(docs)
    assert sorted((r.term, r.doc_id, r.tf, r.positions) for r in posts.collect()) == [("a", 1, 2, [0, 2]), ("b", 1, 2, [0, 1])]
    plan = posts._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan and "hashpartitioning(term" not in plan


def test_postings_of_a_block_are_made_where_its_documents_are():
    rows = pa.table({"block": [7] * 4, "slot": pa.array([63, 0, 2, 5], pa.int32()), "doc_id": [9, 1, None, 4], "len": pa.array([1, 3, 2, 0], pa.int32()), "tokens": [["b"], ["a", "b", "a"], ["b", "b"], []]})
    got = {r["term"]: r for r in inverted._block_postings(rows).to_pylist()}
    assert got["a"] == {"term": "a", "block": 7, "bits": 1, "max_tf": 2, "min_len": 3, "slots": [0], "doc_ids": [1], "lens": [3], "tfs": [2], "places": [[0, 2]]}
    assert got["b"] == {"term": "b", "block": 7, "bits": 5 - 2**63, "max_tf": 2, "min_len": 1, "slots": [0, 2, 63], "doc_ids": [1, None, 9], "lens": [3, 2, 1], "tfs": [1, 2, 1], "places": [[1], [0, 1], [0]]}
    assert len(got) == 2 and inverted._block_postings(rows.slice(3)).num_rows == 0
