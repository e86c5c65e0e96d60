"""The stored index against passes over the texts."""

from __future__ import annotations

import fnmatch
import random

import pytest
from pyspark.sql import functions as F

from siltstone.boolean import compile, parser, postings
from siltstone.operators import inverted, lexical, topk

from .conftest import DATA

FIELDS = {"content": "text", "creator": "lang", "file_type": "lang", "size": "n_chars"}
ODD = [(1, "The cat, the dog"), (2, None), (3, ""), (None, "the lone cat"), (5, "cat " * 3000), (6, "dog the cat"), (6, "dog"), (7, "éa cat")]


def rows(df):
    return sorted((r.query_id, r["rank"], r.doc_id if r.doc_id is not None else -1, round(r.score, 9)) for r in df.collect())


def test_search_equals_a_pass_over_the_texts(spark, tmp_path):
    df = spark.createDataFrame([(*r, 9, "x") for r in ODD], "doc_id long, text string, len int, term string")
    q = spark.createDataFrame([(1, "the"), (1, "cat"), (1, "cat"), (2, "dog"), (3, "nothere"), (4, None)], "query_id int, term string")
    index = inverted.InvertedIndex.build(df, f"file://{tmp_path}/index")
    assert rows(index.search(q, 5)) == rows(lexical.bm25(df, q, 5)) != []
    assert index.corpus.first().n == len(ODD)
    assert {r.doc_id: r.hits for r in lexical.phrase_matches(index.postings, ["the", "cat"]).collect()} == {1: 1, 6: 1}
    empty = inverted.InvertedIndex.build(df.limit(0), f"file://{tmp_path}/empty")
    assert empty.search(q, 5).collect() == [] and index.search(q.limit(0), 5).collect() == []


def test_many_terms_are_joined(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inverted, "LITERAL_TERMS", 1)
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    q = spark.createDataFrame([(1, "the"), (2, "dog")], "query_id int, term string")
    assert rows(inverted.InvertedIndex.build(df, f"file://{tmp_path}/index").search(q, 5)) == rows(lexical.bm25(df, q, 5))


def test_scan_is_pruned_and_built_once(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    index = inverted.stored(docs)
    assert inverted.stored(spark.read.parquet(f"{DATA}/documents.parquet")) is index
    assert inverted.stored(docs.where(F.col("doc_id") < 5)) is not index
    found = index.of_terms(index.postings, spark.createDataFrame([("the",), ("scum",)], "term string"))
    assert "PushedFilters: [In(term" in found._jdf.queryExecution().toString() and found.count() > 0


TEXTS = ["the cat and the dog", "a dog", "cats, dogs and the bird", "the the the", "worthless words", "wordless worth", "fearless", "the bird of the cat", "dog of the bird", "kat"]


def numbered(spark, rows):
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else "de", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, n_chars long")


def asked():
    return [(1, "the"), (1, "cat"), (2, "dog"), (2, "bird"), (3, "of")]


def test_upkeep_equals_a_fresh_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inverted, "FAN", 3)
    root = f"file://{tmp_path}/kept"
    rng = random.Random(1)
    state = {i: " ".join(rng.choice("the cat dog bird of and red blue green one two".split()) for _ in range(rng.randint(1, 40))) for i in range(300)}
    index = inverted.InvertedIndex.build(numbered(spark, state.items()), root, fields=("lang", "n_chars"))
    for turn in range(4):
        new = {i: f"the {rng.choice(['cat', 'dog', 'bird'])} number {turn}" for i in rng.sample(range(300), 3)} | {1000 + turn: "a bird of the new"}
        gone = rng.sample(sorted(set(state) - set(new)), 3)
        index = index.upsert(numbered(spark, new.items())).delete(spark.createDataFrame([(g,) for g in gone], "doc_id long"))
        state = {i: t for i, t in (state | new).items() if i not in gone}
        opened = inverted.InvertedIndex.open(spark, root)
        assert opened.manifest == index.manifest and opened.manifest.docs == len(state)
        fresh = numbered(spark, state.items())
        assert rows(opened.search(asked(), 7)) == rows(lexical.bm25(fresh, spark.createDataFrame(asked(), "query_id int, term string"), 7)) != []
        assert sorted((r.term, r.df) for r in opened.terms.collect()) == sorted((r.term, r.df) for r in lexical.postings(fresh).groupBy("term").agg(F.count("*").alias("df")).collect())
        for text in ("the AND NOT cat", "cat OR bird", "NOT the", "type:en AND dog", '"of the"', "b?rd"):
            want = {r.doc_id for r in compile.boolean_search(fresh, text, FIELDS).collect()}
            assert {r.doc_id for r in postings.indexed_search(opened, text, FIELDS).collect()} == want, text
    assert len(opened.manifest.segments) < 1 + 4 and opened.manifest.dead_docs > 0  # small segments were merged
    whole = opened.merge()
    whole.vacuum()
    assert len(whole.manifest.segments) == 1 and whole.manifest.dead is None and whole.manifest.docs == len(state)
    assert rows(inverted.InvertedIndex.open(spark, root).search(asked(), 7)) == rows(lexical.bm25(fresh, spark.createDataFrame(asked(), "query_id int, term string"), 7))
    assert len(inverted.shared.listed(spark, f"{root}/segments")) == 1


def test_a_small_change_writes_a_small_segment(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    index = inverted.InvertedIndex.build(docs, f"file://{tmp_path}/a", fields=("lang",))
    some = docs.limit(2).select("doc_id", F.concat(F.lit("changed "), F.substring("text", 1, 200)).alias("text"), "lang")
    grown = index.fork(f"file://{tmp_path}/b").upsert(some)
    assert [s.path for s in grown.manifest.segments][:1] == [s.path for s in index.manifest.segments]  # what was there stays as it is
    old, new = (sum(f.stat().st_size for f in (tmp_path / d / "segments").rglob("*.parquet")) for d in "ab")
    assert new < old / 5 and grown.manifest.docs == index.manifest.docs
    assert index.document_counts(["changed"]) == {} and grown.document_counts(["changed"]) == {"changed": 2}


def test_two_writers_of_one_generation(spark, tmp_path):
    index = inverted.InvertedIndex.build(numbered(spark, enumerate(TEXTS)), f"file://{tmp_path}/index")
    ids = spark.createDataFrame([(1,)], "doc_id long")
    index.delete(ids)
    with pytest.raises(Exception, match="exists"):
        index.delete(ids)


def test_pruned_search_reads_fewer_blocks(spark, tmp_path, monkeypatch):
    rng = random.Random(6)
    words = "the of cat dog bird red blue green one two three four".split()
    state = [(i, " ".join(rng.choices(words, weights=[20, 9, *[3] * 10], k=rng.choice((3, 8, 30, 200))))) for i in range(6000)]
    docs = numbered(spark, state)
    index = inverted.InvertedIndex.build(docs.repartition(2), f"file://{tmp_path}/index")
    q = [(1, "the"), (1, "of"), (2, "cat"), (2, "dog"), (3, "nothere"), (4, "bird")]
    want = rows(index.scored_in_full(spark.createDataFrame(q, "query_id int, term string"), 5))
    search = topk.TopK(index, q, "int", 5)
    every, read = search.bounds.count(), search.planned_survivors()
    assert rows(search.best()) == rows(index.search(q, 5)) == want != []
    assert 0 < len(read) < every / 2, (len(read), every)
    monkeypatch.setattr(topk, "SEED_ROWS", 0)
    assert sorted(topk.TopK(index, q, "int", 5).planned_survivors()) == sorted(read)
    monkeypatch.setattr(topk, "PLANNED", 0)  # bounds by jobs
    search = topk.TopK(index, q, "int", 5)
    assert sorted((r.query_id, r.block) for r in search.survivors_by_job().collect()) == sorted(read) and rows(search.best()) == want
    # more than there are: nothing is pruned
    assert index.search(q, 7000).count() == index.scored_in_full(spark.createDataFrame(q, "query_id int, term string"), None).count()


def test_dictionary(spark, tmp_path):
    index = inverted.InvertedIndex.build(numbered(spark, enumerate(TEXTS)), f"file://{tmp_path}/index")
    terms = [r.term for r in index.dictionary.collect()]
    for pattern in ("wor*less", "w*th*", "?at", "*", "c*", "*s", "do?", "wor????ss", "cat", "*ear*"):
        want = {t for t in terms if fnmatch.fnmatchcase(t, pattern)}
        assert {r.term for r in index.like(pattern).collect()} == want, pattern
    for word, far in (("worthles", 1), ("cat", 1), ("dg", 1), ("birds", 2), ("fearles", 3), ("the", 0)):
        want = {t for t in terms if edits(t, word) <= far}
        assert {r.term for r in index.near_terms(word, far).collect()} == want, word


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_boolean_queries_read_no_texts(spark):
    from siltstone.plans.search import BOOLEAN, FIELDS

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, (text, _) in BOOLEAN.items():
        plan = postings.search(docs, inverted.stored(docs), text, FIELDS)._jdf.queryExecution().toString()
        assert ("documents.parquet" in plan) == (name == "boolean_regex"), name


ASKED = ["", "NOT cat", "cat NOT dog", "(the OR type:de) AND NOT (cat AND dog)", "NOT (NOT the OR type:en)", "w*th OR size:<6", "dog~1 AND NOT type:en", '"the bird"', '"bird cat"~4', "c.t", "!!!x", "author:* OR kat", "worth-less", "*"]


def test_boolean_over_postings_equals_a_pass_over_the_texts(spark, tmp_path):
    docs = numbered(spark, [*enumerate(TEXTS), (50, None), (51, ""), (None, "the lone cat")])
    index = inverted.InvertedIndex.build(docs.repartition(3), f"file://{tmp_path}/index", fields=("lang", "n_chars"))

    def ids(df):
        return sorted(r.doc_id if r.doc_id is not None else -1 for r in df.select("doc_id").collect())

    for text in ASKED:
        assert ids(postings.indexed_search(index, text, FIELDS)) == ids(compile.boolean_search(docs, text, FIELDS)), text
    for text in ("nofield:x", "cat )"):
        with pytest.raises(parser.QueryError):
            postings.indexed_search(index, text, FIELDS)


def test_equivalent_queries_share_a_result(spark, tmp_path):
    from siltstone.boolean import ast, execute

    forms = {
        "a AND b": ["b AND a", "b a", "a AND b AND a", "(a OR c) AND b AND a", "NOT NOT (b AND a)"], "a OR (b AND c)": ["(c AND b) OR a", "a OR (c AND b) OR (a AND d)", "(b AND c) OR (a OR a)"], "NOT a": ["NOT NOT NOT a"],
        "x": ["x OR x", "x AND (x OR y)"], "(a OR b) AND (c OR d)": ["(d OR c) AND (b OR a)"], "a NOT b": ["(NOT b) AND a"],
    }
    keys = {form: {ast.show(ast.canonical(parser.parse(t))) for t in [form, *others]} for form, others in forms.items()}
    assert all(len(k) == 1 for k in keys.values()) and len({min(k) for k in keys.values()}) == len(forms)
    index = inverted.InvertedIndex.build(numbered(spark, enumerate(TEXTS)), f"file://{tmp_path}/index", fields=("lang", "n_chars"))
    results = f"file://{tmp_path}/index/results"

    def ask(i, text):
        return sorted(r.doc_id for r in execute.cached_search(i, text, FIELDS).collect())

    assert ask(index, "the AND cat") == ask(index, "cat AND (the OR dog) AND the") == [0, 7]
    assert len(inverted.shared.listed(spark, results)) == 1
    changed = index.delete(spark.createDataFrame([(7,)], "doc_id long"))
    assert ask(changed, "the AND cat") == [0] and ask(index, "cat AND the") == [0, 7] and len(inverted.shared.listed(spark, results)) == 2


def test_two_sessions_build_one_index(spark, tmp_path):
    docs = numbered(spark, enumerate(TEXTS))
    first = inverted._built(docs, f"file://{tmp_path}/index", ["lang"])
    assert inverted._built(docs, f"file://{tmp_path}/index", ["lang"]).manifest == first.manifest


def test_many_queries_read_each_row_once(spark, tmp_path, monkeypatch):
    """Queries that share terms don't carry the rows of these terms each through a shuffle; ties go to the smaller id, deleted documents are left out."""
    rng = random.Random(6)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(500)]
    df = spark.createDataFrame([(i * 7919 % 1000, t) for i, t in enumerate(texts + texts[:50])] + [(None, "w1 w2")], "doc_id long, text string")
    q = spark.createDataFrame([(i, w) for i in range(40) for w in rng.sample(words, 30)] + [(99, "w1"), (98, "none")], "query_id int, term string")
    index = inverted.InvertedIndex.build(df.repartition(3), f"file://{tmp_path}/index").delete(df.limit(5))
    left = df.join(df.limit(5).select("doc_id"), "doc_id", "left_anti")
    want = rows(lexical.bm25(left, q, 5))
    monkeypatch.setattr(topk, "PLANNED", 0)
    monkeypatch.setattr(topk, "RANGE", 2)
    monkeypatch.setattr(topk.TopK, "survivors_by_job", None)  # it joins rows with the queries
    assert rows(index.search(q, 5)) == want != []
