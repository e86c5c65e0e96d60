"""What queries shuffle, sort and build grows no faster than their tables need."""

from __future__ import annotations

import random
import re
import time
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from siltstone.boolean import execute
from siltstone.functions import text as T
from siltstone.operators import inverted, lexical, nearhits, results
from siltstone.plans.catalog import load

TEXTS = ["the cat and the dog", "a dog", None, "", "of the dog. cats, dogs and the bird", "the the the of the", "éa with the cat", "with from scum", "from with the"]


def docs_of(spark, n=1):
    rows = [(len(TEXTS) * k + i, t, "en", "src1", len(t or "")) for k in range(n) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_queries_of_fields_build_no_index(spark, tmp_path):
    docs_of(spark).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("boolean_exists", "boolean_field", "boolean_range", "boolean_comparison", "boolean_regex"):
        before = set(inverted._KEPT)
        got = load()[name].build(spark, str(tmp_path))
        assert got.columns == ["doc_id"] and set(inverted._KEPT) == before, name
    assert load()["boolean_exists"].build(spark, str(tmp_path)).count() == len(TEXTS)


def test_postings_are_made_by_runs_without_a_shuffle_of_words(spark, tmp_path, monkeypatch):
    docs = docs_of(spark, 50).repartition(3).select("doc_id", "text", "lang")
    monkeypatch.setattr(inverted, "RUN", 2000)
    index = inverted.InvertedIndex.build(docs, f"file://{tmp_path}/index", fields=("lang",))
    own = lambda df: sorted((r.term, r.doc_id, r.tf, r.positions) for r in df.collect())
    assert own(index.postings.select("term", "doc_id", "tf", "positions")) == own(lexical.postings(docs))
    assert sorted(r.doc_id for r in index.docs.collect()) == list(range(50 * len(TEXTS))) and index.manifest.unique
    assert index.docs.select("block", "slot").distinct().count() == 50 * len(TEXTS) and index.docs.groupBy("block").count().where("count > 64").isEmpty()
    made = spark.read.parquet(index.manifest.segments[0].path + "/postings")
    assert made.where("term IS NULL").select("docs").count() > 50 * len(TEXTS) / 64  # several runs
    assert index.merge().postings.count() == index.postings.count()


def test_ranked_search_joins_nothing_by_term(spark, tmp_path):
    docs = docs_of(spark)
    index = inverted.InvertedIndex.build(docs, f"file://{tmp_path}/index", fields=("lang",))
    fields = {"content": "text", "file_type": "lang"}
    got = execute.ranked_search(docs, index, 'the^2 AND (from OR "of the" OR nothere)', fields, 5)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Join" in line and "term" in line for line in plan.splitlines()), plan
    plain = {(r.doc_id, r.term): r for r in lexical.postings(docs).where("term IN ('the', 'from', 'of')").collect()}
    assert [r.doc_id for r in got.collect()] and {r.doc_id for r in got.collect()} == {d for d, t in plain if t == "the"} & ({d for d, t in plain if t == "from"} | {4, 5})
    assert execute.ranked_search(docs, index, "nothere OR type:en", fields, 3).count() == 3


def test_topics_of_a_long_text_take_no_pass_for_each_word(spark):
    rng = random.Random(23)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(20_000)]
    texts = [" ".join(words), " ".join(words[:50] * 3 + words[40:90] * 2), "", "abc de", "abcde", "zzzzz abcde zzzzz abcde mmmmm", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    started = time.time()
    got = {r.doc_id: r.k for r in rows.select("doc_id", results.key_terms(T.ascii_tokens(F.col("text")), 3).alias("k")).collect()}
    assert time.time() - started < 30  # minutes, when each different word was counted by a pass over the text
    for i, t in enumerate(texts):
        counts = Counter(w for w in re.findall("[a-z0-9]+", t or "") if len(w) > 4)
        assert got[i] == (None if t is None else [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:3]])


def test_result_pipeline_shuffles_no_texts(spark, tmp_path):
    docs_of(spark).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = load()["result_pipeline"].build(spark, str(tmp_path))
    exchanges = re.findall(r"Exchange.*\n.*", got._jdf.queryExecution().executedPlan().toString())
    windows = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Project" in line and "text#" in line]
    assert exchanges and all("best" in line and "key" in line for line in windows), windows
    assert {r.doc_id: r.summary for r in got.collect()} == {0: "<mark>the</mark> cat and <mark>the</mark> dog", 4: "cats, dogs and <mark>the</mark> bird", 5: "<mark>the</mark> <mark>the</mark> <mark>the</mark> of <mark>the</mark>", 6: "éa with <mark>the</mark> cat", 7: "with from scum", 8: "from with <mark>the</mark>"}


def test_sketches_hash_each_word_of_a_part_once(monkeypatch):
    rng = random.Random(25)
    words = ["".join(rng.choice("abcdef0") for _ in range(5)) for _ in range(300)]
    texts = ["", "...", "é", "a", " a", "a-a", "a a", "aéa b", "b a a", *(" ".join(rng.choices(words, k=80)) for _ in range(200))]
    texts += [" ".join(reversed(t.split())) for t in texts[9:60]]
    calls, mixed = [], nearhits._mixed
    monkeypatch.setattr(nearhits, "_mixed", lambda x, *room: (calls.append(x.size), mixed(x, *room))[1])
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["id", "t"])
    rows = pa.Table.from_batches([b for at in (0, 100) for b in nearhits._sketch([batch.slice(at, 100 if at == 0 else len(texts))])]).to_pylist()
    counts = [Counter(re.findall("[a-z0-9]+", t)) for t in texts]
    assert [r["id"] for r in rows] == [i for i, c in enumerate(counts) if c]
    classes = lambda key: sorted(map(sorted, {k: [r["id"] for r in rows if key(r) == k] for k in map(key, rows)}.values()))
    assert classes(lambda r: r["same"]) == classes(lambda r: repr(sorted(counts[r["id"]].items()))) and len({len(r["keys"]) for r in rows}) == 1
    assert {(tuple(r["keys"]), r["signs"]) for r in rows if r["id"] in (3, 4, 5, 6)} == {(tuple(rows[0]["keys"]), rows[0]["signs"])}  # sets are equal
    assert sum(calls) < nearhits.BANDS * nearhits.ROWS * 4 * (len(words) + len(texts))  # not that of all words of all texts


def test_links_are_those_of_each_key_over_batches():
    rng = random.Random(26)
    signs = [bytes([rng.randrange(256)] * nearhits.SIGNS) for _ in range(3)]
    rows = sorted((rng.randrange(60), i, rng.choice(signs)) for i in range(150))
    rows += [(99, i, signs[0]) for i in range(150, 180)]
    want = {(min(j for k, j, y in rows if (k, y) == (key, s)), i) for key, i, s in rows}
    for n in (1, 7, 1000):
        parts = [pa.record_batch([pa.array([r[c] for r in rows[at : at + n]], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["key", "id", "signs"]) for at in range(0, len(rows), n)]
        got = pa.Table.from_batches(list(nearhits._links(0.5, False)(iter([parts[0].slice(0, 0), *parts])))).to_pylist()
        assert sorted((r["a"], r["b"]) for r in got) == sorted(x for x in want if x[0] != x[1]), n
        told = pa.Table.from_batches(list(nearhits._links(0.5, True)(iter(parts)))).to_pylist()
        assert sorted(r["b"] for r in told if r["key"] is None) == sorted(set(range(180)) - {r["a"] for r in told if r["key"] is not None})
    assert {r["a"] for r in told if r["key"] is not None} == {a for a, _ in want}
