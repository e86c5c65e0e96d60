"""Operators that SQL doesn't express, against plain loops, and their edge cases."""

from __future__ import annotations

import datetime
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.boolean import ast
from siltstone.boolean.parser import QueryError, parse
from siltstone.functions import text as T
from siltstone.functions.stemming import stem
from siltstone.operators import behaviour, chunk, hybrid, metrics, rank, security, understand, vectors
from siltstone.sources import files
from siltstone.storage import Tables


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("hello", "hello"), ("hello AND world", "(hello AND world)"), ("author:john", "creator:john"), ('"hello world"', '"hello world"'),
        ("(author:john OR author:jane) AND type:pdf", "((creator:john OR creator:jane) AND file_type:pdf)"), ("a NOT b", "(a AND NOT b)"), ("NOT NOT a", "NOT NOT a"),
        ("a b OR c", "((a AND b) OR c)"), ("size:>10MB", "size:{10MB TO *}"), ("foo*^2", "foo*^2"), ("x && !y || z", "((x AND NOT y) OR z)"), ('"a b"~3', '"a b"~3'), ("(a OR b", "(a OR b)"), ("", ""),
        ("\u201ca b\u201d", '"a b"'),
    ],
)
def test_parser(text, want):
    assert str(parse(text)) == want


@pytest.mark.parametrize("text", ["AND", "a AND", ")", "NOT"])
def test_parser_rejects(text):
    with pytest.raises(QueryError):
        parse(text)


@settings(max_examples=100, deadline=None)
@given(st.recursive(st.sampled_from("abc").map(ast.Term), lambda s: st.one_of(st.builds(ast.And, s, s), st.builds(ast.Or, s, s), st.builds(ast.Not, s)), max_leaves=8))
def test_simplified_keeps_meaning(tree):
    def value(n, env):
        match n:
            case ast.Term():
                return env[n.value]
            case ast.And():
                return value(n.left, env) and value(n.right, env)
            case ast.Or():
                return value(n.left, env) or value(n.right, env)
            case ast.Not():
                return not value(n.inner, env)

    for k in range(8):
        env = dict(zip("abc", (bool(k & 1), bool(k & 2), bool(k & 4)), strict=True))
        assert value(tree, env) == value(ast.simplified(tree), env) == value(parse(str(tree)), env)


@pytest.mark.parametrize(("word", "want"), [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("plastered", "plaster"), ("hopping", "hop"), ("filing", "file"), ("relational", "relat"), ("conditional", "condit"), ("happy", "happi"), ("triplicate", "triplic"), ("adjustment", "adjust"), ("controlling", "control"), ("sky", "sky"), ("generalizations", "gener")])
def test_stems(word, want):
    assert stem(word) == want


def test_sentence_chunks_equal_a_loop(spark):
    rng = random.Random(1)
    texts = [" ".join("w" * rng.randint(1, 9) + rng.choice(["", "", ".", "!"]) for _ in range(n)) for n in (0, 1, 50, 900, 2000)] + [None, "x" * 4000]
    o = chunk.ChunkOptions()
    got: dict[int, list[str]] = {}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in chunk.sentence_chunks(df, o).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append(r.content)

    def loop(text):
        import re

        text = " ".join((text or "").split())
        if len(text) <= o.max_size:
            return [text] if text else []
        out, cur = [], ""
        for s in (x.strip() for x in re.sub(r"([.!?]+)\s+", "\\1\u0001", text).split("\u0001")):
            if not s:
                continue
            if cur and len(cur) + 1 + len(s) > o.max_size:
                out.append(cur)
                n = int(len(cur) * o.overlap)
                tail = cur[-n:] if n else ""
                tail = tail[tail.index(" ") + 1 :] if " " in tail else tail
                cur = f"{tail} {s}" if tail else s
            else:
                cur = f"{cur} {s}" if cur else s
        return [*out, cur] if cur else out

    assert got == {i: c for i, t in enumerate(texts) if (c := loop(t))}


def test_character_chunks_cover(spark):
    o = chunk.ChunkOptions(target=50)
    text = "One two three. Four five six seven eight! Nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen."
    spans = chunk.cut_characters(text, o)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(b[0] <= a[1] and b[1] > a[1] for a, b in zip(spans, spans[1:], strict=False))


def test_mmr_equals_a_loop(spark):
    rng = random.Random(2)
    rows = [(q, i, rng.random(), rng.random(), rng.choice("ab")) for q in (1, 2) for i in range(60)]
    got = {(r.query_id, r.id): r.mmr_rank for r in rank.mmr(spark.createDataFrame(rows, "query_id long, id long, relevance double, vec double, kind string")).collect()}
    for q in (1, 2):
        left = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1]))[:50]
        picked = []
        while left:
            like = lambda a, b: 0.7 * (1 - abs(a[3] - b[3])) + 0.3 * (a[4] == b[4])
            best = max(left, key=lambda r: (r[2] if not picked else 0.5 * r[2] - 0.5 * max(like(r, p) for p in picked)))
            picked.append(best)
            left.remove(best)
        assert [got[q, r[1]] for r in picked] == list(range(1, 51))


def test_alerts_cool_down(spark):
    t0 = datetime.datetime(2024, 1, 1)
    values = [90, 70, 95, 70, 99, 99, 70]
    pts = spark.createDataFrame([("m", t0 + datetime.timedelta(seconds=60 * i), float(v), i) for i, v in enumerate(values)], "metric string, ts timestamp_ntz, value double, seq long")
    rules = spark.createDataFrame([("r", "m", ">", 80.0, "warning", 180)], "rule string, metric string, op string, threshold double, severity string, cooldown_s int")
    got = [(r.ts.minute, r.action) for r in metrics.alerts(metrics.alert_checks(pts, rules)).orderBy("ts").collect()]
    assert got == [(0, "fired"), (1, "resolved"), (4, "fired"), (6, "resolved")]


def test_rate_limit_blocks(spark):
    t0 = datetime.datetime(2024, 1, 1)
    req = spark.createDataFrame([(1, t0 + datetime.timedelta(seconds=s), i) for i, s in enumerate([0, 1, 2, 3, 50, 200, 310])], "client long, ts timestamp_ntz, seq long")
    got = [r.allowed for r in security.rate_limited(req, limit=3, window_s=60, burst=5, burst_s=10, block_s=300).orderBy("seq").collect()]
    assert got == [True, True, True, False, False, False, True]


def test_capped_sessions(spark):
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(i, 1, t0 + datetime.timedelta(minutes=20 * i)) for i in range(40)]
    got = [r.session_no for r in behaviour.capped_sessions(spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz")).orderBy("event_id").collect()]
    assert got == [1] * 25 + [2] * 15


def test_entities(spark):
    q = spark.createDataFrame([(1, "find pdf files from John Smith larger than 10 mb on 2024-01-05"), (2, None), (3, "Dr. Jane Doe spreadsheets")], "query_id long, text string")
    got = {(r.query_id, r.kind, r.value) for r in understand.entities(q).collect()}
    assert {(1, "file_type", "pdf"), (1, "person", "John Smith"), (1, "size", "10 mb"), (1, "date", "2024-01-05"), (3, "file_type", "xlsx")} <= got
    assert any(k == 3 and kind == "person" for k, kind, _ in got)
    more = spark.createDataFrame([(1, "XLSX files written by Ada Lovelace on March 3, 2021"), (2, "powerpoint presentations over 2 GB"), (3, ".tar files, report of Mr Long")], "query_id long, text string")
    found = {(r.query_id, r.kind, r.value) for r in understand.entities(more).collect()}
    assert {(1, "file_type", "xlsx"), (1, "person", "Ada Lovelace"), (1, "date", "March 3, 2021"), (2, "file_type", "pptx"), (2, "size", "2 GB"), (3, "file_type", "tar"), (3, "person", "Mr Long")} <= found


def test_strategies(spark):
    q = spark.createDataFrame([(1, "find documents similar to this report"), (2, "files from yesterday"), (3, "budget")], "query_id long, text string")
    got = {r.query_id: r.strategy for r in understand.strategies(q, "2024-01-31").collect()}
    assert got[1] == "vector_only" and got[2] in ("hybrid", "multi_stage") and got[3] == "full_text"


def test_modes_and_builders():
    assert hybrid.prepared_fts("neural networks") == "neural* OR networks*"
    assert hybrid.prepared_fts("a AND b") == "a AND b"
    assert hybrid.built_fts(["a", "b"], [], False, "") == '"a b" OR (a AND b)'
    assert hybrid.route(True, False, "precise") == "lexical"
    assert hybrid.route(False, True, "exploratory") == "semantic"


def test_fusion_ties_and_gaps(spark):
    a = spark.createDataFrame([(1, 10, 1.0, 1), (1, 11, 0.9, 2)], "query_id int, id long, score double, rank int")
    b = spark.createDataFrame([(1, 11, 0.8, 1), (1, 12, 0.7, 2)], "query_id int, id long, score double, rank int")
    got = hybrid.rrf(a, b, hybrid.MODES["balanced"]).orderBy("rank").collect()
    assert [r.id for r in got] == [11, 12, 10]
    assert abs(got[0].score - (0.4 / 62 + 0.6 / 61)) < 1e-12


def test_cosine_edges(spark):
    from siltstone.functions import vector as V

    rows = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    assert [r[0] for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0]


def test_knn_blocks_passes_agree(spark):
    rng = np.random.default_rng(0)
    v = spark.createDataFrame([(i, rng.standard_normal(8).tolist()) for i in range(200)], "vec_id long, embedding array<double>")
    q = v.where("vec_id < 20").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    one = {(r.query_id, r.vec_id, r["rank"]) for r in vectors.knn_blocks(v, q, 5).collect()}
    two = {(r.query_id, r.vec_id, r["rank"]) for r in vectors.knn(v, q, 5).collect()}
    assert one == two


def test_redaction(spark):
    df = spark.createDataFrame([("mail a.b@c.org from 10.0.0.1 ssn 123-45-6789",), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(T.redact_secrets(F.col("t"))).collect()]
    assert got == ["mail [REDACTED-EMAIL] from [REDACTED-IP] ssn [REDACTED-SSN]", None, ""]
    more = spark.createDataFrame([("the key: value stays, the rest of it too",), ("password = 'a b', token:xyz; ok",), ('api_key="q r" done',), ("card 4111-1111-1111-1111, 378282246310005.",), ("order 1234-5678-9012-3456, 4111 1111 1111 1112",)], "t string")
    assert [r[0] for r in more.select(T.redact_secrets(F.col("t"))).collect()] == [
        "the key=[REDACTED] stays, the rest of it too", "password=[REDACTED], token=[REDACTED]; ok", "api_key=[REDACTED] done", "card [REDACTED-CARD], [REDACTED-CARD].",
        "order 1234-5678-9012-3456, 4111 1111 1111 1112",  # no cards: their check digits are wrong
    ]
    some = spark.createDataFrame([("ftp://u:pw@h/x 555-123-4567 a.b@c.d.org " + "k1" * 10,)], "t string")
    assert some.select(T.redact_sensitive(F.col("t"))).first()[0] == "ftp[REDACTED]h/x [REDACTED] [REDACTED] [REDACTED]"
    kept = "interdisciplinarities of antidisestablishmentarianism 5551234567 12345678901234567890"  # long words and bare numbers are neither keys nor phones
    found = "+44 20 7946 0958 / (030) 123 4567 / sk-live-0a1b2c3d4e5f6g7h"
    rows = spark.createDataFrame([(kept,), (found,), ("a\u0001b",)], "t string").select(T.redact_sensitive(F.col("t"))).collect()
    assert [r[0] for r in rows] == [kept, "[REDACTED] / [REDACTED] / [REDACTED]", "ab"]


def test_files(spark, tmp_path):
    import zipfile

    (tmp_path / "a.txt").write_text("The cat and the dog are here and they was happy the end of it.")
    (tmp_path / "b.html").write_text("<html><script>x</script><p>Hello &amp; bye</p></html>")
    (tmp_path / "c.md").write_text("# Title\n\nSome *text* [link](u)")
    (tmp_path / ".hidden").write_text("no")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "d.txt").write_text("no")
    with zipfile.ZipFile(tmp_path / "e.docx", "w") as z:
        z.writestr("word/document.xml", "<w:p><w:t>Office</w:t> <w:t>words</w:t></w:p>")
    got = {r.path.rsplit("/", 1)[-1]: r for r in files.documents(files.listing(spark, f"file://{tmp_path}")).collect()}
    assert {k: v.text for k, v in got.items() if k != "a.txt"} == {"b.html": "Hello & bye", "c.md": "Title Some text link", "e.docx": "Office words"}
    assert got["a.txt"].lang == "en" and got["a.txt"].kind == "Text" and not got["a.txt"].needs_ocr
    files.write_table(spark.range(3), str(tmp_path / "out"), "json")
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_empty_tables(spark):
    from siltstone.operators import lexical, results

    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    q = spark.createDataFrame([(1, "a")], "query_id int, term string")
    assert lexical.bm25(docs, q).collect() == []
    assert results.summaries(docs).collect() == []
    assert chunk.sentence_chunks(docs).collect() == []


def test_similar_users(spark):
    import random

    from siltstone.operators import behaviour

    rng = random.Random(3)
    users = {u: {f: round(rng.random() * 2 - 0.5, 3) for f in rng.sample("abcdefg", rng.randint(1, 7))} for u in range(60)}
    want = set()
    for u, p in users.items():
        near = []
        for v, q in users.items():
            both = p.keys() & q.keys()
            if u != v and both and sum(abs(p[f] - q[f]) < 0.2 for f in both) * 2 > len(both):
                near.append((-round(sum(1 - abs(p[f] - q[f]) for f in both) / len(both), 9), v))
        want |= {(u, v, -s, i + 1) for i, (s, v) in enumerate(sorted(near)[:4])}
    df = spark.createDataFrame([(u, f, x) for u, p in users.items() for f, x in p.items()] + [(None, "a", 0.1), (99, None, 0.1), (98, "a", None)], "user_id long, feature string, value double")
    got = {(r.user_id, r.other, r.similarity, r["rank"]) for r in behaviour.similar_users(df, 4).collect()}
    assert {(u, v, round(s, 8), k) for u, v, s, k in got} == {(u, v, round(s, 8), k) for u, v, s, k in want}


def test_sanitisers(spark):
    from siltstone.operators import security

    xml = ["<a>\x00ok\x85\n</a>", '<!DOCTYPE a [<!ENTITY x SYSTEM "file:///etc/passwd">]><a>&x;</a>', "the system 'works'", "public good"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xml], "x string").select(security.xml_sanitised(F.col("x"))).collect()]
    assert got == ["<a>ok\n</a>", "[BLOCKED][BLOCKED]]><a>&x;</a>", "the [BLOCKED]", "public good"]
    commands = ["ls -l; rm -rf /", "a | formatter", "x && DEL y", "echo `id` $(whoami)", "firm; warm", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in commands], "x string").select(security.command_sanitised(F.col("x"))).collect()]
    assert got == ["ls -l[BLOCKED]-rf /", "a | formatter", "x [BLOCKED]y", "echo [BLOCKED] [BLOCKED]", "firm; warm", None]
    expressions = ["a+b*", "(a+)+", "x(?=y)", "a**", "(?:ab)+c", "(ab){2,}", "z" * 1500]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in expressions], "x string").select(security.regex_sanitised(F.col("x"))).collect()]
    assert got == ["a+b*", "[BLOCKED]", "[BLOCKED]", "[BLOCKED]", "(?:ab)+c", "(ab){2,}", "z" * 1000]


def test_time_spans(spark):
    from datetime import date

    from siltstone.operators import understand

    df = spark.createDataFrame([(1, "this week, 2 months ago; tomorrow"), (2, "Last\tyear 3 days ago 3 days ago"), (3, None), (4, "today's weekly")], "query_id long, text string")
    got = {(r.query_id, r.expression, r.since, r.until) for r in understand.time_spans(df, "2024-01-31").collect()}
    assert got == {
        (1, "this week", date(2024, 1, 29), date(2024, 2, 5)), (1, "ago", date(2023, 12, 2), date(2023, 12, 3)), (1, "tomorrow", date(2024, 2, 1), date(2024, 2, 2)),
        (2, "year", date(2023, 1, 31), date(2024, 2, 1)), (2, "ago", date(2024, 1, 28), date(2024, 1, 29)), (4, "today", date(2024, 1, 31), date(2024, 2, 1)),
    }


def test_sentences_keep_digits_at_their_edges(spark):
    """A sentence that begins or ends in the digit of its place in the text stays whole; spaces at its ends go."""
    got = spark.createDataFrame([("0a 0. 1b 1. 2c ccccccccc2. c3 3!  4",)], "t string").select(T.sentences(F.col("t")), T.summary_sentences(F.lit(" 0 aaaaaaaaaa0. 1 bbbbbbbbbb1 "))).first()
    assert got[0] == ["0a 0.", "1b 1.", "2c ccccccccc2.", "c3 3!", "4"]
    assert got[1] == ["0 aaaaaaaaaa0", "1 bbbbbbbbbb1"]


def test_similar_users_in_blocks_and_classes(spark, monkeypatch):
    """Several blocks, and classes of more users than are asked for, give what a plain loop gives."""
    monkeypatch.setattr(behaviour, "SIDE", 7)
    rng = random.Random(4)
    shapes = [{f: rng.choice((0.0, 0.1, 0.3, 0.35)) for f in rng.sample("abcd", rng.randint(1, 4))} for _ in range(30)]
    users = {u: rng.choice(shapes[: 3 if u % 2 else 30]) for u in range(90)}
    want = set()
    for u, p in users.items():
        near = []
        for v, q in users.items():
            both = p.keys() & q.keys()
            if u != v and both and sum(abs(p[f] - q[f]) < 0.2 for f in both) * 2 > len(both):
                near.append((-round(sum(1 - abs(p[f] - q[f]) for f in sorted(both)) / len(both), 9), v))
        want |= {(u, v, -s, i + 1) for i, (s, v) in enumerate(sorted(near)[:3])}
    df = spark.createDataFrame([(u, f, x) for u, p in users.items() for f, x in p.items()], "user_id long, feature string, value double")
    assert {tuple(r) for r in behaviour.similar_users(df, 3).collect()} == want
    assert behaviour.similar_users(df.limit(0)).isEmpty()


def test_files_of_rows_lie_in_few_folders(spark, tmp_path):
    """A file a row, those of one key too; folders don't grow with the rows, and small files share tasks."""
    rows = [(i, f"text {i}\u00e9") for i in range(1500)] + [(7, "again"), (8, ""), (9, None)]
    root = f"file://{tmp_path}/files"
    files.write_files(spark.createDataFrame(rows, "k long, value string"), root, "k")
    found = [p for p in (tmp_path / "files").rglob("k=*.txt") if p.is_file()]
    assert sorted(p.read_text() for p in found) == sorted(f"{v}\n" for _, v in rows if v is not None)
    assert len({p.parent for p in found}) <= files.FOLDERS
    with Tables(spark, "test") as tables:
        read = files.read_once(tables, files.listing(spark, root))
        assert read.count() == len(found) and read.rdd.getNumPartitions() < 20
