"""Changes, watching, readers, plan records and upkeep: hand-made examples, nulls, ties and empty tables."""

from __future__ import annotations

import random
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from siltstone.boolean import execute
from siltstone.boolean.parser import parse
from siltstone.operators import behaviour, security, upkeep
from siltstone.sources import files


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_changes(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4"), ("e", "4"), ("n", None)], "path string, hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("z", "3"), ("x", "4"), ("m", None)], "path string, hash string")
    want = [("created", "m", None), ("created", "x", None), ("deleted", "d", None), ("deleted", "e", None), ("deleted", "n", None), ("modified", "b", None), ("renamed", "z", "c")]
    assert rows(upkeep.changes(old, new)) == want  # two went with content 4: no rename is told
    assert rows(upkeep.changes(old, old)) == [] == rows(upkeep.changes(old.limit(0), old.limit(0)))


def test_prefix_similarity(spark):
    df = spark.createDataFrame([("abcd", "abcd"), ("abcd", "abxd"), ("abcd", "x"), ("ab", "abcd"), (None, "a")], "a string, b string")
    assert [r[0] for r in df.select(upkeep.prefix_similarity(F.col("a"), F.col("b"))).collect()] == [1.0, 0.5, 0.0, 0.5, None]


def test_sampling_is_a_share_and_the_same_again(spark):
    df = spark.range(20000)
    a = rows(upkeep.sampled(df, "id", 0.25))
    assert 4600 < len(a) < 5400 and a == rows(upkeep.sampled(df.repartition(7), "id", 0.25))
    assert upkeep.sampled(df, "id", 1.0).count() == 20000 and upkeep.sampled(df, "id", 0.0).count() == 0


def test_reprocessed(spark):
    docs = spark.createDataFrame([(1, None, "p"), (2, "  ", "q"), (3, "kept", "r")], "doc_id long, text string, extra string")
    got = rows(upkeep.reprocessed(docs, "doc_id", lambda k: k.map(lambda x: f"seen {x}")))
    assert got == [(1, "seen 1", "p", True), (2, "seen 2", "q", True), (3, "kept", "r", False)]
    assert rows(upkeep.reprocessed(docs.limit(0), "doc_id", lambda k: k.astype(str))) == []


def test_reset_and_progress(spark, tmp_path):
    p = f"{tmp_path}/t"
    spark.range(10).withColumn("x", F.lit("a")).write.parquet(p)
    df, seen = upkeep.progress(spark.read.parquet(p), total=F.sum("id"))
    assert df.count() == 10 and seen.get == {"rows": 10, "total": 45}
    upkeep.reset(spark, p)
    assert spark.read.parquet(p).count() == 0 and spark.read.parquet(p).columns == ["id", "x"]


def test_steps():
    got = list(execute.steps(parse('a AND NOT "b c"')))
    assert got == [("TermSearch", "a", 0.3, 300, 1.0), ("TermSearch", '"b c"', 0.1, 100, 1.0), ("BooleanOperation", 'NOT "b c"', 0.9, 900, 2.5), ("BooleanOperation", '(a AND NOT "b c")', 0.27, 270, 4.5)]
    assert list(execute.steps(parse(""))) == [("IndexLookup", "", 1.0, 1000, 0.0)]


def test_scoring_terms():
    assert execute.scoring_terms(parse('a^2 OR "a b" AND NOT (c OR NOT d) AND type:pdf')) == {"a": 3.0, "b": 1.0, "d": 1.0}


def test_fallback(spark):
    docs = spark.createDataFrame([(1, "red and blue"), (2, "red"), (3, None)], "doc_id long, text string")
    fields = {"content": "text"}
    ids = lambda t: [r.doc_id for r in execute.answered(docs, t, fields).orderBy("doc_id").collect()]
    assert execute.fallback("red ) blue!") == 'content:"red" AND content:"blue"'
    assert ids("red ) blue") == [1] and ids("red OR blue") == [1, 2] and ids(") (") == [1, 2, 3] == ids("")


OPS = [("equals", "b7", True), ("not_equals", "b7", False), ("contains", "7", True), ("starts_with", "b", True), ("ends_with", "b", False), ("greater", "-1", True), ("less", "0", False), ("matches", "^b[0-9]$", True), ("in", "a,b7", True), ("not_in", "a,b7", False)]


@pytest.mark.parametrize(("op", "value", "want"), OPS)
def test_conditions(spark, op, value, want):
    df = spark.createDataFrame([("b7",), (None,)], "x string")
    got = [r[0] for r in df.select(security.condition(F.col("x"), op, value)).collect()]
    assert got[0] is want and got[1] is not None
    with pytest.raises(ValueError):
        security.condition(F.col("x"), "like", "a")


def test_first_rule(spark):
    rules = [security.Rule("one", "deny", "a.b*", "read"), security.Rule("two", "allow", "a?b*")]
    df = spark.createDataFrame([("a.bc", "read"), ("a.bc", "write"), ("axb", "read"), ("zz", "read"), (None, None)], "r string, a string")
    got = [tuple(x[0]) for x in df.select(security.first_rule(rules, F.col("r"), F.col("a"), {})).collect()]
    assert got == [("one", "deny"), ("two", "allow"), ("two", "allow"), (None, "not_applicable"), (None, "not_applicable")]


def test_sessions_stay_expired(spark):
    at = ["2024-01-01 00:00:00", "2024-01-01 00:00:10", "2024-01-01 00:01:00", "2024-01-01 00:01:01"]
    e = spark.createDataFrame([(1, t, i) for i, t in enumerate(at)], "session int, ts string, seq int").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert [r.valid for r in security.session_validity(e, 10).orderBy("seq").collect()] == [True, True, False, False]


def test_due(spark):
    df = spark.createDataFrame([("ColdStart", 1, 1.0), ("Bootstrapping", 20, 1.0), ("Bootstrapping", 21, 1.0), ("Active", 1, 0.7), ("Active", 1, 0.8), ("Stable", 1, 0.1), ("Degraded", 1, 1.0)], "s string, n int, a double")
    assert [r[0] for r in df.select(behaviour.due(F.col("s"), F.col("n"), F.col("a"))).collect()] == [True, True, False, True, False, False, True]


def test_report_of_nothing(spark):
    e = spark.createDataFrame([], "ts timestamp, seq long, session long, severity string, kind string")
    assert rows(security.security_report(e)) == [(0, 0, 0, 0, "low", "")]


def pdf(*streams: tuple[bytes, bytes]) -> bytes:
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n<< /Length %d %s >>\nstream\n%s\nendstream\nendobj\n" % (i, len(s), extra, s) for i, (extra, s) in enumerate(streams, 1)) + b"%%EOF"


def test_pdf_text():
    shown = rb"BT /F1 12 Tf 72 700 Td (Plain \(text\) \101\344) Tj 0 -14 Td [(spl) 20 (it) -300 (words)] TJ T* <48 65 6C6C6F> Tj (next) ' ET"
    want = "Plain (text) Aä split words Hello next"
    assert files.pdf_text(pdf((b"", shown))) == want
    assert files.pdf_text(pdf((b"/Filter /FlateDecode", zlib.compress(shown)), (b"/Subtype /Image", b"BT (no) Tj ET"))) == want
    assert files.pdf_text(b"") == "" == files.pdf_text(b"%PDF-1.4 broken") == files.pdf_text(pdf((b"/Filter /FlateDecode", b"not deflated")))
    assert files.pdf_text(pdf((b"/Resources << /Font << /F1 2 0 R >> >>", b"BT (nested) Tj ET"))) == "nested"


def test_any_bytes_under_any_name(spark, tmp_path: Path):
    """No file stops the others: each gives a document, those that can't be read with a problem."""
    rng = random.Random(5)
    shown = pdf((b"", b"BT [(a) - (b) --5 (c) 1.2.3 (d) -.] TJ <4> Tj ET"))
    some = [b"", b"\x00", b"\xff\xfe\x00", "Größe".encode("latin-1"), "\ufeffmark".encode(), rng.randbytes(3000), b"PK\x03\x04" + rng.randbytes(200), b"%PDF-1.4\n" + rng.randbytes(2000), shown, b"Subject: =?utf-8?B?!!?=\nContent-Type: text/plain; charset=nothing\n\n\xff"]
    kinds = ["txt", "md", "html", "pdf", "docx", "eml", "json", "png", "bin", ""]
    for i, data in enumerate(some):
        for k in kinds:
            (tmp_path / f"f{i}.{k}".rstrip(".")).write_bytes(data)
    got = {r.path.rsplit("/", 1)[-1]: r for r in files.documents(files.listing(spark, f"file://{tmp_path}")).collect()}
    assert len(got) == (len(some) - 1) * len(kinds)  # empty files are none
    assert got["f3.txt"].text == "Größe" and got["f4.txt"].text == "mark" and got["f4.txt"].problem is None
    assert got["f8.pdf"].text.startswith("abcd") and got["f6.docx"].text == "" and got["f6.docx"].problem


def test_mails_are_decoded(spark, tmp_path: Path):
    head = b"Subject: =?utf-8?B?R3LDvMOfZQ==?=\r\nFrom: =?iso-8859-1?Q?J=F6rg?= <j@x.org>\r\nMIME-Version: 1.0\r\n"
    base64 = head + b"Content-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: base64\r\n\r\nSGVsbG8gd8O2cmxk\r\n"
    parts = head + b'Content-Type: multipart/alternative; boundary="b"\r\n\r\n--b\r\nContent-Type: text/html\r\n\r\n<p>no</p>\r\n--b\r\nContent-Type: text/plain\r\nContent-Transfer-Encoding: quoted-printable\r\n\r\na=3Db\r\n--b--\r\n'
    page = b"Subject: s\n" + b"Content-Type: text/html\n\n<style>x</style><p>a &amp; b</p>"
    for name, data in (("a", base64), ("b", parts), ("c", page), ("d", b"Subject: plain\nFrom: x@y\n\nbody")):
        (tmp_path / f"{name}.eml").write_bytes(data)
    got = {r.path[-5]: (r.text, r.problem) for r in files.documents(files.listing(spark, f"file://{tmp_path}")).collect()}
    who = "Grüße Jörg <j@x.org>"
    assert got == {"a": (f"{who} Hello wörld", None), "b": (f"{who} a=b", None), "c": ("s a & b", None), "d": ("plain x@y body", None)}


def test_mail_fields(spark):
    mails = ["Subject: a\r\n b\r\nFROM: x@y\r\n\r\nbody\r\n\r\nSubject: no", "To: z\nDate: today", "", None]
    df = spark.createDataFrame([(m,) for m in mails], "m string")
    got = [tuple(r[0]) for r in df.select(files.mail_fields(F.col("m"))).collect()]
    assert got == [("a b", "x@y", None, None, "body\n\nSubject: no"), (None, None, "z", "today", ""), (None, None, None, None, ""), (None, None, None, None, None)]


def test_watch(spark, tmp_path: Path):
    root, target, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    root.mkdir()
    (root / "a.txt").write_text("first text")
    (root / "m.eml").write_text("Subject: hello\nFrom: me\n\nbody here")
    (root / "p.pdf").write_bytes(pdf((b"", b"BT (from a page) Tj ET")))
    (root / "scan.pdf").write_bytes(pdf((b"/Subtype /Image", b"\x00\x01")))
    run = lambda: files.watch(spark, str(root), target, state).awaitTermination(120)
    assert run()
    seen = lambda: {r.path.rsplit("/", 1)[1]: (r.text, r.needs_ocr) for r in files.watched(spark, target).collect()}
    want = {"a.txt": ("first text", False), "m.eml": ("hello me body here", False), "p.pdf": ("from a page", False), "scan.pdf": ("", True)}
    assert seen() == want
    (root / "b.txt").write_text("second text")
    assert run()  # the state tells what was taken before
    assert seen() == want | {"b.txt": ("second text", False)}
    assert len(list(Path(target).glob("batch=*"))) == 2
    assert files.file_count(spark, str(root)) == 5 and files.file_count(spark, str(root), exclude=["scan"]) == 4


def test_alert_states_in_any_order(spark):
    from siltstone.operators import metrics

    rng = random.Random(9)
    log = [(rng.randint(1, 12), at, rng.choice(["create", "acknowledge", "resolve", "other"])) for at in range(150)] + [(20, 1, "acknowledge"), (21, 1, "create"), (22, 1, "create"), (22, 2, "resolve"), (22, 3, "acknowledge")]
    want = {}
    for i, at, kind in log:
        state, opened, marked = want.get(i, ("none", None, None))
        if kind == "create" and state in ("none", "resolved"):
            state, opened = "open", at
        elif kind == "acknowledge" and state == "open":
            state, marked = "acknowledged", at
        elif kind == "resolve":
            state, opened, marked = "resolved", None, None
        if kind != "other" or i in want:
            want[i] = state, opened, marked
    more = [*log, *rng.sample(log, 60), (None, 1, "create"), (30, None, "create"), (31, 1, None)]
    rng.shuffle(more)
    got = metrics.alert_states(spark.createDataFrame(more, "alert_id long, at long, kind string").repartition(3)).collect()
    assert {r.alert_id: (r.state, r.opened, r.acknowledged) for r in got} == want
    assert metrics.alert_states(spark.createDataFrame([], "alert_id long, at long, kind string")).isEmpty()
