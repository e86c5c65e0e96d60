"""The ten operators and the pipeline: against brute force, round trips, SQL, held-out accuracy and edge cases."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from siltstone.llm import ann, decontam, htmlmain, linededup, neardup, packing, pfp, queries, sstable, tokens, toxicity, warc
from siltstone.llm.components import connected_components
from siltstone.llm.tokens import PieceEncoder, encoder, vocabulary_path

from ..conftest import DATA, same
from . import pages_by_hand

ODD = ["", " ", "a", " a  b", "a \n\n b\n", "I'm don't  x", "日本語 テスト", "x " * 3000, "no break", "½ ² Ⅷ 12", "<|endoftext|> hi", "A b.\nC d!! e,f", None]
DOCS = "doc_id long, text string"


def frame(spark, texts, clash=True):
    """Texts as documents, with other columns whose names operators use inside; null and repeated ids."""
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(None, "null id of some words"), (1, texts[1]), (2, "another text under an id that is taken")]
    if clash:
        return spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], DOCS + ", start int, row string, component_id int, n_shingles int"), rows
    return spark.createDataFrame(rows, DOCS), rows


def ids_of(text, name, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path(name))
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, end], "<u4")


@pytest.mark.parametrize("name", [k for k in queries.ORACLES])
def test_equals_sql(spark, duck, name):
    same(queries.QUERIES[name](spark, DATA), duck.execute(queries.ORACLES[name]))


@pytest.mark.parametrize(("name", "spaces"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_pieces_equal_whole_texts(spark, name, spaces):
    enc = encoder(name, spaces)
    texts = [t or "" for t in ODD] + [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(80).collect()]
    assert enc.batch(texts) == [enc.whole(t) for t in texts]


@pytest.mark.parametrize(("name", "spaces"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_pieces_with_any_sign_between(name, spaces):
    enc = encoder(name, spaces)
    texts = ["a\x1cb c", "\x1d", "a \x1e b", "x\x1f\n y", "\x1c \x1d"] + [f"ab{chr(c)}cd {chr(c)} e" for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    assert enc.batch(texts) == [enc.whole(t) for t in texts]


SIGNS = [chr(c) for c in [*range(0x21), *range(0x7F, 0xA1), 0x1680, 0x180E, 0x2003, 0x2028, 0x200B, 0x200D, 0x3000, 0xFEFF]]
SIGNS += ["\u0301", "e\u0301", "\u1100\u1161", "\u00c5", "\u212b", "\u00df", "\u0130", "\u03a3", "\u00bd", "\u0663", "\u65e5", "\U0001f600", "\U0001f468\u200d\U0001f469", "'s", "'Re", "don't"]
SIGNS += ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "word", " a", "ab.c", "  ", "\r\n", "Hello"]


@pytest.mark.parametrize(("name", "spaces"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_any_text_equals_the_plain_tokenizer(name, spaces):
    from tokenizers import Tokenizer

    rng, enc, plain = random.Random(11), encoder(name, spaces), Tokenizer.from_file(vocabulary_path(name))
    texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 14))) for _ in range(20_000)]
    want = [np.array(plain.encode(t, add_special_tokens=False).ids, f"<u{enc.itemsize}").tobytes() for t in texts]
    assert enc.batch(texts) == want


@pytest.mark.parametrize(("name", "spaces"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_marks_breaks_and_letters_in_any_order(name, spaces):
    from tokenizers import Tokenizer

    signs = [*".,!?;:%&*$#|()'\"<>-", " ", " ", "\n", "\n", "\t", "\xa0", "\x85", "\u2003", "\u3000", "\u1680", "\u202f", "\u205f", "\xd7", "\xf7", "\xc0", "\u012f", "\u0130", "\u0301", "e", "Za", "\u00e9n", "7", "\u20ac", "\u65e5", "\U0001f600", "'s", "<|", "endoftext"]
    rng, enc, plain = random.Random(5), encoder(name, spaces), Tokenizer.from_file(vocabulary_path(name))
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 12))) for _ in range(20_000)]
    want = [np.array(plain.encode(t, add_special_tokens=False).ids, f"<u{enc.itemsize}").tobytes() for t in texts]
    assert enc.batch(texts) == want


def counted(monkeypatch, name, spaces):
    """A new encoder that remembers nothing between batches, and the lists of the words and whole texts that it encodes."""
    enc, words, texts = PieceEncoder(vocabulary_path(name), spaces), [], []
    one, whole = enc._one, enc.whole
    monkeypatch.setattr(enc, "CACHE", 0)
    monkeypatch.setattr(enc, "_one", lambda w: words.append(w) or one(w))
    monkeypatch.setattr(enc, "whole", lambda t: texts.append(t) or whole(t))
    return enc, words, texts, whole


def test_a_full_cache_encodes_a_word_of_many_texts_once(monkeypatch):
    enc, words, whole, plain = counted(monkeypatch, "byte_bpe_50k.json", True)
    texts = [f" quelzin{m}\nquelzin  quelzin{m}" for m in ("", ".", ",", "!!")] * 50
    got = enc.batch(texts)
    assert len(words) == len(set(words)) < 10 and not whole
    assert got == [plain(t) for t in texts]


def test_packing_encodes_a_word_of_many_texts_once(monkeypatch):
    enc, words, whole, plain = counted(monkeypatch, "word_bpe_49k.json", False)
    texts = [f"quelzin{m} quelzin" for m in ("", ".", ",", "!!")] * 50
    got = enc.batch(texts)
    assert len(words) <= 5 and not whole  # the word with and without a space before it, three marks
    assert got == [plain(t) for t in texts]


@pytest.mark.parametrize("step", [1, 7, 1 << 20])
def test_rows_of_batches_keep_their_ids(monkeypatch, step):
    monkeypatch.setattr(tokens, "STEP", step)
    rows = [(3, "a b."), (None, "c"), (4, None), (4, ""), (5, "d e f g h i j"), (6, "<|endo"), (7, "ftext|> x"), (8, "<|endoftext|>")]
    table = pa.table({"text": [t for _, t in rows], "doc_id": pa.array([i for i, _ in rows], pa.int64())})
    got = list(tokens.encoded([*table.slice(1).to_batches(max_chunksize=3), *table.slice(0, 0).to_batches()], "word_bpe_49k.json", False))
    assert got == [(i, encoder("word_bpe_49k.json", False).whole(t or "")) for i, t in rows[1:]]


def test_bloom_lets_few_strange_keys_pass(tmp_path):
    w = sstable.Writer(open(tmp_path / "b.sst", "wb"), 2)  # noqa: SIM115
    for i in range(5000):
        w.add(sstable.key_of(i), b"")
    w.close()
    r = sstable.Reader(f"file://{tmp_path}/b.sst")
    passed = sum(all(r.bloom[p >> 3] >> (p & 7) & 1 for p in sstable._bloom_places(sstable.key_of(i), r.bits)) for i in range(5000, 45_000))
    assert passed < 0.012 * 40_000


def test_shards(spark):
    df, rows = frame(spark, ODD)
    manifest = sstable.write_shards(df, shards=3)
    got = sstable.read_shards(manifest).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    want = sorted((i if i is not None else -1, zlib.crc32(ids_of(t, "byte_bpe_50k.json", 0).tobytes())) for i, t in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.ids_crc32) for r in got) == want
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    readers = [sstable.Reader(m.path) for m in manifest.collect()]
    assert sum(r.n for r in readers) == len(rows)
    hits = [x for r in readers if (x := r.get(7)) is not None]
    assert len(hits) == 1 and (hits[0] == ids_of(ODD[7], "byte_bpe_50k.json", 0)).all()
    assert all(r.get(10**9) is None for r in readers) and any(r.get(None) is not None for r in readers)
    assert sstable.read_shards(sstable.write_shards(spark.createDataFrame([], DOCS))).collect() == []


def test_shard_blocks_share_prefixes(tmp_path):
    w = sstable.Writer(open(tmp_path / "a.sst", "wb"), 2)  # noqa: SIM115
    for i in range(20_000):
        w.add(sstable.key_of(i * 3), np.arange(i % 9, dtype="<u2").tobytes())
    w.close()
    r = sstable.Reader(f"file://{tmp_path}/a.sst")
    assert len(r.places) > 1 and r.get(3 * 777).tolist() == list(range(777 % 9)) and r.get(3 * 777 + 1) is None
    assert sum(1 for _ in r) == 20_000


def test_packing(spark):
    df, rows = frame(spark, ODD + ["word " * n for n in (1, 100, 127, 128, 129, 500, 682, 683, 1023, 1024, 1500, 2046, 2047, 2048, 5000)])
    got = packing.pack(df.repartition(2)).collect()
    by_doc: dict = {}
    for r in got:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    want = {(i, len(x)): x for i, t in rows if (x := ids_of(t, "word_bpe_49k.json", 1)) is not None}
    assert set(by_doc) == set(want)
    for k, pieces in by_doc.items():
        if k[0] in (1, 2):  # ids of several rows
            continue
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.ids_crc32 == zlib.crc32(want[k][at : at + p.length].tobytes())
            at += p.length
        assert at == k[1]
    seqs: dict = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    waste = total = 0
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert 0 < at <= 2048
        total += at
        waste += 0 if at & (at - 1) == 0 else 2048 - at
    assert waste < 0.02 * total
    assert packing.pack(spark.createDataFrame([], DOCS)).collect() == []


def test_warc(spark):
    big = "".join(chr(97 + i % 26) for i in range(50_000))
    pages = [(1, "http://a", "same"), (2, "http://b c\n", "same"), (3, None, None), (4, "u", ""), (5, "u", big), (6, "u", big), (None, "u", "only null"), (7, "u", "once é"), (7, "u", "once é")]
    df = spark.createDataFrame([(*p, 0) for p in pages], "page_id long, url string, html string, h int")
    paths = warc.write_archives(df, segment_bytes=4096)
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to, r.payload_digest) for r in warc.read_archives(paths).collect()), key=repr)
    d = lambda t: warc.digest_of((t or "").encode())
    want = [
        (1, 4, "revisit", 2, d("same")), (2, 4, "response", None, d("same")), (3, 0, "revisit", 4, d("")), (4, 0, "response", None, d("")), (5, 50_000, "revisit", 6, d(big)),
        (6, 50_000, "response", None, d(big)), (None, 9, "response", None, d("only null")), (7, 7, "response", None, d("once é")), (7, 7, "response", None, d("once é")),
    ]
    assert got == sorted(want, key=repr)
    records = [f for p in paths.collect() for f, _ in warc.read_records(p.path)]
    assert sum(f["warc-type"] == "continuation" for f in records) == 12
    assert warc.read_archives(warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"))).collect() == []


def test_segments_and_chunks():
    data = bytes(range(256)) * 50
    assert warc.chunk_decode(warc.chunk_encode(data, 100)) == data and warc.chunk_decode(b"3;x=y\r\nabc\r\n0\r\nT: v\r\n\r\n") == b"abc"
    parts = [(2, None, b"b"), (1, None, b"a"), (3, 3, b"c")]
    assert warc.join_segments(parts) == b"abc"
    for broken in (parts[:2], [*parts, parts[0]], [(1, None, b"a"), (2, 5, b"b")]):
        with pytest.raises(ValueError):
            warc.join_segments(broken)
    with pytest.raises(ValueError):
        warc.chunk_decode(b"5\r\nab\r\n0\r\n\r\n")


def test_lines(spark):
    run = "\n".join(" ".join(f"w{i}{j}" for j in range(20)) for i in range(4))
    docs = [(1, f"head\n{run}\ntail"), (2, f"other\n  {run.replace(chr(10), '  ' + chr(10) + chr(10))}\nend"), (3, "short line\nshort line"), (4, None), (5, run), (5, run), (None, "x"), (6, run.split("\n")[0])]
    df = spark.createDataFrame([(*r, "k") for r in docs], DOCS + ", lines string")
    got = {}
    for r in linededup.deduplicate_lines(df).collect():
        got.setdefault(r.doc_id, []).append((r.text, r.lines_.n_removed, r.lines))
    kept = linededup.drop_repeated_lines(df)
    assert kept.columns == df.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 6]
    assert got[1] == [(docs[0][1], 0, "k")] and got[2][0][1] == 4 and got[2][0][0].split() == ["other", "end"]
    assert got[3][0][1] == 0 and got[4] == [(None, 0, "k")] and got[5] == [("", 4, "k")] * 2 and got[6][0][1] == 0
    assert linededup.deduplicate_lines(spark.createDataFrame([], DOCS)).collect() == []
    runs = {tuple(r) for r in linededup.repeated_runs(df).collect()}
    assert runs == {(2, 1, 4, 1, 1), (5, 0, 3, 1, 1)}


def test_runs_of_lines_against_brute_force(spark):
    rng = random.Random(14)
    line = lambda: " ".join(rng.choice(["ab", "cd", "ef", "gh"]) for _ in range(rng.choice([0, 1, 3, 9, 25, 60])))
    pool = [[line() for _ in range(rng.randint(1, 30))] for _ in range(6)]
    docs = []
    for i in range(30):
        out = []
        for _ in range(rng.randint(1, 3)):
            p = rng.choice(pool)
            a = rng.randrange(len(p))
            out += p[a : rng.randint(a, len(p))] + [line()]
        docs.append((i, "\n".join(out)))
    words = [[x.split() for x in t.split("\n")] for _, t in docs]
    kept = [[(k, w) for k, w in enumerate(ls) if w] for ls in words]
    seen: dict = {}
    for d, ls in enumerate(kept):  # every run of lines of enough words, however long, in order of its first line
        for a in range(len(ls)):
            for b in range(a, len(ls)):
                if sum(len(w) for _, w in ls[a : b + 1]) >= 50:
                    seen.setdefault(tuple(tuple(w) for _, w in ls[a : b + 1]), (d, a))
    want = {}
    for d, ls in enumerate(kept):
        gone = set()
        for a in range(len(ls)):
            for b in range(a, len(ls)):
                key = tuple(tuple(w) for _, w in ls[a : b + 1])
                if seen.get(key, (d, a)) < (d, a):
                    gone |= {k for k, _ in ls[a : b + 1]}
        want[d] = "\n".join(x for k, x in enumerate(docs[d][1].split("\n")) if k not in gone)
    got = {r.doc_id: r.text for r in linededup.deduplicate_lines(spark.createDataFrame(docs, DOCS)).collect()}
    assert got == want


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 16)) * rng.uniform(0.5, 2, (3000, 1))
    x[5] = x[6] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(None, x[0].tolist()), (9000, None), (9001, [0.0] * 16), (9002, [float("nan")] * 16), (9003, [None] * 16), (9004, [1.0]), (8, x[8].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got: dict = {}
    for r in ann.nearest(df, df.where("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(got) == set(range(0, 3000, 20))
    hits = 0
    for q, g in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(3000), -s))[:20]
        hits += len(set(best) & {v for v, _ in g.values()})
        assert sorted(g) == list(range(1, 21)) and all(abs(s[v] - c) < 1e-9 for v, c in g.values())
        order = [(-c, v) for _, (v, c) in sorted(g.items())]
        assert order == sorted(order)
    assert hits >= 0.9 * 20 * len(got)
    assert ann.nearest(df.where("vec_id < 0"), df).collect() == []
    few = ann.nearest(df.where("vec_id < 4"), df.where("vec_id = 0"))
    assert few.count() == 3


def test_neighbours_of_each_length(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(16 if i < 400 else 17 if i < 403 else 3).tolist()) for i in range(440)]
    rows += [(0, [9.0] * 16), (20, [-9.0] * 17), (1000, [1.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got: dict = {}
    for r in ann.nearest(df, df.where("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    by_id: dict = {}
    for i, v in rows:
        by_id.setdefault(i, []).append(v)
    assert set(got) == set(range(0, 440, 20)) and len(got[400]) == 3  # two of its length and the row that repeats 20
    asked = {q: min(v) for q, v in by_id.items()}  # of several vectors under an id the least is asked for
    hits = 0
    for q, g in got.items():
        best: dict = {}
        for i, vs in by_id.items():
            for v in vs:
                if i != q and len(v) == len(asked[q]):
                    best[i] = max(best.get(i, -np.inf), float(np.dot(v, asked[q])))
        want = sorted(best, key=lambda i: (-best[i], i))[:20]
        hits += len(set(g) & set(want)) / len(want)
    assert hits >= 0.95 * len(got)


def test_neighbours_of_lonely_and_of_equal_vectors(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([np.tile([[1.0, 2.0, 3.0, 4.0]], (1500, 1)), rng.standard_normal((700, 4)) * 0.2, [[-90.0, 40.0, 3.0, 1.0]]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got: dict = {}
    for r in ann.nearest(df, df.where("vec_id % 20 = 0"), bucket=16).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert [v for _, v in sorted(got[40])] == [*range(20)]  # of equal ones the smallest identifiers
    assert set(got) == set(range(0, 2201, 20))


def test_candidates_of_clustered_vectors():
    rng = np.random.default_rng(3)
    n = 40_000
    centre = rng.standard_normal((n // 100, 64))
    centre /= np.linalg.norm(centre, axis=1)[:, None]
    x = centre[rng.integers(0, len(centre), n)] + rng.standard_normal((n, 64)) * 0.04
    y = x / np.linalg.norm(x, axis=1).max()
    y = np.concatenate([y, np.sqrt(np.maximum(0, 1 - (y * y).sum(1)))[:, None]], 1)
    h = ann.Hashes(64, ann.hashes_for(n, 512))
    keys, who = h.buckets(y), np.arange(0, n, n // 40)
    q = np.concatenate([x[who] / np.linalg.norm(x[who], axis=1)[:, None], np.zeros((len(who), 1))], 1)
    near = q @ y.T
    near[np.arange(len(who)), who] = -9
    true = np.argsort(-near, axis=1)[:, :20]
    far = np.sqrt(2 - 2 * np.take_along_axis(near, true, 1)[:, -1])
    seen = [np.isin(keys, p).any(1) for p in h.probes(q, far, ann.REACH)]
    assert np.mean([m[t].mean() for m, t in zip(seen, true, strict=True)]) > 0.9 and np.mean(seen) < 0.2


def brute_repeats(docs, length=100):
    seen, out = set(), []
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if (s := b[k : k + length]) in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(s)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("distance", [0.9, 1.37, 1.6])
def test_probes_reach_far_neighbours(distance):
    rng = np.random.default_rng(4)
    h = ann.Hashes(15, 6, tables=2, w=1.0)
    q = rng.standard_normal((40, 16))
    q /= np.linalg.norm(q, axis=1)[:, None]
    probes = h.probes(q, np.full(40, distance), 0.3)
    side = rng.standard_normal((200, 40, 16))
    side -= (side * q).sum(2, keepdims=True) * q
    side /= np.linalg.norm(side, axis=2, keepdims=True)
    c = 1 - distance * distance / 2
    near = c * q + np.sqrt(1 - c * c) * side  # at the distance that was asked for
    found = [np.isin(h.buckets(near[:, i])[:, t], probes[i]).mean() for i in range(40) for t in range(2)]
    assert np.mean(found) > 0.24


def test_neighbours_beside_an_outlying_norm(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[17] *= 10
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got: dict = {}
    for r in ann.nearest(df, df.where("vec_id % 20 = 0"), bucket=8).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q, g in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(g & set(np.argsort(-s)[:20].tolist()))
    recall = hits / (20 * 150)
    print("recall beside an outlying norm", recall)
    assert recall > 0.9


def test_repeated_strings(spark):
    rng = random.Random(4)
    base = "".join(rng.choice("abcdé ") for _ in range(3000))
    docs = [base, base, base[500:900] + "X" + base[100:260], "a" * 1000, "ab" * 300 + "a" * 150, None, "", base[:99], base[:100], "é" * 60]
    for _ in range(30):
        cut = sorted(rng.sample(range(len(base)), 2))
        docs.append("".join(rng.choice("xyz") for _ in range(rng.randint(0, 40))) + base[cut[0] : cut[1]] + str(rng.random()))
    rows = list(enumerate(docs))
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], DOCS + ", part int, ord int")
    got = sorted(tuple(r) for r in pfp.repeated_strings(df).collect())
    assert got == brute_repeats(rows)
    assert pfp.repeated_strings(spark.createDataFrame([], DOCS)).collect() == []


def test_phrases_hold_every_string_once():
    rng = random.Random(5)
    for text in ("".join(rng.choice("ab") for _ in range(5000)), "z" * 700, "q" * 99):
        r = pfp.phrases(text.encode(), 100)
        at = np.concatenate([np.arange(a, a + n + rep - 1) for a, n, rep in zip(r["at"], r["n"], r["rep"], strict=True)]) if len(r["at"]) else np.zeros(0)
        assert at.tolist() == list(range(max(0, len(text) - 99)))


def test_decontamination(spark):
    test = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    docs = [f"before {test.upper()} after", " ".join(test.split()[:9]) + " no", f"x {' '.join(test.split()[1:])}", "short one here", None, "", "one. short! item", test + " " + test]
    items = [(1, test), (2, "Short item"), (3, None), (4, "..."), (None, "one"), (5, test), (1, test)]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(docs)], DOCS + ", item string")
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontam.match_tests(df, tests).collect()}
    assert got == {0: (13, 11, 2, True), 1: (10, 0, 0, False), 2: (11, 10, 2, True), 3: (3, 0, 0, False), 4: (0, 0, 0, False), 5: (0, 0, 0, False), 6: (3, 2, 1, True), 7: (22, 22, 2, True)}
    clean = decontam.decontaminate(df, tests)
    assert clean.columns == df.columns and {r.doc_id for r in clean.collect()} == {1, 3, 4, 5}
    assert decontam.decontaminate(df, tests.limit(0)).count() == len(docs)
    assert decontam.match_tests(df.limit(0), tests).collect() == []


def test_suffix_array_longest():
    word = np.array([1, 2, 3, 1, 2, 4, 9], np.uint64)
    sa = decontam.SuffixArray(word, np.array([6] * 6 + [7]), np.arange(7), 4)
    q = np.array([[1, 2, 3, 1], [1, 2, 5, 0], [7, 0, 0, 0], [2, 4, 9, 0]], np.uint64)
    n = np.array([4, 3, 1, 3])
    best, first = sa.longest(q, n)
    assert best.tolist() == [4, 2, 0, 2] and [sa.places[k] if k >= 0 else None for k in first] == [0, sa.places[first[1]], None, 4]
    lo, hi = sa.find(np.array([[1, 2, 0, 0]], np.uint64), np.array([2]))
    assert sorted(sa.places[lo[0] : hi[0]].tolist()) == [0, 3]


@pytest.mark.parametrize("block", [decontam.BLOCK, 40])
def test_longest_matches_against_brute_force(spark, block):
    rng = random.Random(13)
    texts = [[rng.choice("abcdefgh") for _ in range(rng.randint(0, 120))] for _ in range(40)]
    items = [[rng.choice("abcdefgh") for _ in range(rng.randint(1, 30))] for _ in range(25)]
    for k in range(0, 24, 2):  # passages of items in documents, some whole, some cut
        a = rng.randrange(len(items[k]))
        b = rng.randint(a + 1, len(items[k]))
        at = rng.randrange(len(texts[k]) + 1)
        texts[k][at:at] = items[k][a:b] if k % 4 else items[k]
    items.append(["zz"])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], DOCS)
    tests = spark.createDataFrame([(i, ". ".join(t)) for i, t in enumerate(items)], "item_id long, text string")

    def common(x, a, y, b):
        n = 0
        while a + n < len(x) and b + n < len(y) and x[a + n] == y[b + n]:
            n += 1
        return n

    want = {}
    for i, x in enumerate(items):
        found = [(-m, a, d, p) for a in range(len(x)) for d, y in enumerate(texts) for p in range(len(y)) if (m := common(x, a, y, p))]
        if found:
            want[i] = min(found)
    got = {r.item_id: (-r.n_words, r.item_at, r.doc_id, r.doc_at) for r in decontam.longest_matches(docs, tests, block=block).collect()}
    assert got == want
    best = {}
    for d, y in enumerate(texts):
        found = [(-m, i, p) for i, x in enumerate(items) for a in range(len(x)) for p in range(len(y)) if (m := common(x, a, y, p)) >= min(10, len(x)) and (not a or not p or x[a - 1] != y[p - 1])]
        best[d] = min(found, default=(0, None, None))
    told = {r.doc_id: (-r.longest_match, r.longest_item, r.longest_at) for r in decontam.match_tests(docs, tests, block=block).collect()}
    assert told == best
    assert decontam.longest_matches(docs.limit(0), tests).collect() == []


def page(main, extra=""):
    return f"<html><head><title>t</title><style>p{{}}</style><script>var a='<p>no</p>'</script></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav>{extra}<article>{main}</article><footer>(c)</footer></body></html>"


def test_main_text(spark):
    pages = [r.html for r in spark.read.parquet(DATA.replace("sf0.001", "sf0.1") + "/pages.parquet").limit(150).collect()]
    net = htmlmain.train_labeller([x for p in pages[:150] for stretch in htmlmain.lessons_of(p or "") for x in stretch])
    held = [r.html for r in spark.read.parquet(DATA.replace("sf0.001", "sf0.01") + "/pages.parquet").collect()]
    blocks = [htmlmain.blocks_of(h or "") for h in held]
    found = [(q >= 0.5) == np.array(htmlmain.taught(b), bool) for b, q in zip(blocks, htmlmain.label_pages(blocks, net), strict=True)]
    assert np.concatenate(found).mean() > 0.99
    right = total = 0
    for lines in pages_by_hand.PAGES:
        b = htmlmain.blocks_of(pages_by_hand.page(lines))
        want = [(x, y) for y, x in lines if y is not None]
        assert [t for *_, t, _ in b] == [x for x, _ in want]
        right += int(((htmlmain.label_pages([b], net)[0] >= 0.5) == np.array([y for _, y in want])).sum())
        total += len(b)
    assert right / total >= 0.95
    body = "<h1>Head</h1><p>One &amp; <b>two</b>  three<br>four.<p>Five &lt;six&gt;\n seven words of text.</p>" + "<p>More words in a sentence here.</p>" * 6
    text = htmlmain.extract([page(body), page(body, "<aside class='sidebar'><p>Side note</p></aside><div class='cookie-notice'>We use cookies</div>"), None, "", "<p>cut &am"], net)
    assert text[0].startswith("Head\n\nOne & two three four.\n\nFive <six> seven words of text.\n\nMore") and text[1] == text[0] and text[2:4] == ["", ""]
    df = spark.createDataFrame([(1, "u", page(body), 0), (1, "u", page(body), 0), (None, None, None, 0)], "page_id long, url string, html string, n_chars int")
    assert sorted(r.n_chars for r in htmlmain.main_text(df).collect())[0] == 0
    assert htmlmain.main_text(df.limit(0)).collect() == []


def test_pages_of_any_length(spark):
    import resource

    net = htmlmain.BiLSTM()
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    out = htmlmain.label_pages([htmlmain.blocks_of("<p>x</p>")] * 300 + [htmlmain.blocks_of("<p>y</p>" * 12_000)] + [htmlmain.blocks_of("<div>x" * 10_000)], net)
    assert [len(x) for x in out] == [1] * 300 + [12_000, 10_000]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300 << 10
    for n in (1, htmlmain.STRETCH, htmlmain.STRETCH + 1, 2 * htmlmain.STRETCH, 9999):
        told = [k for _, _, lo, hi in htmlmain._stretches(n) for k in range(lo, hi)]
        assert told == list(range(n)) and all(a <= lo and hi <= b and b - a <= htmlmain.STRETCH for a, b, lo, hi in htmlmain._stretches(n))
    assert [t for *_, t, _ in htmlmain.blocks_of("<script src=a />var x = 1;</script><svg/><p>y</p>")] == ["y"]


def test_nested_elements_share_what_they_hold():
    import tracemalloc

    tracemalloc.start()
    blocks = htmlmain.blocks_of("<div>" * 200_000 + "deep")  # 1 MB
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [t for *_, t, _ in blocks] == ["deep"] and peak < 100 << 20
    assert blocks[0][0].shares() == [1.0] * 4 and htmlmain.vectors(blocks).shape == (1, htmlmain.INPUT)


def test_written_pages_have_the_labels_of_their_blocks(spark):
    pages = [r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()]
    made = 0
    for p in pages:
        blocks = htmlmain.blocks_of(p or "")
        labels = htmlmain.taught(blocks)
        if any(labels):
            for seed in range(3):
                b, y = htmlmain._rewritten(blocks, labels, np.random.default_rng(seed))
                assert len(b) == len(y) and any(y)
                made += not all(y)
    assert made > len(pages)


def brute_components(rows, size=2):
    def sets(t):
        w = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
        return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])

    s = [(i, sets(t)) for i, t in rows]
    up = {i: i for i, _ in s}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, x) in enumerate(s):
        for j, y in s[:a]:
            if i is not None and j is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = root(i), root(j)
                up[max(p, q)] = min(p, q)
    return sorted(((i, len(x), None if i is None else root(i)) for i, x in s), key=repr)


@pytest.mark.parametrize("limit", [neardup.LIMIT, 900])
def test_near_duplicates(spark, limit):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    texts = []
    for _ in range(10):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(15, 120))]
        for _ in range(rng.choice([1, 3, 30, 90])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 14))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
    texts += ["one", "ONE", "two three", "two three four", "", None, "\t \n"]
    rng.shuffle(texts)
    df, rows = frame(spark, texts)
    got = neardup.near_duplicates(df, limit=limit).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute_components(rows)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    if limit == neardup.LIMIT:
        assert neardup.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []
        kept = neardup.drop_near_duplicates(df, 2)
        assert kept.columns == df.columns


def test_near_duplicates_among_alike_texts(spark):
    """Every two texts share about 0.3 of their shingles; only the planted copies are near-duplicates."""
    rng = random.Random(12)
    common = [f"c{k}" for k in range(46)]
    texts = [" ".join([*common, *(f"u{i}x{k}" for k in range(52))]) for i in range(400)]
    for k in range(0, 400, 40):
        w = texts[k].split()
        w[60] = "other"
        texts.append(" ".join(w))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    sketch, _ = neardup._sketch(2)
    keys = [r for b in sketch([pa.record_batch([pa.array([i for i, _ in rows]), pa.array(texts)], names=["doc_id", "text"])]) for r in b.column(4).to_pylist()]
    small = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2, neardup.T)
    share = [((small[a] == small[b]).any(1)).all() for a in range(100) for b in range(a)]
    assert np.mean(share) < 0.08
    got = neardup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute_components(rows)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7), (200, 201)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100, 200: 200, 201: 200}


def test_toxicity(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(3000)]
    bad = ["idiot", "moron", "scum", "worthless", "pathetic", "trash"]

    def text(toxic):
        w = [rng.choice(words) for _ in range(rng.randint(20, 80))]
        for _ in range(rng.randint(3, 5) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        return " ".join(w)

    rows = [(i, text(i % 5 == 0)) for i in range(800)] + [(801, None), (802, ""), (None, "idiot moron scum trash")]
    df = spark.createDataFrame([(*r, True) for r in rows], DOCS + ", toxic boolean")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    chain = toxicity.train(df, labels)
    assert len(chain.weights) == 4 and len(chain.weights[-1]) == len(chain.vocabulary) + 3 + 1
    got = {r.doc_id: r.toxic for r in toxicity.score(df, chain).collect()}
    held = [got[i] == (i % 5 == 0) for i in range(400, 800)]
    assert np.mean(held) > 0.97 and not got[801] and not got[802] and got[None]
    kept = toxicity.reject_toxic(df, labels)
    assert kept.columns == df.columns and kept.count() < df.count()
    assert not any(r.toxic for r in toxicity.score(df, toxicity.train(df, labels.limit(0))).collect())
    assert toxicity.score(df.limit(0), chain).collect() == []


def test_toxicity_keeps_documents_that_share_a_word(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(500)]
    common = min(("".join(rng.choice("klmnop") for _ in range(8)) for _ in range(100_000)), key=lambda w: zlib.crc32(w.encode()))
    rows = [(i, " ".join([common, *rng.sample(words, 30), *(["idiot", "scum"] if i % 4 == 0 else [])])) for i in range(240)]
    rows += [(1000 + i, rows[i][1]) for i in range(40)]  # true copies count once
    df = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    chain, y, fold, held = toxicity.trained(df, labels)
    assert len(y) == 240 and y[:, -1].sum() == 60
    assert all(r.toxic == (r.doc_id % 4 == 0) for r in toxicity.score(df, chain).collect())


def test_toxicity_chain_against_brute_force(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(400)]
    rows = []
    for i in range(300):
        w = [rng.choice(words) for _ in range(rng.randint(5, 5000 if i % 50 == 0 else 60))]
        if i % 3 == 0:
            w += rng.sample(["idiot", "worthless", "scum", "vile", "moron", "trash"], rng.randint(1, 3))
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
    rows += [(5, "another text under an id that is taken"), (7, rows[7][1])]
    labels = [(i, int(i % 3 == 0)) for i in range(300)]
    chain, y, fold, held = toxicity.trained(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int"))
    # the sample, its categories and its counts, by hand
    texts = {}
    for i, t in rows:
        texts[frozenset(toxicity.words_of(t)), i % 3 == 0] = t
    assert len(y) == len(texts)
    own = [[toxic and bool({*s} & ws) for s in toxicity.SEEDS.values()] + [toxic] for ws, toxic in texts]
    assert y.sum(0).tolist() == np.array(own, float).sum(0).tolist()
    n, total, counts = len(own), np.array(own).sum(0), {}
    for (ws, _), row in zip(texts, own, strict=True):
        for w in toxicity.tokens_of(set(ws)):
            counts.setdefault(w, []).append(row)
    gain = {}
    for w, have in counts.items():
        m, c = len(have), np.array(have).sum(0)
        if m >= toxicity.SUPPORT and 2 * c[-1] >= m and m < n:
            chi = [n * (a * n - m * b) ** 2 / (m * (n - m) * b * (n - b)) for a, b in zip(c.tolist(), total.tolist(), strict=True) if a * n > m * b and 0 < b < n]
            if chi and max(chi) >= toxicity.CHI2:
                gain[w] = max(chi)
    assert list(chain.vocabulary) == sorted(gain, key=lambda w: (-gain[w], w))[: toxicity.FEATURES]
    # out-of-fold: each probability comes from a model of the same form without the text's own fold
    x = np.concatenate([[[w in toxicity.tokens_of(set(ws)) for w in chain.vocabulary] for ws, _ in texts]]).astype(float)
    assert x.sum(0).tolist() == [len(counts[w]) for w in chain.vocabulary]
    assert held.shape == (n, 4) and ((held > 0) & (held < 1)).all() and len(set(fold)) > 1
    assert ((held[:, -1] >= 0.5) == (y[:, -1] > 0)).mean() > 0.9
    p = toxicity.Chain(chain.vocabulary, chain.weights).predict(x)
    by_hand = np.zeros((n, 0))
    for w in chain.weights:
        by_hand = np.concatenate([by_hand, 1 / (1 + np.exp(-np.clip(np.concatenate([x, by_hand], 1) @ w[:-1] + w[-1], -30, 30)))[:, None]], 1)
    assert np.allclose(p, by_hand)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    cols, rows = docs.columns, docs
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, DATA)
        assert rows.columns == cols, name
        rows = spark.createDataFrame(rows.collect(), docs.schema)
        kept.append(rows.count())
    assert sorted(kept, reverse=True) == kept and 0 < kept[-1] < docs.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, rows, DATA).collect()
    want = {r.doc_id: len(ids_of(r.text, "word_bpe_49k.json", 1)) for r in rows.collect()}
    assert {r.doc_id: r.doc_tokens for r in pieces} == want
    tests = spark.read.parquet(f"{DATA}/benchmark.parquet")
    assert not any(r.contaminated for r in decontam.match_tests(rows, tests).collect())
    assert [i for i, _, c in brute_components([(r.doc_id, r.text) for r in rows.collect()], 5) if i != c] == []


def test_words_of_long_texts():
    from siltstone.llm.texthash import SOLID, Spans, mix, raw_spans, words

    rng = random.Random(8)
    texts = [" ".join("".join(rng.choice("abcé") for _ in range(rng.randint(1, 9))) for _ in range(n)) for n in (0, 5, 3000)] + [None, "x" * 5000]
    h, at = words(texts, SOLID, b" ")
    one = np.concatenate([words([t], SOLID, b" ")[0] for t in texts])
    assert (h == one).all() and np.diff(at).tolist() == [len((t or "").split()) for t in texts]
    buf = np.frombuffer(texts[2].encode(), np.uint8)
    start = np.arange(0, len(buf) - 40, 7)
    assert (mix(raw_spans(buf, start, start + 40, 100)) == Spans(buf).hash(start, start + 40)).all()
