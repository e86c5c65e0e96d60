"""Repeated strings by prefix-free parsing.

Every byte of a string of ``length`` bytes that also starts earlier is removed (earlier: in a
smaller document, or further to the front of the same one).

* Triggers. A rolling hash runs over ``GRAM`` bytes. The place with the least hash in a string of
  length bytes (the leftmost of equals) is its trigger: equal strings have equal triggers.
* Phrases. The strings that share a trigger start side by side; together they are a phrase,
  at most 2 * length - GRAM bytes. A string lies in exactly one phrase, so the parse of a document
  is the sequence of its phrases, and where a string ranks in the corpus is settled by the
  dictionary: no string reaches into the next phrase.
* Dictionary. Phrases are sorted by trigger and content. All but the earliest occurrence
  of a phrase are repeats through and through; a trigger that stands in one content only
  needs no more work. This is where repetitive text shrinks: copies cost one record a phrase.
* Suffixes. Where a trigger stands in several contents, the earliest occurrence of each sends
  its bytes; the suffix array of these phrases puts their suffixes of length bytes in the order of trigger, distance
  to it, bytes, document and place, and all but the first of equal ones are repeats.

Texts are laid out once as files in the shared folder, in order of documents; records meet
by trigger and verdicts by file, both as packed arrays. Occurrences that are equal inside a
file are brought together before the shuffle, so a group of copies sends one record
a file. Only whole phrases and never pairs are written.

Defined results: a null text is empty; a null doc_id ranks first; rows with equal doc_id rank by
a hash of their text, each a document of its own; texts below length bytes are kept whole.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import collected, file_system, rows, shared_dir, width, written
from .texthash import BASES, Spans, mix

GRAM, LENGTH, PIECE = 32, 100, 1 << 20
_U = np.uint64
_COLS = (("g", "<u8"), ("c", "<u8"), ("c2", "<u8"), ("ord", "<i8"), ("at", "<i8"), ("n", "<u2"), ("off", "<u2"))
_DUP = (("ord", "<i8"), ("at", "<i8"), ("n", "<u4"))
_ASK = (("g", "<u8"), ("ord", "<i8"), ("at", "<i8"), ("n", "<u4"), ("off", "<u4"))
_BLOB = "part int, kind string, data binary"


def _packed(cols, arrays, pick) -> bytes:
    return b"".join(np.ascontiguousarray(arrays[n][pick], t).tobytes() for n, t in cols)


def _unpacked(cols, blobs: list[bytes]) -> dict[str, np.ndarray]:
    got = {n: [] for n, _ in cols}
    size = sum(np.dtype(t).itemsize for _, t in cols)
    for b in blobs:
        k, at = len(b) // size, 0
        for n, t in cols:
            got[n].append(np.frombuffer(b, t, k, at))
            at += k * np.dtype(t).itemsize
    return {n: np.concatenate(got[n]) if got[n] else np.zeros(0, t) for n, t in cols}


def _batch(out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) or [[], [], []]
    return pa.record_batch([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.binary())], names=["part", "kind", "data"])


def _by(where: np.ndarray, parts: int):
    order = np.argsort(where, kind="stable")
    cut = np.searchsorted(where[order], np.arange(parts + 1))
    for p in range(parts):
        if cut[p + 1] > cut[p]:
            yield p, order[cut[p] : cut[p + 1]]


def phrases(data: bytes, length: int, gram: int = GRAM) -> dict[str, np.ndarray]:
    """The phrases of a text: trigger and content hash, first string, strings, and repeats that follow at once."""
    found = []
    for begin in range(0, max(1, len(data) - length + 1), PIECE):
        buf = np.frombuffer(data, np.uint8)[begin : begin + PIECE + length - 1]
        n = len(buf) - length + 1
        if n <= 0:
            continue
        h, other = Spans(buf), Spans(buf, BASES[1])
        k = len(buf) - gram + 1
        hashes = mix((h.sums[gram:] - h.sums[:-gram]) * h.inv[:k])
        low = (hashes & _U(0xFFFFFFFF00000000)) | np.arange(k, dtype=_U)
        span, want = 1, length - gram + 1
        while span * 2 <= want:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < want:
            low = np.minimum(low[: len(low) - (want - span)], low[want - span :])
        trigger = (low & _U(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], trigger[1:] != trigger[:-1]]))
        count = np.diff(np.append(first, n))
        t = trigger[first]
        c = mix(h.raw(first, first + count + length - 1) + (t - first).astype(_U) * _U(0x9E3779B97F4A7C15) + count.astype(_U))
        c2 = mix(other.raw(first, first + count + length - 1))
        g = hashes[t]
        rep = np.ones(len(first), np.int64)
        if len(first) > 1:  # runs of one byte and the like: string after string with the same content
            same = (count[1:] == 1) & (count[:-1] == 1) & (c[1:] == c[:-1]) & (c2[1:] == c2[:-1]) & (g[1:] == g[:-1])
            if same.any():
                lead = np.flatnonzero(np.concatenate([[True], ~same]))
                rep = np.diff(np.append(lead, len(first)))
                first, count, c, c2, g, t = first[lead], count[lead], c[lead], c2[lead], g[lead], t[lead]
        found.append({"g": g, "c": c, "c2": c2, "at": first + begin, "n": count, "rep": rep, "off": t - first})
    names = ("g", "c", "c2", "at", "n", "rep", "off")
    return {x: np.concatenate([f[x] for f in found]) if found else np.zeros(0, _U if x in ("g", "c", "c2") else np.int64) for x in names}


def _leaders(r: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order by trigger, content and place, and which of it are the first of their content."""
    order = np.lexsort((r["at"], r["ord"], r["c2"], r["c"], r["g"]))
    new = np.zeros(max(0, len(order) - 1), bool)
    for x in ("g", "c", "c2"):
        new |= r[x][order[1:]] != r[x][order[:-1]]
    return order, np.append(len(order) > 0, new)[: len(order)]


def _repeats(r: dict[str, np.ndarray], order: np.ndarray, lead: np.ndarray) -> dict[str, np.ndarray]:
    """Places of strings that are known to be repeats: all of later occurrences, and what follows a first at once."""
    late, more = order[~lead], order[lead]
    more = more[r["rep"][more] > 1]
    return {
        "ord": np.concatenate([r["ord"][late], r["ord"][more]]),
        "at": np.concatenate([r["at"][late], r["at"][more] + 1]),
        "n": np.concatenate([r["n"][late] + r["rep"][late] - 1, r["rep"][more] - 1]),
    }


def _suffix_order(buf: np.ndarray, start: np.ndarray, group: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of length bytes by group, then bytes, then place; and which have an equal one before them.

    The order is refined eight bytes at a time among those that are still equal, so bytes decide, never a hash."""
    n = len(start)
    order = np.lexsort((place, group))
    if not n:
        return order, np.zeros(0, bool)
    eight = np.lib.stride_tricks.sliding_window_view(np.append(buf, np.zeros(8, np.uint8)), 8)
    g = group[order]
    same = np.concatenate([[False], g[1:] == g[:-1]])
    for k in range(0, length, 8):
        open_ = np.flatnonzero(same | np.append(same[1:], False))
        if not len(open_):
            break
        rank = np.cumsum(~same[open_])  # of those that are equal so far
        own = order[open_]
        x = eight[start[own] + k].copy()
        x[:, max(0, length - k) :] = 0
        w = x.view(">u8").ravel().astype(_U)
        o = np.lexsort((place[own], w, rank))
        order[open_], w, rank = own[o], w[o], rank[o]
        same[open_] = np.concatenate([[False], (w[1:] == w[:-1]) & (rank[1:] == rank[:-1])])
    late = np.zeros(n, bool)
    late[order] = same
    return order, late


def lay_out(docs: DataFrame, parts: int) -> DataFrame:
    """Files of ord, doc_id and text in order of documents; returns (part, path)."""
    out = shared_dir(docs.sparkSession)
    schema = pa.schema([("ord", pa.int64()), ("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        fs, root = file_system(out)
        fs.create_dir(root, recursive=True)
        part, n, sink, name = TaskContext.get().partitionId(), 0, None, ""
        for b in batches:
            if b.num_rows:
                if sink is None:
                    name = f"{part:06d}-{uuid.uuid4().hex}.parquet"
                    sink = pq.ParquetWriter(f"{root}/{name}", schema, filesystem=fs, compression="zstd")
                ids = pa.array(np.arange(n, n + b.num_rows) + (part << 40))
                cols = [ids, b.column(b.schema.get_field_index("doc_id")).cast(pa.int64()), b.column(b.schema.get_field_index("text")).cast(pa.string())]
                sink.write_table(pa.Table.from_arrays(cols, schema=schema), row_group_size=1024)
                n += b.num_rows
        if sink is not None:
            sink.close()
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([f"{out}/{name}"])], names=["part", "path"])

    laid = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    laid = laid.repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    return collected(laid.mapInArrow(run, "part int, path string"))


def _texts(path: str):
    fs, p = file_system(path)
    with pq.ParquetFile(p, filesystem=fs) as f:
        for b in f.iter_batches(batch_size=512):
            yield from rows([b], "ord", "doc_id", "text")


def repeated_strings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """For each row of ``docs(doc_id, text)``: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    if length >= 1 << 15:
        raise ValueError("strings of 32768 bytes or more")
    parts = width(docs.sparkSession)
    files = lay_out(docs, parts)

    def parse(batches):
        for part, path in rows(batches, "part", "path"):
            got = []
            for ord_, _, text in _texts(path):
                r = phrases(text.encode(), length, gram)
                if len(r["g"]):
                    got.append(r | {"ord": np.full(len(r["g"]), ord_)})
            if not got:
                continue
            r = {n: np.concatenate([x[n] for x in got]) for n in (*dict(_COLS), "rep")}
            del got
            order, lead = _leaders(r)
            dup = _repeats(r, order, lead)
            dup["n"] = dup["n"].astype(np.int64)
            if len(dup["ord"]):
                yield _batch([(part % parts, f"dup:{part}", _packed(_DUP, dup, slice(None)))])
            first = np.sort(order[lead])
            own = {n: v[first] for n, v in r.items()}  # what follows at once has been told already
            for p, pick in _by((own["g"] % _U(parts)).astype(np.int64), parts):
                yield _batch([(p, "phrase", _packed(_COLS, own, pick))])

    def sort_phrases(batches):
        blobs = []
        for _, kind, data in rows(batches, "part", "kind", "data"):
            if kind == "phrase":
                blobs.append(data)
            else:
                yield _batch([(int(kind[4:]), "dup", data)])
        r = _unpacked(_COLS, blobs)
        r["n"] = r["n"].astype(np.int64)
        r["rep"] = np.ones(len(r["n"]), np.int64)
        blobs.clear()
        order, lead = _leaders(r)
        dup = _repeats(r, order, lead)
        for p, pick in _by_file(dup["ord"]):
            yield _batch([(p, "dup", _packed(_DUP, dup, pick))])
        first = order[lead]
        g = r["g"][first]
        several = np.zeros(len(g), bool)
        if len(g) > 1:
            same = g[1:] == g[:-1]
            several[1:] |= same
            several[:-1] |= same
        ask = {n: r[n][first[several]] for n, _ in _ASK}
        for p, pick in _by_file(ask["ord"]):
            yield _batch([(p, "ask", _packed(_ASK, ask, pick))])

    def fetch(batches):
        asked, paths = {}, {}
        for part, kind, data in rows(batches, "part", "kind", "data"):
            if kind == "file":
                paths[part] = data.decode()
            else:
                asked.setdefault(part, []).append(data)
        for part, blobs in asked.items():
            r = _unpacked(_ASK, blobs)
            order = np.lexsort((r["at"], r["ord"]))
            r = {n: v[order] for n, v in r.items()}
            ends = np.searchsorted(r["ord"], np.arange((part << 40), (part << 40) + 1))
            at = int(ends[0])
            held, picked, size = [], [], 0

            def send(picked=picked, held=held, r=r):
                pick = np.concatenate(picked)
                lens = r["n"][pick].astype(np.int64) + length - 1
                begin = np.cumsum(lens) - lens
                buf = np.frombuffer(b"".join(held), np.uint8)
                for p, k in _by((r["g"][pick] % _U(parts)).astype(np.int64), parts):
                    take = np.repeat(begin[k] - (np.cumsum(lens[k]) - lens[k]), lens[k]) + np.arange(lens[k].sum())
                    head = np.array([len(k)], "<i8").tobytes()
                    yield _batch([(p, "text", head + _packed(_ASK, r, pick[k]) + buf[take].tobytes())])

            for ord_, _, text in _texts(paths[part]):
                end = at + int(np.searchsorted(r["ord"][at:], ord_, side="right"))
                if end > at:
                    data = text.encode()
                    for k in range(at, end):
                        s = int(r["at"][k])
                        held.append(data[s : s + int(r["n"][k]) + length - 1])
                    picked.append(np.arange(at, end))
                    size += sum(len(x) for x in held[-(end - at) :])
                    at = end
                if size > 8 << 20:
                    yield from send()
                    held.clear()
                    picked.clear()
                    size = 0
            if picked:
                yield from send()

    def sort_suffixes(batches):
        parts_, texts, order_ = [], [], []
        size = sum(np.dtype(t).itemsize for _, t in _ASK)
        for (data,) in rows(batches, "data"):
            k = int(np.frombuffer(data, "<i8", 1)[0])
            parts_.append(data[8 : 8 + k * size])
            texts.append(data[8 + k * size :])
        r = _unpacked(_ASK, parts_)
        text = np.frombuffer(b"".join(texts), np.uint8)
        texts.clear()
        lens = r["n"].astype(np.int64) + length - 1
        begin = np.cumsum(lens) - lens
        group = mix(r["g"])
        order_ = np.argsort(group, kind="stable")
        # whole groups of a trigger, a few million suffixes at a time
        cut, done = [0], 0
        n = r["n"][order_].astype(np.int64)
        new = np.concatenate([[True], group[order_][1:] != group[order_][:-1]]) if len(n) else np.zeros(0, bool)
        total = np.cumsum(n)
        for k in np.flatnonzero(new):
            before = int(total[k - 1]) if k else 0
            if before - done > 2_000_000:
                cut.append(int(k))
                done = before
        cut.append(len(n))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if b > a:
                yield from _resolve({x: v[order_[a:b]] for x, v in r.items()}, begin[order_[a:b]], text)

    def _resolve(r, begin, text):
        n = r["n"].astype(np.int64)
        lens = n + length - 1
        out = np.cumsum(lens) - lens
        buf = text[np.repeat(begin - out, lens) + np.arange(lens.sum())]
        row = np.repeat(np.arange(len(n)), n)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at, ord_ = r["at"][row] + inner, r["ord"][row]
        # the suffix array of these phrases: by trigger, distance to it and bytes
        _, group = np.unique(r["g"], return_inverse=True)
        group = group[row] * (2 * length + 1) + (r["off"][row].astype(np.int64) - inner) + length
        place = np.empty(len(at), np.int64)
        place[np.lexsort((at, ord_))] = np.arange(len(at))
        late = _suffix_order(buf, out[row] + inner, group, place, length)[1]
        # runs of repeats inside a phrase
        edge = np.flatnonzero(late & ~np.concatenate([[False], late[:-1] & (row[1:] == row[:-1])]))
        stop = np.flatnonzero(late & ~np.concatenate([late[1:] & (row[1:] == row[:-1]), [False]]))
        dup = {"ord": ord_[edge], "at": at[edge], "n": stop - edge + 1}
        for p, pick in _by_file(dup["ord"]):
            yield _batch([(p, "dup", _packed(_DUP, dup, pick))])

    def _by_file(ord_):
        where = ord_ >> 40
        order = np.argsort(where, kind="stable")
        for p in np.unique(where):
            a, b = np.searchsorted(where[order], [p, p + 1])
            yield int(p), order[a:b]

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    kinds = [pa.int64()] * 4 + [pa.string()]

    def cut_out(batches):
        told, paths = {}, {}
        for part, kind, data in rows(batches, "part", "kind", "data"):
            if kind == "file":
                paths[part] = data.decode()
            else:
                told.setdefault(part, []).append(data)
        for part, path in paths.items():
            r = _unpacked(_DUP, told.pop(part, []))
            order = np.argsort(r["ord"], kind="stable")
            r = {n: v[order] for n, v in r.items()}
            out, at = [], 0
            for ord_, doc_id, text in _texts(path):
                data = text.encode()
                end = at + int(np.searchsorted(r["ord"][at:], ord_, side="right"))
                n_removed = n_spans = 0
                if end > at:
                    edge = np.zeros(len(data) + 1, np.int64)
                    s = r["at"][at:end]
                    np.add.at(edge, s, 1)
                    np.add.at(edge, s + r["n"][at:end].astype(np.int64) + length - 1, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    n_removed = int(gone.sum())
                    n_spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                    at = end
                else:
                    kept = data
                out.append((doc_id, len(data), n_removed, n_spans, hashlib.sha256(kept).hexdigest()))
                if len(out) == 4096:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                    out = []
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    met = files.repartition(parts).mapInArrow(parse, _BLOB).repartition(parts, "part")
    verdicts = written(met.mapInArrow(sort_phrases, _BLOB))
    places = files.select("part", F.lit("file").alias("kind"), F.encode("path", "utf-8").alias("data"))
    asked = verdicts.where("kind = 'ask'").union(places).repartition(parts, "part").mapInArrow(fetch, _BLOB)
    sorted_ = asked.repartition(parts, "part").mapInArrow(sort_suffixes, _BLOB)
    told = verdicts.where("kind = 'dup'").union(sorted_).union(places).repartition(parts, "part")
    return told.mapInArrow(cut_out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op7_prefix_free_repeats(spark, sf_dir):
    return repeated_strings(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) h FROM documents),
f AS (SELECT doc_id, o, substr(h, 2 * o + 1, 1222) h FROM (SELECT doc_id, h, unnest(range(0, greatest(0, len(h) // 2 - 99), 512)) o FROM d)),
w AS (SELECT doc_id, o + j k, substr(h, 2 * j + 1, 200) x FROM (SELECT doc_id, o, h, unnest(range(0, least(512, len(h) // 2 - 99))) j FROM f)),
r AS (SELECT doc_id, k FROM w QUALIFY row_number() OVER (PARTITION BY x ORDER BY doc_id, k) > 1),
p AS (SELECT doc_id, k, lag(k) OVER (PARTITION BY doc_id ORDER BY k) before FROM r),
i AS (SELECT doc_id, k, sum(CASE WHEN before IS NULL OR k - before > 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) island FROM p),
s AS (SELECT doc_id, min(k) a, max(k) + 100 b FROM i GROUP BY doc_id, island),
g AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) z FROM s),
c AS (SELECT doc_id, sum(b - a) n_removed, count(*) n_spans, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) front, max(b) last FROM g JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) n_spans,
  sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(last, 0) + 1))) kept_sha256
FROM d LEFT JOIN c USING (doc_id)
"""
