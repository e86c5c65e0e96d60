"""Near-duplicate hits over a whole table, keep-first.

Hits are taken in order of their identifier; one that is nearer than ``NEAR`` to a hit kept before it goes.
Likeness is 0.6 of Jaccard and 0.4 of cosine over the tokens of T.ascii_tokens, so that beyond 0.85 Jaccard is
beyond 0.75. Candidates come from MinHash over all documents, whatever their source and length:

1. Texts with equal token counts are one class; its least identifier stands for it.
2. Representatives that share one of ``BANDS`` keys of ``ROWS`` minhashes and at least half of ``SIGNS`` short
   minhashes are linked (a forest for each key, so that a hot group writes no pairs). Of pairs at a Jaccard
   of 0.75 0.0002 share no key, of pairs at 0.8 0.000003.
3. Linked documents form a block. Its first document is kept and compared with all others by a join, which takes
   most of a group of copies at once. Of what it doesn't take all near pairs are found by ``setjoin``, and rounds over
   them keep each that is near to no kept one before it. No block is ever in one task.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from itertools import pairwise
from math import sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import Tables
from . import setjoin

PART = 1024  # texts whose words are hashed at a time
NEAR, JACCARD, BANDS, ROWS, SIGNS, LINK, SAME = 0.85, 0.75, 32, 5, 96, 0.5, 0.9
_U = np.uint64
_rng = np.random.default_rng(85)
_MUL = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=_U) * _U(2) + _U(1)
_ADD = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=_U)
_FOLD = _rng.integers(0, 1 << 63, ROWS, dtype=_U) * _U(2) + _U(1)
_WORD = re.compile("[a-z0-9]+")
_SIGN = bytes(c if _WORD.match(chr(c)) else 32 for c in range(256))  # all other bytes of UTF-8 part words


def likeness(a: Counter, b: Counter) -> float:
    both = a.keys() & b.keys()
    if not both:
        return 0.0
    dot = sum(a[w] * b[w] for w in both)
    cosine = dot / (sqrt(sum(n * n for n in a.values())) * sqrt(sum(n * n for n in b.values())))
    return round(0.6 * round(len(both) / (len(a) + len(b) - len(both)), 9) + 0.4 * round(cosine, 9), 9)


def _near(a: Counter, b: Counter) -> float | None:
    if 4 * min(len(a), len(b)) < 3 * max(len(a), len(b)):
        return None
    s = likeness(a, b)
    return s if s > NEAR else None


def _mixed(x: np.ndarray, room: np.ndarray | None = None) -> np.ndarray:
    """x, mixed in its place; room is another array of its size."""
    room = np.empty_like(x) if room is None else room
    for by, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        np.right_shift(x, _U(by), out=room)
        x ^= room
        x *= _U(times)
    return x


def _sketch(batches):
    """Rows (id, t) -> (id, same, keys, signs); a part of a batch at a time, its different words are hashed once."""
    known: dict[str, bytes] = {}
    for batch in batches:
        step = max(1, min(PART, (8 << 20) * batch.num_rows // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield _sketched(*batch.slice(at, step).columns, known)


def _sketched(ids: pa.Array, texts: pa.Array, known: dict[str, bytes]) -> pa.RecordBatch:
    tokens = pc.ascii_split_whitespace(pa.array([t.translate(_SIGN) for t in texts.cast(pa.binary()).to_pylist()], pa.binary()).cast(pa.string()))
    words = tokens.flatten().dictionary_encode()
    doc, code = np.repeat(np.arange(len(tokens)), pc.list_value_length(tokens).to_numpy(zero_copy_only=False)), words.indices.to_numpy()
    vocabulary = words.dictionary.to_pylist()
    if "" in vocabulary:  # before the first or behind the last word
        real = code != vocabulary.index("")
        doc, code = doc[real], code[real]
    if len(known) > 500_000:
        known.clear()
    for w in vocabulary:
        if w not in known:
            known[w] = hashlib.blake2b(w.encode(), digest_size=16).digest()
    hashes = np.frombuffer(b"".join([known[w] for w in vocabulary]), "<u8").reshape(-1, 2)
    entry, tf = np.unique(doc << 32 | code, return_counts=True)
    doc, code = entry >> 32, entry & 0xFFFFFFFF
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])[: len(doc)])  # texts without words have none
    least, own, of_words = np.empty((len(_MUL), len(first)), _U), np.ascontiguousarray(hashes[:, 0]), np.empty(len(code), _U)
    mixed, room = np.empty_like(own), np.empty_like(own)
    for k in range(len(_MUL)) if len(first) else ():
        np.multiply(own, _MUL[k], out=mixed)
        mixed += _ADD[k]
        np.take(_mixed(mixed, room), code, out=of_words, mode="clip")
        np.minimum.reduceat(of_words, first, out=least[k])
    least = least.T
    keys = _mixed((least.reshape(-1, BANDS, ROWS) * _FOLD).sum(2, dtype=_U) + np.arange(BANDS, dtype=_U) * _U(0x9E3779B97F4A7C15))
    order = np.argsort(doc << 32 | np.argsort(np.argsort(own))[code])  # by hash within a text, whatever else the part holds
    counted = np.column_stack([hashes[code[order]], tf[order].astype(_U)])
    same = [hashlib.blake2b(counted[a:b].tobytes(), digest_size=16).digest() for a, b in pairwise([*first.tolist(), len(doc)])]
    signs = [x.tobytes() for x in (least[:, :SIGNS] >> _U(20)).astype(np.uint8)]
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.view(np.int64).ravel()))
    return pa.record_batch([ids.take(pa.array(doc[first])), pa.array(same, pa.binary()), lists, pa.array(signs, pa.binary())], names=["id", "same", "keys", "signs"])


def _forest(ids: np.ndarray, signs: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links (least of the tree, member) of documents that share at least so many short minhashes, over any number of steps."""
    out, left = [], np.arange(len(ids))
    while len(left) > 1:
        root, left = left[0], left[1:]
        queue = [root]
        while queue and len(left):
            hit = (signs[left] == signs[queue.pop()]).mean(1) >= least
            got = left[hit]
            out += [(int(ids[root]), int(ids[v])) for v in got]
            queue += got.tolist()
            left = left[~hit]
    return out


def _links(least: float, forward: bool):
    """Of rows (key, id, signs), those of a key one after another: links (null, a, null, b), and forward what no link has reached.

    Most keys have one row; only those of several rows are looked at one by one."""

    def linked(ids, signs):
        order = np.argsort(ids, kind="stable")
        return _forest(ids[order], signs[order], least)

    def made(links, rows=None):
        key, ids, signs = rows or (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, SIGNS), np.uint8))
        a, b = (pa.array([x[i] for x in links], pa.int64()) for i in (0, 1))
        none = lambda n, kind: pa.nulls(n, kind)
        cols = [
            [none(len(links), pa.int64()), pa.array(key)], [a, pa.array(ids)],
            [none(len(links), pa.binary()), pa.array([x.tobytes() for x in signs], pa.binary())], [b, none(len(ids), pa.int64())],
        ]
        return pa.record_batch([pa.concat_arrays(c) for c in cols], names=["key", "a", "signs", "b"])

    def told(batch):
        key, ids = (batch.column(k).to_numpy() for k in (0, 1))
        signs = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(ids), SIGNS)
        return key, ids, signs

    def edges(key):
        return np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])

    def run_forward(batches):  # rows as they come: batches stand for themselves
        for batch in batches:
            key, ids, signs = told(batch)
            order = np.argsort(key, kind="stable")
            key, ids, signs = key[order], ids[order], signs[order]
            ends, links, left = edges(key), [], np.ones(len(key), bool)
            for g in np.flatnonzero(np.diff(ends) > 1):
                own = slice(ends[g], ends[g + 1])
                more = linked(ids[own], signs[own])
                left[own] = ~np.isin(ids[own], [b for _, b in more])
                links += more
            yield made(links, (key[left], ids[left], signs[left]))

    def run_grouped(batches):
        held_key, held = None, []  # rows of the key that the last batch ended with

        def flushed():
            if sum(len(i) for i, _ in held) < 2:
                return []
            return linked(np.concatenate([i for i, _ in held]), np.concatenate([s for _, s in held]))

        for batch in batches:
            if not batch.num_rows:
                continue
            key, ids, signs = told(batch)
            ends, links = edges(key), []
            last = len(ends) - 2
            for g in sorted({0, last} | set(np.flatnonzero(np.diff(ends) > 1).tolist())):
                own = slice(ends[g], ends[g + 1])
                if 0 < g < last:
                    links += linked(ids[own], signs[own])
                    continue
                if key[own.start] != held_key:
                    links += flushed()
                    held_key, held = key[own.start], []
                held.append((ids[own], signs[own]))
            yield made(links)
        yield made(flushed())

    return run_forward if forward else run_grouped


def _components(tables: Tables, edges: DataFrame) -> DataFrame:
    """(id, block): block is the least identifier that can be reached."""
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")
    both = tables.write(edges.select(ways).select("e.a", "e.b").distinct())
    labels = tables.write(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("block")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "block"), "b").groupBy(F.col("a").alias("id")).agg(F.min("block").alias("near"))
        step = labels.join(near, "id").select("id", F.col("block").alias("was"), F.least("block", "near").alias("c"))
        up = labels.select(F.col("id").alias("c"), F.col("block").alias("up"))
        new = tables.write(step.join(up, "c", "left").select("id", "was", F.least("c", F.coalesce("up", "c")).alias("block")))
        labels = new.select("id", "block")
        if new.where("block <> was").isEmpty():
            return labels


def _by_first(batches):
    """Rows (block, id, t, first) -> (block, id, score); the score is null where the block's first document isn't near."""
    text, first = None, None
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            out = []
            for block, i, t, f in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                if f != text:
                    text, first = f, Counter(_WORD.findall(f))
                out.append((block, i, _near(first, Counter(_WORD.findall(t)))))
            cols = list(zip(*out, strict=True))
            yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["block", "id", "score"])


def _kept_first(rest: DataFrame, tables: Tables) -> DataFrame:
    """rest(id, t), texts of different counts -> (a, b, score) of those that a kept one takes."""
    counts = tables.write(setjoin.counts_of(rest.select("id", T.ascii_tokens(F.col("t")).alias("tokens"))))
    score = F.round(0.6 * F.round("jaccard", 9) + 0.4 * F.round("cosine", 9), 9)
    near = tables.write(setjoin.jaccard_join(counts, JACCARD).select("a", "b", score.alias("score")).where(F.col("score") > NEAR))
    told = setjoin.keep_first(near)
    kept, gone = told.where("kept").select(F.col("id").alias("a")), told.where("not kept").select(F.col("id").alias("b"))
    return near.join(kept, "a").join(gone, "b").groupBy("b").agg(F.min(F.struct("a", "score")).alias("x")).select("x.a", "b", "x.score")


def near_hits(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (a, b, score): b goes, since it is near to a, the first that is kept of those near it.

    Rows of null identifier or without tokens take no part; identifiers are unique."""
    with Tables(docs.sparkSession, "nearhits") as tables:
        return tables.release(tables.write(_near_hits(docs, tables)))


def _near_hits(docs: DataFrame, tables: Tables) -> DataFrame:
    held = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), F.lower(F.coalesce("text", F.lit(""))).alias("t"))
    sketch = tables.write(held.mapInArrow(_sketch, "id long, same binary, keys array<long>, signs binary"))
    reps = tables.write(sketch.groupBy("same").agg(F.min(F.struct("id", "keys", "signs")).alias("r")).select("same", "r.*"))
    schema = "key long, a long, signs binary, b long"
    local = tables.write(reps.select(F.explode("keys").alias("key"), "id", "signs").mapInArrow(_links(SAME, True), schema))
    met = local.where("key is not null").select("key", F.col("a").alias("id"), "signs").repartition("key").sortWithinPartitions("key").mapInArrow(_links(LINK, False), schema)
    blocks = _components(tables, local.where("key is null").select("a", "b").union(met.select("a", "b")))
    member = tables.write(blocks.join(held, "id").select("block", "id", "t"))
    first = member.where("block = id").select("block", F.col("t").alias("first"))
    asked = member.where("block <> id").join(first.hint("merge"), "block").select("block", "id", "t", "first")
    by_first = tables.write(asked.mapInArrow(_by_first, "block long, id long, score double"))
    rest = _kept_first(by_first.where("score is null").select("id").join(member, "id").select("id", "t"), tables)
    gone = tables.write(by_first.where("score is not null").select(F.col("block").alias("a"), F.col("id").alias("b"), "score").union(rest))
    # others of a class go with what took its representative, or else with that
    copies = sketch.select("same", F.col("id").alias("b")).join(reps.select("same", F.col("id").alias("rep")), "same").where("b <> rep")
    taken = gone.select(F.col("b").alias("rep"), "a", "score")
    more = copies.join(taken, "rep", "left").select(F.coalesce("a", "rep").alias("a"), "b", F.coalesce("score", F.lit(1.0)).alias("score"))
    return gone.union(more)
