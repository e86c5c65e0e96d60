"""Benchmark decontamination by training suffix arrays.

Each task builds a suffix array over the words of a shard of documents (about ``SHARD``
bytes): word positions ordered by the ``DEPTH`` words that begin there, not crossing
documents. Every suffix of every test item is found by binary search in every shard.

* ``longest_matches`` tells for each item its longest verbatim match in all documents and where it is:
  the suffixes next to a test suffix in the array share the most words with it; matches of
  DEPTH words are followed word by word to their end.
* ``match_tests`` tells for each document what it holds of the tests. A window is DEPTH consecutive words of an item, or
  the whole of a shorter one. Only positions that can begin a whole window are in its arrays: every one of
  their first words, as many as the shortest window that they could hold has, occurs in the tests; a test's
  last DEPTH - 1 suffixes can't fill a window and aren't asked. The longest verbatim match of
  the document that holds a window, and its place, come with it: windows that follow one another in the
  document and the item are one match.

The tests are written as blocks of at most ``BLOCK`` suffixes in the shared folder. A task builds the arrays of up to
``AHEAD`` shards and then reads the blocks one by one against all of them, so that neither a broadcast nor a
task's memory grows with the tests, and one reading of a block serves several shards. Documents
aren't shuffled at all; a common passage costs no more than any other.

Defined results: a null text has no words; an item without words, or with a null id, asks
for nothing; repeated items count once each id; repeated documents are answered each; an
empty table of tests hits nothing; of equally long matches the smaller item_id, then the earlier place, is told.
"""

from __future__ import annotations

import hashlib
import io
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunked, file_system, rows, shared_dir
from .texthash import LETTERS, words

DEPTH, SHARD, BLOCK, AHEAD = 10, 4 << 20, 200_000, 4
_U = np.uint64


class SuffixArray:
    """Positions of words, ordered by the depth words that begin there; ends of documents sort first."""

    def __init__(self, word: np.ndarray, end: np.ndarray, keep: np.ndarray, depth: int):
        """end: for each position, where its document ends. keep: the positions that are ordered."""
        at = keep[:, None] + np.arange(depth)
        inside = at < end[keep][:, None]
        self.inside = inside
        self.column = np.where(inside, word[np.minimum(at, max(len(word) - 1, 0))], _U(0)) if len(keep) else np.zeros((0, depth), _U)
        order = np.lexsort([x for d in range(depth - 1, -1, -1) for x in (self.column[:, d], inside[:, d])]) if len(keep) else np.zeros(0, int)
        self.places, self.column, self.inside = keep[order], self.column[order], inside[order]

    def _less(self, mid: np.ndarray, query: np.ndarray, length: np.ndarray, or_equal: bool) -> np.ndarray:
        """Whether the suffix at each mid sorts before the query's first length words (or begins with them)."""
        x, inside = self.column[mid], self.inside[mid]
        d = np.arange(x.shape[1])
        differs = ((x != query) | ~inside) & (d < length[:, None])
        first = np.where(differs.any(1), differs.argmax(1), -1)
        k = np.maximum(first, 0)
        i = np.arange(len(mid))
        return np.where(first < 0, or_equal, ~inside[i, k] | (x[i, k] < query[i, k]))

    def find(self, query: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query the range of suffixes that begin with its first length words."""
        ends = []
        for or_equal in (False, True):
            lo, hi = np.zeros(len(query), int), np.full(len(query), len(self.places))
            while (open_ := lo < hi).any():
                mid = np.where(open_, (lo + hi) // 2, 0)
                less = self._less(mid, query, length, or_equal) if len(self.places) else open_
                lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
            ends.append(lo)
        return ends[0], ends[1]

    def longest(self, query: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query the words of its longest match, up to length, and the first place in the array that has it (or -1)."""
        lo, _ = self.find(query, length)
        best = np.zeros(len(query), int)
        for at in (lo - 1, lo):
            ok = (at >= 0) & (at < len(self.places))
            if ok.any():
                k = np.where(ok, at, 0)
                same = (self.column[k] == query) & self.inside[k] & (np.arange(query.shape[1]) < length[:, None])
                best = np.maximum(best, np.where(ok, np.cumprod(same, 1).sum(1), 0))
        first, _ = self.find(query, best)
        return best, np.where(best > 0, first, -1)


def _suffixes(h: np.ndarray, depth: int, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """The first depth words of each suffix of an item's words, and how many there are. whole: only those that fill a window."""
    n = max(1, len(h) - depth + 1) if whole else len(h)
    k = np.arange(n)[:, None] + np.arange(depth)
    length = np.minimum(len(h) - np.arange(n), depth)
    return np.where(k < len(h), h[np.minimum(k, len(h) - 1)], _U(0)), length


def write_tests(tests: DataFrame, depth: int = DEPTH, whole: bool = True, block: int = BLOCK) -> list[str]:
    """Blocks of the suffixes of ``tests(item_id, text)`` in the shared folder; returns their paths.

    whole: only suffixes that fill a window (depth words, or the whole of a shorter item)."""
    out = shared_dir(tests.sparkSession)

    def run(batches):
        fs, root = file_system(out)
        fs.create_dir(root, recursive=True)

        def put(held):
            buf = io.BytesIO()
            cols = {n: np.concatenate(c) for n, c in zip(("item", "query", "length", "at"), zip(*held, strict=True), strict=True)}
            np.savez(buf, words=np.unique(np.concatenate([q[np.arange(q.shape[1]) < n[:, None]] for _, q, n, _ in held])), **cols)
            name = f"{uuid.uuid4().hex}.npz"
            with fs.open_output_stream(f"{root}/{name}") as f:
                f.write(buf.getvalue())
            return pa.record_batch([pa.array([f"{out}/{name}"])], names=["path"])

        held, size = [], 0
        for i, text in rows(batches, "item_id", "text"):
            h, _ = words([text], LETTERS, b" ")
            for a in range(0, len(h), block):  # a piece of a very long item, with the words that its last suffixes reach
                q, n = _suffixes(h[a : a + block + depth - 1], depth, whole)
                q, n = q[:block], n[:block]
                if a and whole:
                    q, n = q[n == depth], n[n == depth]
                if len(q):
                    held.append((np.full(len(q), i, np.int64), q, n.astype(np.int64), np.arange(a, a + len(q))))
                    size += len(q)
                if size >= block:
                    yield put(held)
                    held, size = [], 0
        if held:
            yield put(held)

    got = tests.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    return sorted(r.path for r in got.mapInArrow(run, "path string").collect())  # a short string for each block of tests


def _load(path: str) -> dict[str, np.ndarray]:
    fs, p = file_system(path)
    with fs.open_input_file(p) as f:
        return dict(np.load(io.BytesIO(f.read())))


class _Tests:
    """Blocks by path; keeps one, the usual case, and otherwise loads each in turn."""

    def __init__(self, paths: list[str]):
        self.paths, self.kept = paths, {}

    def __iter__(self):
        for p in self.paths:
            if p not in self.kept:
                self.kept = {p: _load(p)}
            yield self.kept[p]


class Shard:
    """The words of some texts, and what has been found in them."""

    def __init__(self, texts: list[str | None], depth: int):
        self.depth = depth
        self.word, self.at = words(texts, LETTERS, b" ")
        self.n = len(self.word)
        self.end = np.repeat(self.at[1:], np.diff(self.at))
        self.doc_of = np.repeat(np.arange(len(texts)), np.diff(self.at))
        self.cover = np.zeros(self.n + 1, np.int64)
        self.items: list[set[int]] = [set() for _ in texts]
        self.best: list[tuple] = [(0, 0, 0)] * len(texts)  # words (negative, so that the least is the best), item, place

    def _tell(self, item: int, begin: int, words_: int) -> None:
        d = int(self.doc_of[begin])
        self.best[d] = min(self.best[d], (-words_, item, begin - int(self.at[d])))

    def search(self, t: dict[str, np.ndarray]) -> None:
        """Finds the windows of a block of tests."""
        if not self.n:
            return
        n, depth = self.n, self.depth
        known = np.isin(self.word, t["words"])
        stop = np.where(known, n, np.arange(n))
        stop = np.minimum(np.minimum.accumulate(stop[::-1])[::-1], self.end)  # the first position from here that can't be in a match
        run = stop - np.arange(n)
        keep = run >= depth
        for m in np.unique(t["length"][t["length"] < depth]):
            keep |= (run >= m) & np.isin(self.word, t["query"][t["length"] == m, 0])
        sa = SuffixArray(self.word, self.end, np.flatnonzero(keep), depth)
        lo, hi = sa.find(t["query"], t["length"])
        item, size, begin = [], [], []
        for k in np.flatnonzero(hi > lo):
            p = sa.places[lo[k] : hi[k]]
            m = int(t["length"][k])
            np.add.at(self.cover, p, 1)
            np.add.at(self.cover, p + m, -1)
            for d in np.unique(self.doc_of[p]):
                self.items[d].add(int(t["item"][k]))
            begin.append(p)
            size.append(np.full(len(p), m))
            item.append(np.stack([np.full(len(p), t["item"][k]), p - t["at"][k]]))
        if not begin:
            return
        # windows that follow one another in item and document are one match
        begin, size, both = np.concatenate(begin), np.concatenate(size), np.concatenate(item, 1)
        order = np.lexsort((begin, both[1], both[0]))
        begin, size, both = begin[order], size[order], both[:, order]
        new = np.concatenate([[True], (both[:, 1:] != both[:, :-1]).any(0) | (begin[1:] != begin[:-1] + 1)])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(begin)) - 1
        whole = begin[last] + size[last] - begin[first]
        for f, w in zip(first, whole, strict=True):
            self._tell(int(both[0, f]), int(begin[f]), int(w))

    def results(self) -> list[tuple]:
        """For each text: its words, those in a window of a test, the tests' ids; words, item and place of its longest match."""
        hit = np.concatenate([[0], np.cumsum(np.cumsum(self.cover[:-1]) > 0)]) if self.n else np.zeros(1, int)
        out = []
        for a, b, s, (w, item, place) in zip(self.at[:-1], self.at[1:], self.items, self.best, strict=True):
            out.append((int(b - a), int(hit[b] - hit[a]), sorted(map(str, s)), -w, item if w else None, place if w else None))
        return out


def find_tests(texts: list[str | None], tests, depth: int = DEPTH) -> list[tuple]:
    """Shard.results of texts against blocks of tests."""
    shard = Shard(texts, depth)
    for t in tests:
        shard.search(t)
    return shard.results()


def match_tests(docs: DataFrame, tests: DataFrame, keep: list[str] | None = None, depth: int = DEPTH, block: int = BLOCK) -> DataFrame:
    """Each row of docs with what it holds of the tests. keep: columns that are carried along (default: doc_id)."""
    keep = keep or ["doc_id"]
    paths = write_tests(tests, depth, block=block)
    kept = [f"kept_{k}" for k in range(len(keep))]
    held = docs.select(*[F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)], F.col("text").cast("string").alias("body"))
    fields = {f"kept_{k}": docs.schema[c].dataType.simpleString() for k, c in enumerate(keep)}
    schema = ", ".join([f"{k} {t}" for k, t in fields.items()] + ["n_words long", "n_hit long", "n_items long", "items_sha256 string", "contaminated boolean", "longest_match long", "longest_item long", "longest_at long"])
    names = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match", "longest_item", "longest_at"]

    def run(batches):
        load = _Tests(paths)
        held: list[tuple] = []

        def told():
            for t in load:
                for shard, _ in held:
                    shard.search(t)
            for shard, own in held:
                got = shard.results()
                cols = [own.column(own.schema.get_field_index(k)) for k in kept]
                cols += [pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.int64()), pa.array([len(x[2]) for x in got], pa.int64())]
                cols += [pa.array([hashlib.sha256(",".join(x[2]).encode()).hexdigest() for x in got]), pa.array([x[1] > 0 for x in got])]
                cols += [pa.array([x[k] for x in got], pa.int64()) for k in (3, 4, 5)]
                yield pa.RecordBatch.from_arrays(cols, names=[*kept, *names])
            held.clear()

        for b in batches:
            text = b.column(b.schema.get_field_index("body"))
            at = 0
            for part in chunked((x.as_py() for x in text), lambda t: len(t or "") + 100, SHARD):
                held.append((Shard(part, depth), b.slice(at, len(part))))
                at += len(part)
                if len(held) >= (AHEAD if len(paths) > 1 else 1):
                    yield from told()
        if held:
            yield from told()

    done = held.mapInArrow(run, schema)
    return done.select(*[F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)], *names)


def longest_matches(docs: DataFrame, tests: DataFrame, depth: int = DEPTH, block: int = BLOCK) -> DataFrame:
    """For each item of ``tests(item_id, text)`` that shares a word with ``docs(doc_id, text)``: item_id, item_at (the first
    word of the match in the item), n_words, doc_id, doc_at. The longest; then smaller item_at, doc_id, doc_at.

    Documents without an id are passed over. An item beyond BLOCK words lies in several blocks; a match is followed within one."""
    paths = write_tests(tests, depth, False, block)
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    names = ["item_id", "n_words", "item_at", "doc_id", "doc_at"]

    def run(batches):
        load = _Tests(paths)
        for part in chunked(rows(batches, "doc_id", "text"), lambda r: len(r[1] or "") + 100, SHARD):
            part.sort(key=lambda r: r[0])
            shard = Shard([t for _, t in part], depth)
            if not shard.n:
                continue
            best: dict[int, tuple] = {}
            for t in load:
                sa = SuffixArray(shard.word, shard.end, np.flatnonzero(np.isin(shard.word, t["words"])), depth)
                n, where = sa.longest(t["query"], t["length"])
                row = {(int(i), int(a)): k for k, (i, a) in enumerate(zip(t["item"], t["at"], strict=True))}
                for k in np.flatnonzero(n):
                    i, a, m = int(t["item"][k]), int(t["at"][k]), int(n[k])
                    # of the places that share so many words, the one where the match goes on longest; else the first
                    lo, hi = sa.find(t["query"][k : k + 1], n[k : k + 1])
                    p = np.sort(sa.places[lo[0] : hi[0]])
                    if m == depth:
                        left, m_of = np.arange(len(p)), np.full(len(p), m)
                        while len(left):
                            nxt = row.get((i, a + int(m_of[left[0]]) - depth + 1))
                            if nxt is None or t["length"][nxt] < depth:
                                break
                            at = p[left] + m_of[left[0]]
                            ok = (at < shard.end[p[left]]) & (shard.word[np.minimum(at, shard.n - 1)] == t["query"][nxt, depth - 1])
                            left = left[ok]
                            m_of[left] += 1
                        pick = int(np.argmax(m_of))
                        m, spot = int(m_of[pick]), int(p[pick])
                    else:
                        spot = int(p[0])
                    d = int(shard.doc_of[spot])
                    found = (-m, a, part[d][0], spot - int(shard.at[d]))
                    if i not in best or found < best[i]:
                        best[i] = found
            if best:
                cols = list(zip(*((i, -m, a, d, p) for i, (m, a, d, p) in best.items()), strict=True))
                yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=names)

    found = held.mapInArrow(run, ", ".join(f"{c} long" for c in names))
    least = F.min(F.struct((-F.col("n_words")).alias("minus"), "item_at", "doc_id", "doc_at")).alias("x")
    return found.groupBy("item_id").agg(least).select("item_id", "x.item_at", (-F.col("x.minus")).alias("n_words"), "x.doc_id", "x.doc_at")


def decontaminate(docs: DataFrame, tests: DataFrame) -> DataFrame:
    """The documents that hold no window of any test, with their columns."""
    cols = docs.columns
    tagged = docs.select(F.struct(*[docs[c] for c in cols]).alias("row"), docs["text"])
    clean = match_tests(tagged, tests, ["row"])
    return clean.where(~F.col("contaminated")).select("row.*")


def op8_suffix_array_decontamination(spark, sf_dir):
    docs, tests = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return match_tests(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), tests)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), q AS (
  SELECT item_id, least(10, len(w)) m, unnest(range(1, greatest(2, len(w) - 8))) i, unnest(list_transform(range(1, greatest(2, len(w) - 8)), lambda i: list_aggregate(w[i:i + least(10, len(w)) - 1], 'string_agg', ' '))) win FROM b WHERE len(w) > 0
), m AS (SELECT DISTINCT m FROM q),
g AS (
  SELECT doc_id, m, unnest(range(1, greatest(1, len(w) - m + 2))) pos, w FROM d, m WHERE len(w) >= m
), h AS (
  SELECT DISTINCT g.doc_id, g.pos, g.m, q.item_id, q.i FROM (SELECT doc_id, m, pos, list_aggregate(w[pos:pos + m - 1], 'string_agg', ' ') win FROM g) g JOIN q ON q.win = g.win AND q.m = g.m
), c AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(range(pos, pos + m)) p FROM h) GROUP BY 1),
i AS (SELECT doc_id, count(*) n_items, string_agg(s, ',' ORDER BY s) ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) s FROM h) GROUP BY 1),
o AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, item_id, pos - i ORDER BY pos) island FROM h),
r AS (SELECT doc_id, item_id, min(pos) - 1 place, max(pos + m) - min(pos) n FROM o GROUP BY doc_id, item_id, pos - i, island),
x AS (SELECT doc_id, n, item_id, place FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, item_id, place) = 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(n_hit, 0) AS BIGINT) n_hit, CAST(coalesce(n_items, 0) AS BIGINT) n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated,
  CAST(coalesce(x.n, 0) AS BIGINT) longest_match, x.item_id longest_item, CAST(x.place AS BIGINT) longest_at
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id) LEFT JOIN x USING (doc_id)
"""
