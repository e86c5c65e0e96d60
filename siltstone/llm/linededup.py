"""Repeated runs of lines, by winnowing over line hashes.

A run of consecutive lines counts from ``min_words`` words on; lines are compared trimmed, and
lines without words are passed over. A window is a shortest run of consecutive lines with that
many words, reaching forwards or backwards from a line.

1. Each window selects its least line hash as fingerprint, so two places that share a run share at least one.
   Fingerprints that stand at one place only are dropped.
2. Positions of shared fingerprints are joined: each with the earliest one (smaller doc_id, then hash of the text,
   then earlier line) whose window around the fingerprint is the same (by two independent 64-bit hashes).
3. Matches are extended both ways: windows that follow one another in the later document and at the same distance
   in the earlier one are one run, which is as long as the lines agree. ``repeated_runs`` returns these.
4. All lines of the later places of a run are deleted.

Sums are pre-aggregated before each shuffle and the joins are left to adaptive execution, so
a line that a third of all documents hold fills no task, and no pairs are written.

Defined results: a null or empty text has nothing to delete; a null doc_id counts as the
smallest; rows with equal doc_id and text are one document (no deletion between them); a text
whose lines all go is empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import chunked, rows, written
from .texthash import BASES, mix, raw_spans, run_hashes, word_table

MIN_WORDS = 50
_U = np.uint64
_INK = word_table(lambda c: not (c == 32 or 9 <= c <= 13))


class Lines:
    """The lines with words of some texts, one after another: text, number in it, words, begin and end of the trimmed line."""

    def __init__(self, texts: list[str | None]):
        parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.buf = buf = np.frombuffer(b"\n" + b"\n".join(parts) + b"\n", np.uint8)
        ink = _INK[buf]
        edge = np.flatnonzero(ink[1:] != ink[:-1]) + 1
        start, end = edge[0::2], edge[1::2]
        breaks = np.flatnonzero(buf == 10)
        line, first, self.words = np.unique(np.searchsorted(breaks, start) - 1, return_index=True, return_counts=True)
        self.begin, self.end = start[first], end[first + self.words - 1]
        at = np.cumsum([0] + [len(p) + 1 for p in parts])  # the line break before each text
        self.text = np.searchsorted(at, self.begin, side="right") - 1
        self.number = line - np.searchsorted(breaks, at)[self.text]
        self.bounds = np.searchsorted(self.text, np.arange(len(texts) + 1))

    def hashes(self, base: int) -> np.ndarray:
        raw = raw_spans(self.buf, self.begin, self.end, base=base)
        return mix(raw + (self.end - self.begin).astype(_U))


def windows(lines: Lines, min_words: int) -> dict[str, np.ndarray]:
    """Of each window: text, place of its fingerprint, the fingerprint, two hashes, first and last place (of lines with words)."""
    names = ("text", "at", "fp", "w1", "w2", "first", "last")
    n = len(lines.words)
    if not n:
        return {k: np.zeros(0, np.int64) for k in names}
    total = np.concatenate([[0], np.cumsum(lines.words)])
    low, high = lines.bounds[lines.text], lines.bounds[lines.text + 1]
    own = np.arange(n)
    j = np.searchsorted(total, total[:-1] + min_words)  # lines own .. j-1
    i = np.searchsorted(total, total[1:] - min_words, side="right") - 1  # lines i .. own
    ahead, back = j <= high, (i >= low) & (total[1:] - total[low] >= min_words)
    spans = np.unique(np.concatenate([np.stack([own[ahead], j[ahead] - 1], 1), np.stack([i[back], own[back]], 1)]), axis=0)
    a, b = spans[:, 0], spans[:, 1]
    if not len(a):
        return {k: np.zeros(0, np.int64) for k in names}
    h1, h2 = lines.hashes(BASES[0]), lines.hashes(BASES[1])
    kinds, rank = np.unique(h1, return_inverse=True)
    least = np.minimum.reduceat(np.append(rank, n), np.stack([a, b + 1], 1).ravel())[::2]
    key = np.sort(rank * (n + 1) + own)
    at = key[np.searchsorted(key, least * (n + 1) + a)] - least * (n + 1)  # the first line of the window with that hash
    text = lines.text[a]
    base = lines.bounds[text]
    signed = [np.ascontiguousarray(x).view(np.int64) for x in (kinds[least], run_hashes(h1, a, b + 1, BASES[1]), run_hashes(h2, a, b + 1, BASES[0]))]
    return dict(zip(names, (text, at - base, *signed, a - base, b - base), strict=True))


_WIN = [("doc_id", pa.int64()), ("th", pa.int64()), ("at", pa.int32()), ("fp", pa.int64()), ("w1", pa.int64()), ("w2", pa.int64()), ("first", pa.int32()), ("last", pa.int32())]


def _windows(min_words: int):
    def run(batches):
        for part in chunked(rows(batches, "doc_id", "th", "text"), lambda r: len(r[2] or "") + 100, 2 << 20):
            w = windows(Lines([t for *_, t in part]), min_words)
            ids, th = pa.array([i for i, *_ in part], pa.int64()), pa.array([h for _, h, _ in part], pa.int64())
            cols = [ids.take(pa.array(w["text"])), th.take(pa.array(w["text"])), *(pa.array(w[n], t) for n, t in _WIN[2:])]
            yield pa.record_batch(cols, names=[n for n, _ in _WIN])

    return run


def remove_lines(text: str | None, number: np.ndarray, spans: list[tuple[int, int]]) -> tuple[str | None, int, int, int]:
    """The text without the lines of the spans (places in ``number``, the lines with words); its lines, those removed, their runs."""
    if not spans:
        return text, len(number), 0, 0
    gone = np.zeros(len(number) + 1, int)
    for a, b in spans:
        gone[a] += 1
        gone[b + 1] -= 1
    gone = np.cumsum(gone)[:-1] > 0
    runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
    drop = set(number[gone].tolist())
    return "\n".join(x for k, x in enumerate((text or "").split("\n")) if k not in drop), len(number), int(gone.sum()), runs


def _runs(docs: DataFrame, min_words: int) -> DataFrame:
    """doc_id, th, first, last of each run that stands earlier too, with source (doc_id, th) and source_first; as extended."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    schema = ", ".join(f"{n} {'long' if t == pa.int64() else 'int'}" for n, t in _WIN)
    wins = written(keyed.select("doc_id", "th", "text").mapInArrow(_windows(min_words), schema))
    place = F.struct("doc_id", "th", "at")
    shared = wins.groupBy("fp").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo <> hi").select("fp")
    shared = written(shared)  # a table, so that adaptive execution can split a hot fingerprint in the join
    near = written(wins.join(shared, "fp", "left_semi").select("doc_id", "th", "w1", "w2", "first", "last"))
    spot = F.struct("doc_id", "th", "first")
    kinds = near.groupBy("w1", "w2").agg(F.min(spot).alias("lo"), F.max(spot).alias("hi")).where("lo <> hi").select("w1", "w2", "lo")
    later = near.join(written(kinds), ["w1", "w2"]).where(spot > F.col("lo"))
    later = later.select("doc_id", "th", "first", "last", F.struct("lo.doc_id", "lo.th").alias("source"), (F.col("first") - F.col("lo.first")).alias("shift")).distinct()
    along = Window.partitionBy("doc_id", "th", "source", "shift").orderBy("first", "last")  # windows of one document
    seen = F.max("last").over(along.rowsBetween(Window.unboundedPreceding, -1))
    islands = later.withColumn("new", F.when(F.col("first") <= seen + 1, 0).otherwise(1)).withColumn("island", F.sum("new").over(along))
    run = islands.groupBy("doc_id", "th", "source", "shift", "island").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return run.select("doc_id", "th", "first", "last", "source", (F.col("first") - F.col("shift")).alias("source_first"))


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Of ``docs(doc_id, text)`` each run that stands earlier too: doc_id, first_line, last_line, source_id, source_line.

    Lines are counted from 0 among the lines with words; the source is the earliest place of the run's windows."""
    found = _runs(docs, min_words)
    return found.select("doc_id", F.col("first").alias("first_line"), F.col("last").alias("last_line"), F.col("source.doc_id").alias("source_id"), F.col("source_first").alias("source_line"))


def _cut(docs: DataFrame, min_words: int) -> DataFrame:
    """own_row (the columns but text), own_text without its later repeated runs, n_lines, n_removed, n_runs."""
    cols = docs.columns
    spans = _runs(docs, min_words).groupBy("doc_id", "th").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    spans = spans.select(F.col("doc_id").alias("span_id"), F.col("th").alias("span_th"), "spans")
    whole = docs.select(F.col("doc_id").cast("long").alias("own_id"), F.col("text").cast("string").alias("own_text"), F.struct(*[docs[c] for c in cols if c != "text"]).alias("own_row")).withColumn("own_th", F.xxhash64("own_text"))
    met = whole.join(spans, F.col("own_id").eqNullSafe(F.col("span_id")) & (F.col("own_th") == F.col("span_th")), "left").select("own_row", "own_text", "spans")
    row_type = met.schema["own_row"].dataType.simpleString()
    names = ["own_row", "own_text", "n_lines", "n_removed", "n_runs"]

    def cut(batches):
        for b in batches:
            row = b.column(b.schema.get_field_index("own_row"))
            at = 0
            for part in chunked(rows([b], "own_text", "spans"), lambda r: len(r[0] or "") + 100, 2 << 20):
                lines = Lines([t for t, _ in part])
                got = [remove_lines(t, lines.number[lo:hi], [(s["first"], s["last"]) for s in x or []]) for (t, x), lo, hi in zip(part, lines.bounds[:-1], lines.bounds[1:], strict=True)]
                t, n, gone, runs = zip(*got, strict=True)
                yield pa.RecordBatch.from_arrays([row.slice(at, len(part)), pa.array(t, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64())], names=names)
                at += len(part)

    return met.mapInArrow(cut, f"own_row {row_type}, own_text string, n_lines long, n_removed long, n_runs long")


def _columns(docs: DataFrame) -> list:
    return [F.col("own_text").alias("text") if c == "text" else F.col("own_row")[c].alias(c) for c in docs.columns]


def deduplicate_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with all its columns, text without its later repeated runs, and struct ``lines(n_lines, n_removed,
    n_runs)``, whose name gets an underscore for each column that has it already."""
    name = "lines"
    while name in docs.columns:
        name += "_"
    return _cut(docs, min_words).select(*_columns(docs), F.struct("n_lines", "n_removed", "n_runs").alias(name))


def drop_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs, columns as they are, text without its later repeated runs; documents of which nothing is left go.

    A numeric column n_chars follows the text where it changed."""
    left = _cut(docs, min_words).where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    cols = _columns(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        own = F.col("own_row")["n_chars"]
        cols[docs.columns.index("n_chars")] = F.when(F.col("n_removed") > 0, F.char_length("own_text").cast(kind)).otherwise(own).alias("n_chars")
    return left.select(*cols)


def op5_winnowed_line_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return deduplicate_lines(docs).select("doc_id", "lines.*", "text")


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(range(1, len(x) + 1)) k, unnest(x) line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) x FROM documents)
), t AS (
  SELECT doc_id, k, line, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') s, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) n FROM l
), w AS (
  SELECT *, row_number() OVER o i, sum(n) OVER (PARTITION BY doc_id ORDER BY k) c FROM t WHERE n > 0 WINDOW o AS (PARTITION BY doc_id ORDER BY k)
), f AS (
  SELECT a.doc_id, a.i a, min(b.i) b FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.c - a.c + a.n >= 50 GROUP BY 1, 2
  UNION
  SELECT a.doc_id, max(b.i), a.i FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.i <= a.i AND a.c - b.c + b.n >= 50 GROUP BY a.doc_id, a.i
), g AS (
  SELECT f.doc_id, f.a, f.b, string_agg(s, chr(10) ORDER BY i) content FROM f JOIN w ON w.doc_id = f.doc_id AND w.i BETWEEN f.a AND f.b GROUP BY 1, 2, 3
), r AS (SELECT doc_id, a, b, row_number() OVER (PARTITION BY content ORDER BY doc_id, a) o FROM g),
x AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) i FROM r WHERE o > 1),
q AS (SELECT doc_id, count(*) n_removed, count(*) FILTER (WHERE p IS NULL OR p < i - 1) n_runs FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) p FROM x) GROUP BY 1),
z AS (SELECT w.doc_id, w.k FROM w JOIN x ON x.doc_id = w.doc_id AND x.i = w.i),
y AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY k) text FROM l ANTI JOIN z USING (doc_id, k) GROUP BY 1),
c AS (SELECT doc_id, count(*) n_lines FROM w GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) n_removed, CAST(coalesce(n_runs, 0) AS BIGINT) n_runs, coalesce(y.text, '') AS text
FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN q USING (doc_id) LEFT JOIN y USING (doc_id)
"""
