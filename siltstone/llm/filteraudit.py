"""Audit of how filters interact: every order of the filters, step by step.

Each text is measured once and becomes a mask of the filters it fails. Rows with the same part, mask and
labels are counted, so that one row a part remains, with 32 mask cells; all orders are then worked out from
the cells. Orders are visited by adjacent transpositions (each differs from the one before it in a swap of
two neighbouring filters), so that only the two swapped steps change, and by one number: the rows that fail
both filters and no earlier one. Shapley sums of what each filter removes are added up along the walk.

The filters (``FILTERS``, in their letters' order), on words ``[^\\x20\\x09-\\x0D]+``: A under 50 words;
B fewer than 65 different words in 100; C more than 5 capitals A-Z in 100 code points; D any of ``#$%&*|``;
E a text that also stands under a smaller doc_id, wherever that is.

Defined results: a null text is empty, a null source is the part ''; a null doc_id is no smaller than
another, none is smaller than it, and it has no labels; rows of one doc_id are rows each, equal texts under one
doc_id are no repeats of each other; a label holds if any row of ``labels`` with the doc_id says 1. A part
appears once it has a row; an empty table gives none. Texts are compared by their SHA-256.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

WORD = r"[^\x20\x09-\x0D]+"
LETTERS = "ABCDE"
MEASURES = ("n", "good", "toxic")
SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, mask): bits 0 to 3 of the mask are filters A to D."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    words = base.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    n, different = F.size("words"), F.size(F.array_distinct("words"))
    capitals, points = F.length(F.regexp_replace("text", "[^A-Z]+", "")), F.length("text")
    fails = (n < 50, different * 100 < n * 65, capitals * 100 > points * 5, F.col("text").rlike(r"[#$%&*|]"))
    return words.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), _bits(fails).alias("mask"))


def _bits(fails: tuple[Column, ...]) -> Column:
    mask = F.lit(0)
    for k, f in enumerate(fails):
        mask = mask + F.when(f, 1 << k).otherwise(0)
    return mask


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a part: n, good and toxic, each an array of 32 counts by mask (bit 4 is filter E)."""
    own = written(text_masks(docs))
    first = own.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("times")).where("times > 1").select("digest", "first")
    say = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *((F.col(c) == 1).cast("int").alias(k) for c, k in (("quality", "good"), ("toxic", "toxic"))))
    say = say.where("doc_id is not null").groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    mask = F.col("mask") + F.when(F.col("doc_id") > F.col("first"), 16).otherwise(0)
    rows = own.join(first, "digest", "left").withColumn("mask", mask).join(say, "doc_id", "left")
    cells = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), *(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in MEASURES[1:]))
    wide = [F.array(*(F.sum(F.when(F.col("mask") == m, F.col(c)).otherwise(0)) for m in range(32))).alias(c) for c in MEASURES]
    return cells.groupBy("part").agg(*wide)


def transpositions(n: int) -> list[int]:
    """Places k such that swapping k and k + 1, one after the other, visits every order of n things."""
    if n < 2:
        return []
    inner, out = transpositions(n - 1), []
    for turn in range(len(inner) + 1):
        out += range(n - 2, -1, -1) if turn % 2 == 0 else range(n - 1)  # the last thing runs through the order of the others
        if turn < len(inner):
            out.append(inner[turn] + (1 if turn % 2 == 0 else 0))  # then two of the others change places
    return out


def walk(cells: np.ndarray) -> dict[str, np.ndarray]:
    """cells[p, measure, mask] -> of every order: letters, and by (part, order, step): kept and the counts of a step; shapley by (part, filter)."""
    parts, n = len(cells), len(LETTERS)
    masks = np.arange(1 << n)

    def cell(before: int, also: int) -> np.ndarray:
        """Sums of the cells that fail all filters of also and none of before."""
        return cells[:, :, (masks & before == 0) & (masks & also == also)].sum(axis=2)

    fails = np.stack([cell(0, 1 << f)[:, 0] for f in range(n)], axis=1)
    unique = cells[:, 0, 1 << np.arange(n)]
    order, gone, before = list(range(n)), np.zeros((parts, n, len(MEASURES)), np.int64), 0
    for i, f in enumerate(order):
        gone[:, i] = cell(before, 1 << f)
        before |= 1 << f
    kept = cells[:, 0].sum(axis=1)[:, None] - np.cumsum(gone[:, :, 0], axis=1)
    shapley = np.zeros((parts, n), np.int64)
    letters, steps = [], []
    swaps = transpositions(n)
    for turn in range(len(swaps) + 1):
        shapley[:, order] += gone[:, :, 0]
        letters.append("".join(LETTERS[f] for f in order))
        steps.append(np.concatenate([kept[:, :, None], gone, fails[:, order, None], unique[:, order, None]], axis=2))
        if turn < len(swaps):
            i = swaps[turn]
            a, b = order[i], order[i + 1]
            both = cell(sum(1 << f for f in order[:i]), 1 << a | 1 << b)  # what the first of the two takes from the second
            gone[:, i], gone[:, i + 1] = gone[:, i + 1] + both, gone[:, i] - both
            kept[:, i] = kept[:, i + 1] + gone[:, i + 1, 0]
            order[i], order[i + 1] = b, a
    return {"letters": np.array(letters), "steps": np.stack(steps, axis=1), "shapley": shapley}


def audited(cells: DataFrame) -> DataFrame:
    """A row for each part, order and step."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                parts = some.column(some.schema.get_field_index("part"))
                counts = [some.column(some.schema.get_field_index(c)).flatten().to_numpy(zero_copy_only=False).reshape(len(parts), -1) for c in MEASURES]
                got = walk(np.stack(counts, axis=1).astype(np.int64))
                letters, steps = got["letters"], got["steps"]
                n, orders, size = len(parts), len(letters), len(LETTERS)
                kept, removed, good, toxic, fails, unique = (steps[..., k].ravel() for k in range(6))
                which = np.array([[LETTERS.index(c) for c in o] for o in letters])
                yield pa.record_batch([
                    parts.take(pa.array(np.repeat(np.arange(n), orders * size))), pa.array(np.tile(np.repeat(letters, size), n), pa.string()),
                    pa.array(np.tile(np.arange(1, size + 1), n * orders), pa.int32()), pa.array(kept), pa.array(removed), pa.array(fails - removed), pa.array(unique),
                    pa.array(good), pa.array(toxic), pa.array(got["shapley"][:, which].ravel()),
                ], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return cells.mapInArrow(run, SCHEMA)


def op11_adjacent_swap_audit(spark, sf_dir):
    return audited(mask_cells(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') part, coalesce(text, '') x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w FROM documents
), y AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) toxic FROM labels GROUP BY 1),
m AS (
  SELECT part, coalesce(good, 0) good, coalesce(toxic, 0) toxic, [
    len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 5 * length(x),
    regexp_matches(x, '[#$%&*|]'), coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY x), false)] f
  FROM t LEFT JOIN y ON y.doc_id = t.doc_id
), l(c) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (
  SELECT a.c || b.c || c.c || d.c || e.c filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5
), s AS (SELECT filter_order, CAST(i AS INTEGER) step, list_transform(range(1, i), lambda j: ascii(filter_order[j]) - 64) before, ascii(filter_order[i]) - 64 own FROM o, range(1, 6) r(i)),
g AS (SELECT part, f, count(*) n, sum(good) good, sum(toxic) toxic FROM m GROUP BY 1, 2),
v AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN NOT late AND NOT f[own] THEN n ELSE 0 END) kept, sum(CASE WHEN NOT late AND f[own] THEN n ELSE 0 END) removed,
    sum(CASE WHEN late AND f[own] THEN n ELSE 0 END) redundant, sum(CASE WHEN f[own] AND len(list_filter(f, lambda b: b)) = 1 THEN n ELSE 0 END) unique_fails,
    sum(CASE WHEN NOT late AND f[own] THEN good ELSE 0 END) good_lost, sum(CASE WHEN NOT late AND f[own] THEN toxic ELSE 0 END) toxic_lost
  FROM (SELECT g.*, s.*, len(list_filter(before, lambda b: f[b])) > 0 late FROM g, s) GROUP BY 1, 2, 3, 4
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) kept, CAST(removed AS BIGINT) removed, CAST(redundant AS BIGINT) redundant, CAST(unique_fails AS BIGINT) unique_fails,
  CAST(good_lost AS BIGINT) good_lost, CAST(toxic_lost AS BIGINT) toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) shapley FROM v
"""
