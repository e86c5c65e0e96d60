"""The best k documents of each query, without reading blocks that can't hold one.

A block's bound is the sum over the query's terms of what a document with the block's most frequent use and least
length would score. The blocks with the highest bounds are scored first; the k-th best score in them is a threshold that
every result reaches, so that only blocks with at least that bound are read. Of a block all rows of the query's terms are
read or none, hence scores are whole.

Bounds of up to ``PLANNED`` blocks (the dictionary tells how many a term has) are worked out on the driver, from a few
numbers a block that the index remembers; beyond, by jobs, with the same result. There, where queries share terms so that a
row would be joined with more than ``SHARED`` of them, rows are brought together by ``RANGE`` blocks, once
whatever the number of queries that ask them, and of each range the best k of each query go on: with the same result."""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .inverted import BLOCK, PLANNED, SLACK, InvertedIndex
from .lexical import K1, B, top_k

LITERAL_BLOCKS = 500  # up to so many blocks are told to the scan
_ARROW = {"string": pa.string(), "double": pa.float64(), "int": pa.int32()}
RANGE = 16  # blocks that are scored at a time
SHARED = 2
SEED_ROWS = 2000  # rows of postings that are scored on the driver


class TopK:
    def __init__(self, index: InvertedIndex, queries: list[tuple], kind: str, k: int):
        self.index, self.kind, self.k = index, kind, k
        m = index.manifest
        self.mean = m.words / m.docs if m.docs else 1.0
        known = index.statistics({t for _, t in queries}) if m.docs else {}
        self.weights: dict = {}
        for q, t in sorted(set(queries)):
            if t in known:
                df = known[t][0]
                self.weights.setdefault(q, {})[t] = float(np.log((m.docs - df + 0.5) / (df + 0.5) + 1.0)) * (K1 + 1)
        self.terms = sorted({t for w in self.weights.values() for t in w})
        asked = sum(known[t][1] for t in self.terms)
        self.planned = asked <= PLANNED
        self.shared = sum(known[t][1] for w in self.weights.values() for t in w) > SHARED * asked
        rows = [(q, t, w) for q, ws in self.weights.items() for t, w in ws.items()]
        self.asked = F.broadcast(self._table(rows, "term", "string", "weight", "double"))  # a batch of a checked size
        self.some = 4 + 2 * -(-k // BLOCK)  # seeds of a query: twice the blocks that k documents fill and four more

    def _table(self, rows: list[tuple], *kinds: str) -> DataFrame:
        """A small table (query_id, ...) as a part of the plan."""
        names, types = ["query_id", *kinds[0::2]], [self.kind, *kinds[1::2]]
        cols = list(zip(*rows, strict=True)) or [()] * len(names)
        table = pa.table({n: pa.array(c, _ARROW.get(t, pa.int64())) for n, c, t in zip(names, cols, types, strict=True)})
        return self.index.spark.createDataFrame(table).withColumn("query_id", F.col("query_id").cast(self.kind))

    def _gain(self, weight, tf, length):
        return weight * tf / (tf + K1 * (1 - B + B * length / self.mean))

    # -- by jobs

    @cached_property
    def bounds(self) -> DataFrame:
        """(query_id, block, bound) of every block that holds a term of a query."""
        rows = self.index.of_terms(self.index.raw_blocks.select("term", "block", "max_tf", "min_len"), self.terms)
        gain = self._gain(F.col("weight"), F.col("max_tf"), F.col("min_len"))
        return rows.join(self.asked, "term").groupBy("query_id", "block").agg(F.sum(gain).alias("bound"))

    def scored(self, chosen: DataFrame, literal: list[int] | None = None) -> DataFrame:
        """(query_id, doc_id, score) of the documents in chosen (query_id, block)."""
        rows = self._rows(literal).join(self.asked, "term").join(chosen, ["query_id", "block"])
        one = rows.select("query_id", "weight", F.explode(F.arrays_zip("doc_ids", "lens", "tfs")).alias("e"))
        gain = self._gain(F.col("weight"), F.col("e.tfs"), F.col("e.lens"))
        return one.groupBy("query_id", F.col("e.doc_ids").alias("doc_id")).agg(F.sum(gain).alias("score"))

    def _rows(self, literal: list[int] | None) -> DataFrame:
        rows = self.index.of_terms(self.index.blocks, self.terms)
        if literal is not None and len(literal) <= LITERAL_BLOCKS:
            rows = rows.where(f"block IN ({', '.join(map(str, literal)) or 'NULL'})")
        return rows.select("term", "block", "doc_ids", "lens", "tfs")

    def _local(self, pairs: list[tuple]) -> tuple[DataFrame, list[int]]:
        chosen = self._table(pairs, "block", "long")
        return (F.broadcast(chosen) if len(pairs) <= PLANNED else chosen), sorted({b for _, b in pairs})

    def thresholds_by_job(self, seeds: list[tuple]) -> dict:
        w = Window.partitionBy("query_id").orderBy(F.desc("score"))
        last = self.scored(*self._local(seeds)).withColumn("at", F.row_number().over(w)).where(F.col("at") == self.k)
        return {r.query_id: r.score - SLACK for r in last.select("query_id", "score").collect()}

    def survivors_by_job(self) -> DataFrame:
        w = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
        top = self.bounds.withColumn("at", F.row_number().over(w)).where(F.col("at") <= self.some)
        least = self.thresholds_by_job([(r.query_id, r.block) for r in top.select("query_id", "block").collect()])
        told = F.broadcast(self._table(list(least.items()), "least", "double"))  # a row a query
        kept = self.bounds.join(told, "query_id", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least")))
        return kept.select("query_id", "block")

    def best_of_ranges(self) -> DataFrame:
        """(query_id, doc_id, score): the best k of each query in each range of blocks, of all blocks that hold a term."""
        rows = self.index.of_terms(self.index.blocks, self.terms).select(F.floor(F.col("block") / RANGE).alias("range"), "term", "doc_ids", "lens", "tfs")
        kind = f"query_id {self.kind}, doc_id {self.index.manifest.id_type}, score double"
        return rows.groupBy("range").applyInArrow(_best_of_range(self.weights, self.mean, self.k, _ARROW.get(self.kind, pa.int64())), kind)

    # -- on the driver

    @cached_property
    def planned_bounds(self) -> dict:
        """By query: blocks and their bounds."""
        table, out = self.index.block_maxima(self.terms), {}
        for q, ws in self.weights.items():
            blocks = np.concatenate([table[t][0] for t in ws])
            gains = np.concatenate([self._gain(w, table[t][1], table[t][2]) for t, w in ws.items()])
            every, at = np.unique(blocks, return_inverse=True)
            out[q] = every, np.bincount(at, gains)
        return out

    def thresholds(self, seeds: list[tuple]) -> dict:
        """A score that the k-th best of each query reaches at least; queries with fewer than k documents in their seeds have none."""
        if sum(len(self.weights[q]) for q, _ in seeds) > SEED_ROWS:
            return self.thresholds_by_job(seeds)
        of: dict = {}
        for q, b in seeds:
            of.setdefault(b, []).append(q)
        scores: dict = {q: {} for q in self.weights}
        for r in self._rows(sorted(of)).where(f"block IN ({', '.join(map(str, sorted(of))) or 'NULL'})").collect():
            for q in of[r.block]:
                if (w := self.weights[q].get(r.term)) is not None:
                    for doc_id, length, tf in zip(r.doc_ids, r.lens, r.tfs, strict=True):
                        scores[q][doc_id] = scores[q].get(doc_id, 0.0) + self._gain(w, tf, length)
        return {q: sorted(s.values(), reverse=True)[self.k - 1] - SLACK for q, s in scores.items() if len(s) >= self.k}

    def planned_survivors(self) -> list[tuple]:
        seeds = []
        for q, (blocks, bounds) in self.planned_bounds.items():
            seeds += [(q, int(b)) for b in blocks[np.argsort(-bounds, kind="stable")[: self.some]]]
        least = self.thresholds(seeds)
        return [(q, int(b)) for q, (blocks, bounds) in self.planned_bounds.items() for b in blocks[bounds >= least.get(q, -1.0)]]

    def best(self) -> DataFrame:
        if not self.terms:
            return self.index.spark.createDataFrame([], f"query_id {self.kind}, doc_id {self.index.manifest.id_type}, score double, rank int")
        if self.planned:
            found = self.scored(*self._local(self.planned_survivors()))
        else:
            found = self.best_of_ranges() if self.shared else self.scored(self.survivors_by_job())
        return top_k(found, self.k)


def _best_of_range(weights: dict, mean: float, k: int, kind: pa.DataType):
    """Rows (term, doc_ids, lens, tfs) of some whole blocks -> the best k of each query; ties go to the smaller doc_id."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        each = table.column("tfs").combine_chunks()
        ids, length, tf = (table.column(c).combine_chunks().flatten() for c in ("doc_ids", "lens", "tfs"))
        coded = ids.dictionary_encode(null_encoding="encode")
        order = np.empty(len(coded.dictionary), np.int64)
        order[pc.sort_indices(coded.dictionary, null_placement="at_start").to_numpy()] = np.arange(len(order))
        term = table.column("term").combine_chunks().dictionary_encode()
        row = np.repeat(term.indices.to_numpy(), each.value_lengths().to_numpy())
        tf, length = tf.to_numpy().astype(np.float64), length.to_numpy().astype(np.float64)
        gains = np.zeros((len(term.dictionary), len(order)))
        gains[row, coded.indices.to_numpy()] = tf / (tf + K1 * (1 - B + B * length / mean))
        at = {t: i for i, t in enumerate(term.dictionary.to_pylist())}
        queries, best, scores = [], [], []
        for q, ws in weights.items():
            own = sorted((at[t], w) for t, w in ws.items() if t in at)
            if own:
                score = np.array([w for _, w in own]) @ gains[[i for i, _ in own]]
                some = np.flatnonzero(score)
                some = some[np.lexsort((order[some], -np.round(score[some], 9)))[:k]]
                queries += [q] * len(some)
                best.append(some)
                scores.append(score[some])
        found = np.concatenate(best) if best else np.zeros(0, np.int64)
        return pa.table({"query_id": pa.array(queries, kind), "doc_id": coded.dictionary.take(pa.array(found)), "score": pa.array(np.concatenate(scores) if scores else np.zeros(0))})

    return run
