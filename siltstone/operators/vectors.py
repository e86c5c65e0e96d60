"""Exact vector search, pairwise similarity and vector upkeep."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vector as V

SCORES = 1 << 21  # of queries by vectors that a task works out at once


def knn(vectors: DataFrame, queries: DataFrame, k: int, threshold: float | None = None, exclude_self: bool = False) -> DataFrame:
    """(query_id, vec_id, score, rank) by cosine, for ``queries(query_id, q)``; scores by plan expressions.

    The queries are the stated set; each is held against all vectors where they lie, and only k rows a
    query and partition travel (the window below keeps them by rank-limit pushdown)."""
    pairs = queries.crossJoin(vectors.select("vec_id", "embedding"))
    if exclude_self:
        pairs = pairs.where("query_id <> vec_id")
    s = pairs.select("query_id", "vec_id", V.cosine(F.col("q"), F.col("embedding")).alias("score"))
    if threshold is not None:
        s = s.where(F.col("score") >= threshold)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "vec_id")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _told(s: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(s), -np.inf, s)


def _nearest(s: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores of each row and their ids; of scores alike to nine digits the smaller ids."""
    r = np.round(s, 9)
    row, col = np.nonzero(r >= np.partition(r, -k, axis=1)[:, -k, None])
    order = np.lexsort((ids[row, col], -r[row, col], row))
    row, col = row[order], col[order]
    first = np.searchsorted(row, np.arange(len(s)))
    taken = np.arange(len(row)) - first[row] < k
    row, col = row[taken].reshape(len(s), k), col[taken].reshape(len(s), k)
    return s[row, col], ids[row, col]


def knn_blocks(vectors: DataFrame, queries: DataFrame, k: int, block: int = 1024, max_query_mb: int = 64) -> DataFrame:
    """The same for many queries: numpy products of Arrow batches, k best a query and task, then a merge.

    A task works out at most SCORES scores at once, whatever the number of queries.
    The queries go to the executors in blocks whose size is checked: beyond max_query_mb they are
    cut into several passes, so that what a task holds doesn't grow with them."""
    n, dim = queries.agg(F.count("*"), F.max(F.size("q"))).first()
    out = None
    passes = max(1, -(-n * (dim or 1) * 8 // (max_query_mb << 20)))
    for p in range(passes):
        part = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == p) if passes > 1 else queries
        held = part.select("query_id", "q").toPandas()  # at most max_query_mb
        ids = held["query_id"].to_numpy()
        q = np.array(held["q"].tolist(), np.float64).reshape(len(ids), -1)
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)

        def run(frames: Iterator[pd.DataFrame], ids=ids, q=q) -> Iterator[pd.DataFrame]:
            best, near = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)  # of the task so far; -inf where there is none
            for f in frames:
                if not len(f) or not len(ids):
                    continue
                v = np.array(f["embedding"].tolist(), np.float64)
                length = np.linalg.norm(v, axis=1, keepdims=True)
                v = np.divide(v, length, out=np.zeros_like(v), where=length > 0).T
                own = f["vec_id"].to_numpy()
                step = max(1, SCORES // (len(f) + k))
                for a in range(0, len(ids), step):
                    part = slice(a, a + step)
                    s, at = np.hstack([best[part], _told(q[part] @ v)]), np.hstack([near[part], np.broadcast_to(own, (len(q[part]), len(own)))])
                    best[part], near[part] = _nearest(s, at, k)
            for a in range(0, len(ids), SCORES // k):
                row, col = np.nonzero(best[a : a + SCORES // k] > -np.inf)
                yield pd.DataFrame({"query_id": ids[a + row], "vec_id": near[a + row, col], "score": best[a + row, col]})

        one = vectors.select("vec_id", "embedding").mapInPandas(run, "query_id long, vec_id long, score double")
        out = one if out is None else out.unionByName(one)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def similarity_class(c: Column) -> Column:
    return F.when(c > 0.9, "Duplicate").when(c > 0.7, "VerySimilar").when(c > 0.5, "Similar").otherwise("Related")


def centroids(vectors: DataFrame, group: str) -> DataFrame:
    """Mean vector of each group, as (group, pos, mean) rows that aggregate partially."""
    flat = vectors.select(group, F.posexplode("embedding").alias("pos", "x"))
    return flat.groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def pooled(batch: list[np.ndarray], masks: list[np.ndarray]) -> np.ndarray:
    """Masked mean of token vectors, normalised: what an embedding model's output becomes."""
    out = np.stack([(x * m[:, None]).sum(0) / max(1e-9, float(m.sum())) for x, m in zip(batch, masks, strict=True)])
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embed_texts(docs: DataFrame, embed, batch: int = 32) -> DataFrame:
    """(doc_id, embedding) by embed(list of texts) -> array, loaded once a task and fed batch texts at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), batch):
                part = f.iloc[at : at + batch]
                yield pd.DataFrame({"doc_id": part["doc_id"], "embedding": list(np.asarray(embed(part["text"].fillna("").tolist()), np.float32))})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, embedding array<float>")


def hashed_embedding(texts: list[str], dim: int = 64) -> np.ndarray:
    """A stand-in model: hashed words, normalised."""
    import zlib

    x = np.zeros((len(texts), dim), np.float64)
    for i, t in enumerate(texts):
        for w in t.lower().split():
            h = zlib.crc32(w.encode())
            x[i, h % dim] += 1 if h >> 16 & 1 else -1
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
