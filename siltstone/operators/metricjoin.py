"""All pairs of vectors with a cosine of t or more, exactly, by pivots and the triangle inequality.

Cosines of t or more are distances of unit vectors of at most e = sqrt(2 - 2t). ``PIVOTS`` vectors of the table (those of the
least hashes of their ids; any would give right results) part it into cells: a vector is at home with its nearest pivot. It meets the
homes of another cell only if two bounds allow it, both by the triangle inequality:

* it is no further from that pivot than the cell's radius and e;
* it is no further from that pivot than from its own and 2e (else a home there would be nearer to this one's pivot).

Each pair is written where the one with the smaller (cell, id) is at home. A cell's homes are cut into chunks of ``CHUNK``, each with
a key of its own, so that a crowded cell is many keys; visitors are copied to each chunk of a cell, and compared in blocks by a matrix
product. Equal vectors are a class, of which the least id is compared.

Defined results: vectors that are null, empty or zero, or hold a null or a number that isn't finite, take no part; those of another
length are compared with their like; repeated ids are one vector (the first by value).
"""

from __future__ import annotations

from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Tables

PIVOTS, CHUNK, ROUND = 64, 2048, 1e-9


def _usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), v.alias("v")).where(F.coalesce(ok, F.lit(False)))


def classes(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, rep): vectors of equal components and the least id of them."""
    one = _usable(vectors, key, vector).groupBy("id").agg(F.min("v").alias("v"))
    return one.join(one.groupBy("v").agg(F.min("id").alias("rep")), "v").select("id", "rep")


def _units(column: pa.Array) -> np.ndarray:
    v = np.array(column.to_pylist(), np.float64)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _placed(pivots: np.ndarray):
    """(id, v) -> (id, v, cell, far): the nearest pivot and the distances to all."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                u = _units(b.column(1))
                far = np.sqrt(np.maximum(0.0, 2 - 2 * u @ pivots.T))
                cell = far.argmin(1)
                yield pa.record_batch([b.column(0), b.column(1), pa.array(cell, pa.int32()), pa.array(list(far), pa.list_(pa.float64()))], names=["id", "v", "cell", "far"])

    return run


def candidates(placed: DataFrame, radii: list[float], homes: list[int], e: float) -> DataFrame:
    """(cell, chunk, home, id, v): each vector at home and wherever it may meet one; cells are few (PIVOTS)."""
    radius, parts = F.array(*map(F.lit, radii)), F.array(*(F.lit(max(1, -(-n // CHUNK))) for n in homes))
    own = F.element_at("far", F.col("cell") + 1)
    goes = F.filter(F.sequence(F.lit(0), F.lit(len(radii) - 1)), lambda c: (F.element_at("far", c + 1) <= F.element_at(radius, c + 1) + e + ROUND) & (F.element_at("far", c + 1) <= own + 2 * e + ROUND) & (c <= F.col("cell")))
    chunk = F.pmod(F.xxhash64("id"), F.element_at(parts, F.col("cell") + 1)).cast("int")
    home = placed.select("cell", chunk.alias("chunk"), F.lit(True).alias("home"), "id", "v")
    visit = placed.select(F.explode(goes).alias("cell"), "id", "v").select("cell", F.explode(F.sequence(F.lit(0), F.element_at(parts, F.col("cell") + 1) - 1)).alias("chunk"), F.lit(False).alias("home"), "id", "v")
    return home.unionByName(visit)


def _compared(t: float):
    def pairs(homes, guests):
        (a, u), (b, w) = homes, guests
        for at in range(0, len(b), 4096):
            s = u @ w[at : at + 4096].T
            i, j = np.nonzero(s >= t - 1e-6)
            if len(i):
                x, y = a[i], b[at + j]
                k = x != y
                yield np.minimum(x, y)[k], np.maximum(x, y)[k]

    def run(batches):
        key, homes, guests = None, [], []

        def flush():
            if homes and guests:
                a, b = ((np.array([i for i, _ in some], np.int64), _units(pa.array([v for _, v in some]))) for some in (homes, guests))
                for x, y in pairs(a, b):
                    yield pa.record_batch([pa.array(x), pa.array(y)], names=["a", "b"])

        for batch in batches:
            for cell, chunk, home, i, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (cell, chunk) != key:
                    yield from flush()
                    key, homes, guests = (cell, chunk), [], []
                (homes if home else guests).append((i, v))
                if len(guests) >= CHUNK:  # homes come first; guests as many as there are
                    yield from flush()
                    guests = []
        yield from flush()

    return run


def cosine_join(vectors: DataFrame, t: float, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(a, b, cosine) with a < b of all pairs of different vectors whose cosine is t or more; of equal vectors the one with the least id (``classes``)."""
    spark = vectors.sparkSession
    e = sqrt(2 - 2 * t)
    with Tables(spark, "metricjoin") as tables:
        one = _usable(vectors, key, vector).groupBy("id").agg(F.min("v").alias("v"))
        reps = tables.write(one.groupBy("v").agg(F.min("id").alias("id")).select("id", "v"))
        found = None
        for (n,) in reps.select(F.size("v")).distinct().collect():  # lengths of vectors: usually one
            some = reps.where(F.size("v") == n)
            pivots = _units(pa.array([r.v for r in some.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).collect()]))
            placed = tables.write(some.mapInArrow(_placed(pivots), "id long, v array<double>, cell int, far array<double>"))
            told = {r.cell: r for r in placed.groupBy("cell").agg(F.max(F.element_at("far", F.col("cell") + 1)).alias("radius"), F.count("*").alias("n")).collect()}
            met = candidates(placed, [told[c].radius if c in told else -9.0 for c in range(len(pivots))], [told[c].n if c in told else 0 for c in range(len(pivots))], e)
            dealt = met.repartition("cell", "chunk").sortWithinPartitions("cell", "chunk", F.desc("home"))
            pairs = tables.write(dealt.mapInArrow(_compared(t), "a long, b long").distinct())
            x, y = (some.select(F.col("id").alias(k), F.col("v").alias(f"v{k}")) for k in "ab")
            dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda i, j: i * j), F.lit(0.0), lambda s, i: s + i)
            exact = dot(F.col("va"), F.col("vb")) / (F.sqrt(dot(F.col("va"), F.col("va"))) * F.sqrt(dot(F.col("vb"), F.col("vb"))))
            out = pairs.join(x, "a").join(y, "b").select("a", "b", exact.alias("cosine")).where(F.round("cosine", 9) >= t)
            found = out if found is None else found.unionByName(out)
        if found is None:
            found = spark.createDataFrame([], "a long, b long, cosine double")
        return tables.release(tables.write(found))
