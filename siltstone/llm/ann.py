"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are divided by the largest norm and given one more component that makes their norm 1;
queries are normalised. Then the largest inner product is the least distance, and hashes
floor((a.x + b) / W) with Gaussian a are more often equal the nearer two vectors are. ``TABLES``
tables take ``k`` such hashes each as their bucket; k grows with the logarithm of the number of
vectors, so that a bucket holds about ``bucket`` of them however many there are. Vectors of
different lengths have no inner product: each length is hashed and searched by itself.

The index is written once: buckets are dealt over units of about ``UNIT`` bytes, each a file in
the shared folder; buckets beyond ``HOT`` vectors are cut by a hash of the identifier into several units.
Queries travel to the units of the buckets that they visit, twice:

1. The ``FIRST`` likeliest buckets of each table give a first list; the distance of its top-th vector
   bounds the distance that has to be searched.
2. For that distance buckets are visited in order of the probability that a neighbour lies
   there (the product of normal probabilities of the steps of each hash, as many steps away as need be)
   until their sum reaches ``REACH`` in each table.

Candidates are scored by inner products in double precision of the vectors as given; a query's
best are merged over units and both rounds. Every vector is in every table; nothing is sampled.
A length with so few vectors that k is 0 has one bucket, so it is searched exactly.

Defined results: vectors that are null, zero, or hold a null or non-finite component take no part, nor
do null identifiers; a vector is known by its identifier: rows that share the query's are not
its candidates, repeated candidates count once, with their best score, and of several vectors
under a query's identifier the least (component by component) is asked for; ties go to the smaller vec_id;
a query whose length no vector has, an empty table, or one without queries, gives no rows.
"""

from __future__ import annotations

import io
import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import file_system, rows, shared_dir, width, written
from .texthash import mix

TABLES, W, FIRST, REACH, HOT, BLOCK, UNIT = 8, 1.5, 3, 0.26, 4096, 2048, 8 << 20
BUCKET = 512  # vectors; to visit a bucket costs about as much as to score so many
GAIN = 0.9  # natural logarithm of how much rarer one more hash of width W makes it that two vectors share a bucket
_U = np.uint64


def hashes_for(n: int, bucket: int) -> int:
    """Hashes a table: as many as leave about ``bucket`` of n vectors in a bucket."""
    return max(0, round(math.log(max(n, 1) / bucket) / GAIN))


class Hashes:
    def __init__(self, dim: int, k: int, tables: int = TABLES, w: float = W, seed: int = 7):
        rng = np.random.default_rng([seed, dim])
        self.dim, self.k, self.tables, self.w = dim, k, tables if k else 1, w
        self.a = rng.standard_normal((dim + 1, self.tables * k))
        self.b = rng.uniform(0, w, self.tables * k)

    def _key(self, cell: np.ndarray, table: int) -> np.ndarray:
        key = np.full(cell.shape[:-1], (self.dim << 8) + table + 1, _U)
        for j in range(self.k):
            key = mix(key * _U(0x9E3779B97F4A7C15) + np.ascontiguousarray(cell[..., j], np.int64).view(_U))
        return mix(key).view(np.int64)

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """Rows x tables of bucket keys."""
        cell = np.floor((x @ self.a + self.b) / self.w).astype(np.int64)
        return np.stack([self._key(cell[:, t * self.k : (t + 1) * self.k], t) for t in range(self.tables)], 1)

    def probes(self, q: np.ndarray, distance: np.ndarray, reach: float, limit: int | None = None) -> list[np.ndarray]:
        """For each query the buckets to visit, in order of their probability within each table (the limit likeliest)."""
        place = (q @ self.a + self.b) / self.w
        cell = np.floor(place).astype(np.int64)
        spread = np.maximum(distance / self.w, 1e-6)
        far = math.ceil(5 * float(spread.max())) + 1  # five deviations hold all but a millionth
        edge = _erf((np.arange(-far, far + 2) - (place - cell)[..., None]) / (spread[:, None, None] * math.sqrt(2)))
        p = ((edge[..., 1:] - edge[..., :-1]) / 2).reshape(len(q), self.tables, self.k, 2 * far + 1)  # query x table x hash x step
        cell = cell.reshape(len(q), self.tables, self.k)
        out: list[list[np.ndarray]] = [[] for _ in q]
        for t in range(self.tables):
            for who, steps, n in _likely(p[:, t], reach, limit):
                keys = self._key(cell[who, t][:, None, :] + steps - far, t)
                for i, row, m in zip(who.tolist(), keys, n.tolist(), strict=True):
                    out[i].append(row[:m])
        return [np.concatenate(x) for x in out]


def _likely(p: np.ndarray, reach: float, limit: int | None):
    """Of rows x hashes x steps the combinations of a step for each hash, likeliest first, until their probabilities sum to reach.

    Yields (rows, their combinations, how many of them it takes). Only the likeliest steps and beginnings are followed;
    more of them for rows where these fall short."""
    left, some, most = np.arange(len(p)), 5, 256
    while len(left):
        some, block = min(some, p.shape[2]), max(1, (1 << 21) // (most * some))
        whole = some == p.shape[2]
        short = []
        for at in range(0, len(left), block):
            who = left[at : at + block]
            prob, steps, complete = np.ones((len(who), 1)), np.zeros((len(who), 1, 0), np.int64), whole
            for k in range(p.shape[1]):
                pick = np.argpartition(-p[who, k], some - 1, axis=1)[:, :some]
                both = (prob[:, :, None] * np.take_along_axis(p[who, k], pick, 1)[:, None, :]).reshape(len(who), -1)
                keep = np.broadcast_to(np.arange(both.shape[1]), both.shape)
                if both.shape[1] > most:
                    keep, complete = np.argpartition(-both, most - 1, axis=1)[:, :most], False
                prob = np.take_along_axis(both, keep, 1)
                last = np.take_along_axis(pick, keep % some, 1)
                steps = np.concatenate([np.take_along_axis(steps, (keep // some)[:, :, None], 1), last[:, :, None]], 2)
            order = np.argsort(-prob, axis=1, kind="stable")
            if limit is not None:
                order = order[:, :limit]
            total = np.cumsum(np.take_along_axis(prob, order, 1), 1)
            done = np.full(len(who), limit is not None or complete) | (total[:, -1] >= reach)
            n = np.full(len(who), order.shape[1]) if limit is not None else np.minimum((total < reach).sum(1) + 1, order.shape[1])
            yield who[done], np.take_along_axis(steps, order[:, :, None], 1)[done], n[done]
            short.append(who[~done])
        left, some, most = np.concatenate(short), 2 * some + 1, 8 * most


def _erf(x: np.ndarray) -> np.ndarray:
    """Abramowitz and Stegun 7.1.26; good to 1.5e-7."""
    t = 1 / (1 + 0.3275911 * np.abs(x))
    y = 1 - (((((1.061405429 * t - 1.453152027) * t) + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * np.exp(-x * x)
    return np.sign(x) * y


def _best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, top: int) -> np.ndarray:
    """Places of each query's top distinct candidates, best first."""
    order = np.lexsort((vec, -score, query))
    first = np.unique(np.stack([query[order], vec[order]], 1), axis=0, return_index=True)[1] if len(order) else order
    order = order[np.sort(first)]
    return order[_ranks(query[order]) < top]


def _ranks(q: np.ndarray) -> np.ndarray:
    """For runs of equal numbers, the place of each in its run."""
    start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, int)
    return np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))


def _by_length(batch: pa.RecordBatch, most: int = BLOCK):
    """(length, identifiers, matrix) of the rows of vec_id and x, a few MB at a time."""
    step = max(1, min(most, (8 << 20) * batch.num_rows // max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        x, ids = part.column(part.schema.get_field_index("x")), np.asarray(part.column(part.schema.get_field_index("vec_id")))
        size = np.asarray(pc.list_value_length(x))
        for dim in np.unique(size):
            pick = np.flatnonzero(size == dim)
            yield int(dim), ids[pick], np.asarray(x.take(pa.array(pick)).flatten(), np.float64).reshape(-1, dim)


def _unit_file(held: list[tuple]) -> bytes:
    """Records (key, id, x as bytes) as arrays by key; x of a key lies together in ``flat``."""
    key, ids = np.array([k for k, *_ in held], np.int64), np.array([i for _, i, _ in held], np.int64)
    order = np.lexsort((ids, key))
    own, first = np.unique(key[order], return_index=True)
    flat = np.frombuffer(b"".join(held[k][2] for k in order), "<f8")
    size = np.array([len(held[k][2]) // 8 for k in order], np.int64)
    buf = io.BytesIO()
    np.savez(buf, key=own, first=np.append(first, len(order)), start=np.append(0, np.cumsum(size))[np.append(first, len(order))], id=ids[order], flat=flat)
    return buf.getvalue()


class _Unit:
    def __init__(self, path: str):
        fs, p = file_system(path)
        with fs.open_input_file(p) as f:
            self.a = dict(np.load(io.BytesIO(f.read())))
        self.place = {int(k): n for n, k in enumerate(self.a["key"])}

    def bucket(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.a["first"][n], self.a["first"][n + 1]
        return self.a["id"][a:b], self.a["flat"][self.a["start"][n] : self.a["start"][n + 1]].reshape(b - a, -1)


def _answer(unit: _Unit, block: list[tuple], top: int):
    """(query_id, best as bytes) of a block of (id, keys, vector) that visits a unit."""
    qid = np.array([i for i, *_ in block], np.int64)
    ask: dict[int, list[int]] = {}
    for r, (_, keys, _) in enumerate(block):
        for key in keys:
            if key in unit.place:
                ask.setdefault(unit.place[key], []).append(r)
    got = []
    for n, rs in ask.items():
        own, x = unit.bucket(n)
        rs = np.array(rs)
        q = np.array([block[r][2] for r in rs])
        s = q @ x.T
        s[qid[rs][:, None] == own[None, :]] = -np.inf
        m = min(len(own), top + 8)
        pick = np.argpartition(-s, m - 1, axis=1)[:, :m] if m < len(own) else np.broadcast_to(np.arange(m), s.shape)
        # candidates as good as the last one that was picked may tie: all of them are kept
        last = np.take_along_axis(s, pick, 1).min(1)
        good = s >= last[:, None] - 1e-12
        a, b = np.nonzero(good) if np.count_nonzero(good) > pick.size else (np.repeat(np.arange(len(rs)), m), pick.ravel())
        keep = np.isfinite(s[a, b])
        a, b = a[keep], b[keep]
        exact = (q[a] * x[b]).sum(1)
        best = _best(a, own[b], exact, top)
        got.append((qid[rs[a[best]]], own[b[best]], exact[best]))
    if not got:
        return None
    qs, vs, ss = (np.concatenate(c) for c in zip(*got, strict=True))
    best = _best(qs, vs, ss, top)
    qs, vs, ss = qs[best], vs[best], ss[best]
    if not len(qs):  # a bucket that holds nothing but its query
        return None
    start = np.flatnonzero(_ranks(qs) == 0)
    ends = [*start[1:], len(qs)]
    packed = [vs[a:b].tobytes() + ss[a:b].tobytes() for a, b in zip(start, ends, strict=True)]  # a row for each query
    return pa.record_batch([pa.array(qs[start]), pa.array(packed, pa.binary())], names=["query_id", "best"])


def usable(df: DataFrame) -> DataFrame:
    """vec_id and x of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    ok = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(x, lambda v: v != 0)
    return df.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(ok)


class Index:
    """Buckets of ``vectors(vec_id, embedding)`` in the shared folder: units (unit, path) and cells (key, pieces)."""

    def __init__(self, vectors: DataFrame, bucket: int = BUCKET):
        spark = vectors.sparkSession
        base = usable(vectors)
        norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))
        kinds = base.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n"), F.max(norm).alias("longest")).collect()  # a row for each length
        self.sizes = {r.dim: (hashes_for(r.n, bucket), r.longest) for r in kinds}
        self.parts = width(spark)
        total = sum(r.n * (TABLES if self.sizes[r.dim][0] else 1) * (8 * r.dim + 16) for r in kinds)
        self.n_units = units = max(self.parts, -(-total // UNIT))
        sizes, out = self.sizes, shared_dir(spark)

        def deal(whole):
            def run(batches):
                made: dict[int, Hashes] = {}
                for b in batches:
                    for dim, ids, x in _by_length(b):
                        k, longest = sizes[dim]
                        h = made.get(dim) or made.setdefault(dim, Hashes(dim, k))
                        y = x / longest
                        y = np.concatenate([y, np.sqrt(np.maximum(0, 1 - (y * y).sum(1)))[:, None]], 1)
                        keys = h.buckets(y)
                        cols = [pa.array(keys.ravel())]
                        if whole:
                            cols += [pa.array(np.repeat(ids, h.tables)), pa.array([v for v in map(np.ndarray.tobytes, x) for _ in range(h.tables)], pa.binary())]
                        yield pa.record_batch(cols, names=["key", "id", "x"][: len(cols)])

            return run

        def lay(batches):
            fs, root = file_system(out)
            fs.create_dir(root, recursive=True)

            def put(unit, held):
                path = f"{unit:08d}-{uuid.uuid4().hex}.npz"
                with fs.open_output_stream(f"{root}/{path}") as f:
                    f.write(_unit_file(held))
                return pa.record_batch([pa.array([unit], pa.int64()), pa.array([f"{out}/{path}"])], names=["unit", "path"])

            unit, held = None, []
            for u, key, i, x in rows(batches, "unit", "key", "id", "x"):
                if held and u != unit:
                    yield put(unit, held)
                    held = []
                unit = u
                held.append((key, i, x))
            if held:
                yield put(unit, held)

        counted = base.mapInArrow(deal(False), "key long").groupBy("key").count()
        self.cells = written(counted.select("key", F.ceil(F.col("count") / HOT).cast("int").alias("pieces")))
        laid = base.mapInArrow(deal(True), "key long, id long, x binary").join(self.cells, "key")
        laid = laid.withColumn("piece", F.pmod(F.xxhash64("id"), "pieces").cast("int"))
        laid = laid.select(F.pmod(F.xxhash64("key", "piece"), F.lit(units)).alias("unit"), "key", "id", "x")
        self.units = written(laid.repartition(self.parts, "unit").sortWithinPartitions("unit").mapInArrow(lay, "unit long, path string"))

    def visit(self, asked: DataFrame, top: int, first: bool) -> DataFrame:
        """(query_id, best) of ``asked(vec_id, x, near)`` by unit; near is the inner product that bounds the search."""
        sizes, units = self.sizes, self.n_units

        def probe(batches):
            made: dict[int, Hashes] = {}
            for b in batches:
                near = dict(rows([b], "vec_id", "near"))
                for dim, ids, x in _by_length(b, 128):
                    if dim not in sizes:
                        continue
                    k, longest = sizes[dim]
                    h = made.get(dim) or made.setdefault(dim, Hashes(dim, k))
                    norm = np.linalg.norm(x, axis=1)
                    cos = np.array([near[i] for i in ids.tolist()]) / (norm * longest)
                    q = np.concatenate([x / norm[:, None], np.zeros((len(x), 1))], 1)
                    keys = h.probes(q, np.sqrt(np.maximum(2 - 2 * cos, 1e-4)), REACH, FIRST if first else None)
                    yield pa.record_batch([pa.array(np.concatenate(keys)), pa.array(np.repeat(ids, [len(p) for p in keys]))], names=["key", "id"])

        visits = asked.mapInArrow(probe, "key long, id long").join(self.cells, "key")
        visits = visits.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        visits = visits.select(F.pmod(F.xxhash64("key", "piece"), F.lit(units)).alias("unit"), "id", "key")
        visits = visits.groupBy("unit", "id").agg(F.collect_set("key").alias("keys")).join(self.units, "unit")
        visits = visits.join(asked.select(F.col("vec_id").alias("id"), "x"), "id").select("unit", "path", "id", "keys", "x")

        def score(batches):
            path, unit, held = None, None, []
            for _, p, i, keys, x in rows(batches, "unit", "path", "id", "keys", "x"):
                if held and (p != path or len(held) == BLOCK):
                    if (b := _answer(unit, held, top)) is not None:
                        yield b
                    held = []
                if p != path:
                    path, unit = p, _Unit(p)
                held.append((i, keys, x))
            if held and (b := _answer(unit, held, top)) is not None:
                yield b

        return visits.repartition(self.parts, "unit").sortWithinPartitions("unit").mapInArrow(score, "query_id long, best binary")

    def search(self, queries: DataFrame, top: int = 20) -> DataFrame:
        """For queries of vec_id and embedding: query_id, rank, vec_id, score."""
        asked = written(usable(queries).groupBy("vec_id").agg(F.min("x").alias("x")))

        def merge(batches):
            def best_of(got):
                n = [len(b) // 16 for _, b in got]
                q = np.repeat(np.array([i for i, _ in got], np.int64), n)
                v = np.concatenate([np.frombuffer(b, np.int64, k) for k, (_, b) in zip(n, got, strict=True)])
                s = np.concatenate([np.frombuffer(b, np.float64, k, 8 * k) for k, (_, b) in zip(n, got, strict=True)])
                best = _best(q, v, s, top)
                return pa.record_batch([pa.array(q[best]), pa.array(_ranks(q[best]) + 1, pa.int32()), pa.array(v[best]), pa.array(s[best])], names=["query_id", "rank", "vec_id", "score"])

            held: list[tuple] = []
            for r in rows(batches, "query_id", "best"):
                if len(held) >= 4096 and held[-1][0] != r[0]:
                    yield best_of(held)
                    held = []
                held.append(r)
            if held:
                yield best_of(held)

        def merged(found: DataFrame) -> DataFrame:
            return found.repartition(self.parts, "query_id").sortWithinPartitions("query_id").mapInArrow(merge, "query_id long, rank int, vec_id long, score double")

        some = written(self.visit(asked.withColumn("near", F.lit(0.0)), top, True))
        last = merged(some).where(F.col("rank") == top).select(F.col("query_id").alias("vec_id"), F.col("score").alias("near"))
        bound = written(asked.join(last, "vec_id", "left").select("vec_id", "x", F.coalesce("near", F.lit(0.0)).alias("near")))
        return merged(some.union(self.visit(bound, top, False)))


def nearest(vectors: DataFrame, queries: DataFrame, top: int = 20, bucket: int = BUCKET) -> DataFrame:
    """For ``vectors(vec_id, embedding)`` and queries of the same columns: query_id, rank, vec_id, score."""
    return Index(vectors, bucket).search(queries, top)


def op6_multiprobe_neighbours(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))


#: Exact search. It holds where a length has one bucket only (k is 0: below about 800 vectors).
ORACLE = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
), u AS (SELECT * FROM v WHERE len(list_filter(x, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
p AS (SELECT q.vec_id query_id, u.vec_id, list_inner_product(q.x, u.x) score FROM u q JOIN u ON u.vec_id <> q.vec_id AND len(u.x) = len(q.x) WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) k, vec_id, score FROM p)
SELECT query_id, CAST(k AS INTEGER) rank, vec_id, score FROM r WHERE k <= 20
"""
