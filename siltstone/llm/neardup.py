"""MinHash near-duplicates with tensored banding.

Two collections of ``T`` small keys are made, each key of ``R`` minhashes. Every pair of a key
of the first and a key of the second collection is a table key, so that T * T tables of
2 * R rows each cost 2 * T * R minhashes instead of 2 * R * T * T. At a similarity of 0.8
two documents share no table key with probability 0.0004; at 0.3 they share one with 0.015, at 0.2 with
0.0006, at 0.03 (unrelated texts) with 2e-10, so that blocks stay small among many documents.

1. Each text gives its set of shingle hashes, a 128-bit signature of the set, and its small keys.
2. Texts with equal sets form a class; its smallest doc_id stands for it.
3. Table keys group representatives. A key's members are first brought together inside each
   task: what is joined there is linked to its least member, and only that one travels on for
   the key, so a key that a third of all documents share sends one record for each task.
4. Connected candidates form blocks. Each block is searched breadth-first on the full sets:
   a document is compared with all that are not yet reached, so no link that joins two
   components is missed and no pairs are written out. Blocks beyond ``LIMIT`` shingles
   are cut into chunks; what isn't yet joined to the block's largest component is then
   compared with every chunk.

Defined results: texts without words have set size 0, link with nothing and are kept; a null
doc_id links with nothing, has a null component and is kept; rows that share a doc_id are one
document; ties don't arise (the smallest id wins). Other columns are left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunked, rows, width, written
from .components import connected_components
from .texthash import SOLID, mix, words

T, R, LIMIT = 16, 4, 1_500_000
_U = np.uint64
_rng = np.random.default_rng(20240229)
_MUL = _rng.integers(0, 1 << 63, 2 * T * R, dtype=np.uint64) * _U(2) + _U(1)
_ADD = _rng.integers(0, 1 << 63, 2 * T * R, dtype=np.uint64)


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's word shingles; a shorter text is one shingle."""
    h, at = words(texts, SOLID, b" ")
    out = []
    if len(h) >= size:
        run = h[: len(h) - size + 1].copy()
        for k in range(1, size):
            run = mix(run * _U(0x9E3779B97F4A7C15) + h[k : len(h) - size + 1 + k])
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(run[a : b - size + 1]))
        elif b > a:
            x = np.array([b - a], _U)
            for k in range(a, b):
                x = mix(x * _U(0xD6E8FEB86659FD93) + h[k : k + 1])
            out.append(x)
        else:
            out.append(np.zeros(0, _U))
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _sketch(size: int):
    names = ["doc_id", "n_shingles", "s1", "s2", "keys"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches):
        for part in chunked(rows(batches, "doc_id", "text"), lambda r: len(r[1] or "") + 200, 1 << 20):
            sets = shingle_sets([t for _, t in part], size)
            n = np.array([len(s) for s in sets])
            full = np.flatnonzero(n)
            s1, s2 = np.zeros(len(part), _U), np.zeros(len(part), _U)
            keys = np.zeros((len(part), 2 * T), _U)
            if len(full):
                x = np.concatenate([sets[k] for k in full])
                at = np.concatenate([[0], np.cumsum(n[full])[:-1]])
                s1[full] = mix(np.add.reduceat(mix(x + _U(1)), at) + n[full].astype(_U))
                s2[full] = mix(np.add.reduceat(mix(x ^ _U(0xA5A5A5A5A5A5A5A5)), at))
                for k in range(2 * T):
                    key = np.full(len(full), k + 1, _U)
                    for r in range(k * R, k * R + R):
                        key = mix(key * _U(0x9E3779B97F4A7C15) + np.minimum.reduceat(x * _MUL[r] + _ADD[r], at))
                    keys[full, k] = key
            ids = [i for i, _ in part]
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(_signed(s1)), pa.array(_signed(s2)), pa.array([k.tobytes() for k in keys], pa.binary())], names=names)

    return run, ", ".join(f"{n} {'binary' if t == pa.binary() else 'long'}" for n, t in zip(names, kinds, strict=True))


def _stars(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of records with equal keys the one with the least doc; and edges from the others to it."""
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    lead = doc[np.flatnonzero(new)][np.cumsum(new) - 1] if len(key) else doc
    other = doc != lead
    edges = np.unique(np.stack([lead[other], doc[other]]), axis=1) if other.any() else np.zeros((2, 0), np.int64)
    return key[new], doc[new], edges[0], edges[1]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of edges and the least id that each is joined to."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        new = root.copy()
        np.minimum.at(new, x, root[y])
        np.minimum.at(new, y, root[x])
        new = new[new]
        if (new == root).all():
            return ids, ids[root]
        root = new


_BLOB = "part int, edge boolean, data binary"


def candidate_edges(reps: DataFrame, parts: int) -> DataFrame:
    """Edges (a, b) between representatives that share a table key, by way of the key's least."""

    def emit(lead_key, lead_doc, a, b):
        # what a task has joined travels as its least member only, with one edge from each other
        ids, root = _forest(a, b)
        if len(ids):
            k = np.minimum(np.searchsorted(ids, lead_doc), len(ids) - 1)
            lead_doc = np.where(ids[k] == lead_doc, root[k], lead_doc)
            a, b = root[root != ids], ids[root != ids]
        where = (lead_key % _U(parts)).astype(np.int64)
        order = np.argsort(where, kind="stable")
        cut = np.searchsorted(where[order], np.arange(parts + 1))
        out = [(p, False, lead_key[o].tobytes() + lead_doc[o].tobytes()) for p in range(parts) if len(o := order[cut[p] : cut[p + 1]])]
        where = mix((a ^ (b << 1)).astype(_U)) % _U(parts)
        out += [(p, True, a[o].tobytes() + b[o].tobytes()) for p in range(parts) if len(o := np.flatnonzero(where == p))] if len(a) else []
        cols = list(zip(*out, strict=True)) or [[], [], []]
        return pa.record_batch([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.bool_()), pa.array(cols[2], pa.binary())], names=["part", "edge", "data"])

    def deal(batches):
        for held in chunked(rows(batches, "doc_id", "keys"), lambda r: 1, 4096):
            doc = np.array([d for d, _ in held], np.int64)
            small = np.frombuffer(b"".join(k for _, k in held), _U).reshape(-1, 2, T)
            pair = mix(small[:, 0, :, None] * _U(0x9E3779B97F4A7C15) + small[:, 1, None, :]).reshape(len(doc), -1)
            yield emit(*_stars(pair.ravel(), np.repeat(doc, T * T)))

    def meet(batches):
        key, doc, ends = {}, {}, []
        for p, edge, data in rows(batches, "part", "edge", "data"):
            half = len(data) // 2
            if edge:
                ends.append(np.frombuffer(data, np.int64).reshape(2, -1))
            else:
                key.setdefault(p, []).append(np.frombuffer(data[:half], _U))
                doc.setdefault(p, []).append(np.frombuffer(data[half:], np.int64))
        for p in list(key):
            _, _, a, b = _stars(np.concatenate(key.pop(p)), np.concatenate(doc.pop(p)))
            ends.append(np.stack([a, b]))
        if ends:
            ids, root = _forest(*np.concatenate(ends, axis=1))
            yield pa.record_batch([pa.array(root[root != ids]), pa.array(ids[root != ids])], names=["a", "b"])

    dealt = reps.select("doc_id", "keys").mapInArrow(deal, _BLOB)
    return dealt.repartition(parts, "part").mapInArrow(meet, "a long, b long").distinct()


def _search(sets: list[np.ndarray], num: int, den: int, first: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links of a spanning forest under den * intersection >= num * union.

    first: only these are compared, each with all (a link may be given twice then)."""
    n = np.array([len(s) for s in sets])
    x = np.unique(np.concatenate(sets), return_inverse=True)[1] if len(sets) else np.zeros(0, int)
    at = np.concatenate([[0], np.cumsum(n)])
    flag = np.zeros(int(x.max()) + 1 if len(x) else 1, np.int32)
    out: list[tuple[int, int]] = []

    def near(u: int, others: np.ndarray) -> np.ndarray:
        others = others[(n[others] * den >= num * n[u]) & (n[u] * den >= num * n[others])]
        if not len(others):
            return others
        flag[x[at[u] : at[u + 1]]] = 1
        ends = np.cumsum(n[others])
        take = np.arange(ends[-1]) + np.repeat(at[others] - (ends - n[others]), n[others])
        both = np.add.reduceat(flag[x[take]], ends - n[others])
        flag[x[at[u] : at[u + 1]]] = 0
        return others[den * both >= num * (n[u] + n[others] - both)]

    if first is not None:
        everyone = np.arange(len(sets))
        for u in first:
            out += [(int(u), int(v)) for v in near(int(u), everyone[everyone != u])]
        return out
    left = np.argsort(n, kind="stable")
    while len(left):
        u, left = int(left[0]), left[1:]
        queue = [u]
        while queue and len(left):
            u = queue.pop()
            got = near(u, left)
            if len(got):
                out += [(u, int(v)) for v in got]
                queue += got.tolist()
                left = left[~np.isin(left, got)]
    return out


def _verify(size: int, num: int, den: int):
    """Rows (block, doc_id, text, s1, s2, mark) sorted by block -> links (a, b)."""

    def run(batches):
        def links(held):
            # a doc_id may stand in several rows; only texts with the set that was keyed count
            sets, ids, marks = [], [], []
            for part in chunked(held, lambda r: len(r[2] or ""), 1 << 20):
                for (_, doc_id, _, s1, s2, mark), s in zip(part, shingle_sets([r[2] for r in part], size), strict=True):
                    if len(s) and (int(_signed(mix(np.add.reduce(mix(s + _U(1)), keepdims=True) + _U(len(s))))[0]), int(_signed(mix(np.add.reduce(mix(s ^ _U(0xA5A5A5A5A5A5A5A5)), keepdims=True)))[0])) == (s1, s2):
                        sets.append(s)
                        ids.append(doc_id)
                        marks.append(mark)
            pick = np.flatnonzero(marks) if any(marks) else None
            got = _search(sets, num, den, pick) if len(sets) > 1 else []
            a = [min(ids[u], ids[v]) for u, v in got]
            b = [max(ids[u], ids[v]) for u, v in got]
            return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        held: list[tuple] = []
        for r in rows(batches, "block", "doc_id", "text", "s1", "s2", "mark"):
            if held and held[0][0] != r[0]:
                yield links(held)
                held = []
            held.append(r)
        if held:
            yield links(held)

    return run


def near_duplicates(docs: DataFrame, shingle: int = 2, num: int = 80, den: int = 100, limit: int = LIMIT) -> DataFrame:
    """For each row of ``docs(doc_id, text)``: doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    parts = width(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    run, schema = _sketch(shingle)
    sketch = written(docs.mapInArrow(run, schema))
    usable = sketch.where("n_shingles > 0 and doc_id is not null")
    classes = usable.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.min(F.struct("doc_id", "n_shingles", "keys")).alias("x"))
    reps = written(classes.select("rep", "s1", "s2", F.col("x.n_shingles").alias("n_shingles"), F.col("x.keys").alias("keys")))
    # rows of one document and equal sets are links of their own
    own = usable.join(reps.select("s1", "s2", "rep"), ["s1", "s2"]).where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))

    blocks = connected_components(candidate_edges(reps.select(F.col("rep").alias("doc_id"), "keys"), parts))
    member = reps.join(blocks, reps["rep"] == blocks["id"]).select(F.col("component").alias("block"), F.col("rep").alias("doc_id"), "s1", "s2", "n_shingles")
    member = written(member)
    sizes = member.groupBy("block").agg(F.sum("n_shingles").alias("total")).select("block", F.ceil(F.col("total") / limit).cast("int").alias("chunks"))
    sizes = written(sizes)
    sized = member.join(sizes, "block")

    def verified(some: DataFrame) -> DataFrame:
        text = some.join(docs.hint("merge"), "doc_id").select("block", "doc_id", "text", "s1", "s2", "mark")
        return text.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(_verify(shingle, num, den), "a long, b long")

    links = verified(sized.where("chunks = 1").withColumn("mark", F.lit(False)))
    large = sized.where("chunks > 1")
    if not large.isEmpty():
        large = written(large.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int")))
        at = F.concat_ws(":", "block", "chunk")
        # each chunk with the block's least document, then what isn't joined to the largest component with every chunk
        least = large.where("doc_id = block").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        inner = written(verified(large.union(least.select(large.columns)).distinct().withColumn("block", at).withColumn("mark", F.lit(False))))
        part = connected_components(inner)
        state = written(large.join(part, large["doc_id"] == part["id"], "left").withColumn("component", F.coalesce("component", "doc_id")).drop("id"))
        most = state.groupBy("block", "component").agg(F.sum("n_shingles").alias("n")).groupBy("block").agg(F.max_by("component", F.struct("n", "component")).alias("most"))
        state = state.join(written(most), "block")
        loose = state.where("component <> most")
        pieces = written(loose.groupBy("block").agg(F.ceil(F.sum("n_shingles") / limit).cast("int").alias("pieces")))
        loose = loose.join(pieces, "block").withColumn("piece", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("pieces")).cast("int"))
        cols = ["block", "doc_id", "s1", "s2", "mark"]
        asked = loose.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("mark", F.lit(True))
        against = state.join(pieces, "block").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).withColumn("mark", F.lit(False))
        key = F.concat_ws(":", "block", "chunk", "piece")
        met = asked.withColumn("block", key).select(cols).union(against.withColumn("block", key).select(cols))
        met = met.groupBy("block", "doc_id", "s1", "s2").agg(F.max("mark").alias("mark"))
        links = links.union(inner).union(written(verified(met)))
    found = connected_components(links.union(own))
    out = sketch.join(found, sketch["doc_id"] == found["id"], "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs, with all columns, without those that have a near-duplicate of smaller doc_id.

    Of rows with equal doc_id and text, one stays."""
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("own_id"), F.xxhash64(docs["text"].cast("string")).alias("own_th"))
    gone = near_duplicates(docs, shingle, num, den).where(~F.col("kept")).select(F.col("doc_id").alias("own_id")).distinct()
    left = keyed.join(gone, "own_id", "left_anti")
    some = left.where("own_id is not null").dropDuplicates(["own_id", "own_th"]).union(left.where("own_id is null"))
    return some.select("row.*")


def op10_tensored_near_duplicates(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END sh FROM d
), n AS (SELECT doc_id, len(sh) n FROM s),
m AS (SELECT list_sort(list(doc_id)) ids, min(doc_id) doc_id, list_sort(sh) sh FROM s WHERE len(sh) > 0 GROUP BY list_sort(sh)),
u AS (SELECT doc_id, unnest(sh) g FROM m),
p AS (
  SELECT a.doc_id x, b.doc_id y, count(*) c FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)
  UNION SELECT doc_id, unnest(ids) FROM m
), e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
k AS (SELECT x doc_id, min(y) c FROM r GROUP BY 1)
SELECT n.doc_id, CAST(n.n AS BIGINT) n_shingles, coalesce(k.c, n.doc_id) component_id, coalesce(k.c, n.doc_id) = n.doc_id kept
FROM n LEFT JOIN k ON k.doc_id = n.doc_id
"""
