"""The metric join against all pairs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import metricjoin


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, cell int, far string")


def clusters(n, dim=8, noise=0.1, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dim))
    return (centres[rng.integers(12, size=n)] + noise * rng.standard_normal((n, dim))) * rng.uniform(0.1, 50, (n, 1))


@pytest.mark.parametrize("t", [0.5, 0.9, 0.99])
def test_all_pairs(spark, monkeypatch, t):
    monkeypatch.setattr(metricjoin, "CHUNK", 20)  # crowded cells are cut
    monkeypatch.setattr(metricjoin, "PIVOTS", 16)
    v = clusters(240)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(300, v[0].tolist()), (301, [1.0, 2.0]), (302, [2.0, 4.1]), (303, None), (304, []), (305, [0.0] * 8), (306, [float("nan")] * 8), (307, [1.0, None]), (None, v[1].tolist()), (308, [float("inf")] * 8)]
    got = {(r.a, r.b): r.cosine for r in metricjoin.cosine_join(table(spark, rows).repartition(3), t).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    want = {(i, j): s[i, j] for i in range(240) for j in range(i + 1, 240) if round(s[i, j], 9) >= t} | {(301, 302): 0.9999}
    assert set(got) == set(want) and all(abs(got[p] - want[p]) < 1e-3 for p in want)
    assert {(r.id, r.rep) for r in metricjoin.classes(table(spark, rows)).where("id <> rep").collect()} == {(300, 0)}
    assert metricjoin.cosine_join(table(spark, rows).limit(0), t).isEmpty()


def test_most_meetings_are_pruned(spark):
    v = clusters(1500, dim=16, noise=0.05)
    df = table(spark, [(i, x.tolist()) for i, x in enumerate(v)])
    pivots = metricjoin._units(df.limit(32).toArrow().column("embedding").combine_chunks())
    placed = df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")).mapInArrow(metricjoin._placed(pivots), "id long, v array<double>, cell int, far array<double>")
    told = {r.cell: r for r in placed.groupBy("cell").agg(F.max(F.element_at("far", F.col("cell") + 1)).alias("radius"), F.count("*").alias("n")).collect()}
    met = metricjoin.candidates(placed, [told[c].radius if c in told else -9.0 for c in range(32)], [told[c].n if c in told else 0 for c in range(32)], 0.3)
    n = {(r.cell, r.home): r.n for r in met.groupBy("cell", "home").agg(F.count("*").alias("n")).collect()}
    compared = sum(n[c, True] * n.get((c, False), 0) for c, home in n if home)
    assert compared < 1500 * 1500 / 5
