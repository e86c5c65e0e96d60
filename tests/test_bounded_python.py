"""What Python workers hold doesn't grow with the groups or the queries of a table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from siltstone.operators import metrics, vectors


def test_alerts_are_walked_without_whole_groups(spark):
    checks = spark.range(0, 5000, 1, 3).select(
        F.concat(F.lit("r"), F.col("id") % 3).alias("rule"), F.timestamp_micros(F.col("id") * 7_000_000).cast("timestamp_ntz").alias("ts"), F.col("id").alias("seq"),
        F.when(F.col("id") % 11 != 0, F.pmod(F.xxhash64("id"), F.lit(5)) < 2).alias("firing"), F.lit(60).alias("cooldown_s"),
    )
    want, state = [], {}
    for r in checks.orderBy("seq").collect():
        active, last = state.get(r.rule, (False, None))
        if r.firing and not active and (last is None or (r.ts - last).total_seconds() >= r.cooldown_s):
            state[r.rule] = True, r.ts
            want.append((r.rule, r.ts, "fired"))
        elif not r.firing and active:
            state[r.rule] = False, last
            want.append((r.rule, r.ts, "resolved"))
    got = metrics.alerts(checks)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) > 100
    assert "InPandas" in (plan := got._jdf.queryExecution().executedPlan().toString()) and "FlatMapGroups" not in plan


def test_neighbours_of_many_queries_by_parts(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SCORES", 64)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(40, 4)).repeat(3, axis=0)[rng.permutation(120)]  # each vector three times
    rows = [(i, [float(x) for x in y]) for i, y in enumerate(v)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = vectors.knn_blocks(e, e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 2)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    want = sorted((q, int(i), n + 1) for q in range(120) for n, i in enumerate(np.lexsort((np.arange(120), -s[q]))[:2]))
    assert sorted((r.query_id, r.vec_id, r["rank"]) for r in got.collect()) == want
