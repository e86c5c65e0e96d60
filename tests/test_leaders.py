"""Leader clusters of search results against a plain loop."""

from __future__ import annotations

import re

from siltstone.plans.catalog import load

from .conftest import DATA


def test_leader_clusters(spark):
    q = load()
    lists: dict = {}
    for r in q["bm25_batch"].build(spark, DATA).collect():
        lists.setdefault(r.query_id, []).append(r.doc_id)
    words = {r.doc_id: set(re.findall("[a-z0-9]+", (r.text or "").lower())) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    want = set()
    for query, ids in lists.items():
        clusters: list[list[int]] = []
        for i in sorted(ids):
            own = next((c for c in clusters if len(words[c[0]] & words[i]) > 0.3 * len(words[c[0]] | words[i])), None)
            if own is None:
                clusters.append([i])
            else:
                own.append(i)
        want |= {(query, i, n) for n, c in enumerate(clusters) if len(c) > 1 for i in c}
    assert want and {tuple(r) for r in q["leader_clusters"].build(spark, DATA).collect()} == want
    assert len(lists) > 4
