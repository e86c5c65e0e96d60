"""leader_clusters doesn't shuffle the texts of a table to join a few hits."""

from __future__ import annotations

from siltstone.plans import results

from .conftest import DATA


def test_texts_arent_shuffled(spark, monkeypatch):
    monkeypatch.setattr(results.R, "greedy_leaders", lambda rows, similar: rows)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = results.leader_clusters(spark, DATA)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and rows.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
