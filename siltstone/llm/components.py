"""Connected components of an edge table, without collecting anything to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_since, mark, written


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in ``edges(a, b)``; component is the smallest id reachable.

    Each round every id takes the least label of its neighbours and then the label of that
    label; rounds double the reach. Each is written to the shared folder and the one before it deleted. The sums a
    round needs are pre-aggregated, so an id with very many edges fills no task."""
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")
    start = mark()
    both = written(edges.where("a <> b").select(ways).select("e.a", "e.b").distinct())
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("component")))
    while True:
        seen = both.join(labels.select(F.col("id").alias("b"), "component"), "b")
        near = seen.groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "near").alias("c"))
        up = labels.select(F.col("id").alias("c"), F.col("component").alias("up"))
        new = written(step.join(up, "c", "left").select("id", "was", F.least("c", F.coalesce("up", "c")).alias("component")))
        done = new.where("component <> was").isEmpty()
        labels = new.select("id", "component")
        drop_since(start, new, *([] if done else [both]))
        if done:
            return labels
