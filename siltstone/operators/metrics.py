"""Metrics: windows, percentiles, health, alerts, telemetry and caches kept as tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Alert rules (id, metric, comparison, threshold, severity, cooldown in seconds).
RULES = [
    ("high_cpu_usage", "system.cpu.usage", ">", 80.0, "warning", 300),
    ("high_memory_usage", "system.memory.usage_percent", ">", 85.0, "warning", 300),
    ("low_disk_space", "system.disk.usage_percent", ">", 90.0, "critical", 600),
    ("search_response_time", "search.avg_response_time_ms", ">", 5000.0, "warning", 180),
]


def rank_percentile(values: Column, p: float) -> Column:
    """The value at place floor((n - 1) * p) of the sorted values: no interpolation."""
    s = F.array_sort(values)
    return F.when(F.size(s) > 0, F.element_at(s, (F.floor((F.size(s) - 1) * p) + 1).cast("int"))).otherwise(0.0)


def percentile_of(df: DataFrame, keys: list[str], value: str, p: float, name: str) -> DataFrame:
    """The same percentile for groups of any size: ranks in a sort, not in an array."""
    w = Window.partitionBy(*keys)
    ranked = df.withColumn("_r", F.row_number().over(w.orderBy(value))).withColumn("_n", F.count("*").over(w))
    return ranked.where(F.col("_r") == F.floor((F.col("_n") - 1) * p) + 1).select(*keys, F.col(value).alias(name))


def tumbling(events: DataFrame, length: str, keys: list[str], seconds: int) -> DataFrame:
    """Per window and key: count, mean, p95, rate a second, share of errors. The p95 is found by ranks in a sort, which spills where a window is large."""
    own = events.withColumn("w", F.window(F.col("ts").cast("timestamp"), length))
    part = Window.partitionBy("w", *keys)
    ranked = own.withColumn("_r", F.row_number().over(part.orderBy(F.asc_nulls_last("value")))).withColumn("_n", F.count("value").over(part))
    p95 = F.max(F.when(F.col("_r") == F.floor((F.col("_n") - 1) * 0.95) + 1, F.col("value")))
    a = ranked.groupBy("w", *keys).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), p95.alias("p95"), F.avg((F.col("event_type") == "error").cast("double")).alias("error_share"))
    return a.select(F.col("w.start").cast("timestamp_ntz").alias("start"), *keys, "n", F.round("mean", 9).alias("mean"), "p95", F.round(F.col("n") / seconds, 9).alias("rate"), F.round("error_share", 9).alias("error_share"))


def health(mean_ms: Column, search_success: Column, index_success: Column, files_per_s: Column) -> Column:
    """100 less what slow answers, failures and slow indexing cost."""
    slow = F.when(mean_ms > 1000, 20.0).when(mean_ms > 500, 10.0).otherwise(0.0)
    miss = F.when(search_success < 0.95, (1 - search_success) * 30).otherwise(0.0) + F.when(index_success < 0.95, (1 - index_success) * 20).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - slow - miss - F.when(files_per_s < 1, 15.0).otherwise(0.0)))


def compared(value: Column, op: Column, threshold: Column) -> Column:
    return (
        F.when(op == ">", value > threshold).when(op == ">=", value >= threshold).when(op == "<", value < threshold)
        .when(op == "<=", value <= threshold).when(op == "=", value == threshold).otherwise(value != threshold)
    )


def alert_checks(points: DataFrame, rules: DataFrame) -> DataFrame:
    """Each point against the rules of its metric. Rules are few, but a caller's: Spark looks at their size before it broadcasts them."""
    return points.join(rules, "metric").withColumn("firing", compared(F.col("value"), F.col("op"), F.col("threshold")))


def alerts(checks: DataFrame) -> DataFrame:
    """(rule, ts, action): fired when a rule begins to hold and its cooldown is over, resolved when it ceases.

    A firing sets the clock for later ones, so the points of a rule are walked in order: a task walks them as they come, sorted,
    with the state of one rule. Of points that don't hold only the first after one that does can tell anything; the others stay behind."""
    order = ["rule", F.col("ts").asc_nulls_last(), F.col("seq").asc_nulls_last()]
    w = Window.partitionBy("rule").orderBy(*order[1:])
    rows = checks.select("rule", "ts", "seq", F.coalesce("firing", F.lit(False)).alias("firing"), "cooldown_s").withColumn("before", F.lag("firing", 1, False).over(w))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rule, active, last = None, False, None
        for f in frames:
            out = []
            for r in f.itertuples():
                if r.rule != rule:
                    rule, active, last = r.rule, False, None
                if r.firing and not active and (last is None or (r.ts - last).total_seconds() >= r.cooldown_s):
                    active, last = True, r.ts
                    out.append((r.rule, r.ts, "fired"))
                elif not r.firing and active:
                    active = False
                    out.append((r.rule, r.ts, "resolved"))
            yield pd.DataFrame(out, columns=["rule", "ts", "action"])

    told = rows.where("firing or before").select("rule", "ts", "seq", "firing", "cooldown_s")
    return told.repartition("rule").sortWithinPartitions(*order).mapInPandas(run, "rule string, ts timestamp_ntz, action string")


def alert_states(commands: DataFrame) -> DataFrame:
    """(alert_id, state, opened, acknowledged) from commands(alert_id, at, kind): what is left once all are applied in the order of ``at``.

    Legal steps: create opens an alert that isn't open, acknowledge marks an open one, resolve closes it; others change nothing.
    Whatever came before, nothing is open after a resolve, so the last resolve, the first create behind it and the first acknowledge
    behind that tell the state. These are sums over rows in any order, so the log may be unordered and repeated, and a busy
    alert is summed up before the shuffle. Rows of null id, place or kind, and of other kinds, are left out."""
    c = commands.where("alert_id is not null and at is not null and kind in ('create', 'acknowledge', 'resolve')").select("alert_id", "at", "kind")
    of = lambda kind, how: how(F.when(F.col("kind") == kind, F.col("at")))
    last = c.groupBy("alert_id").agg(of("resolve", F.max).alias("resolved"), F.max("at").alias("_last"))
    after = c.join(last, "alert_id").where(F.col("resolved").isNull() | (F.col("at") > F.col("resolved")))
    opened = after.groupBy("alert_id").agg(of("create", F.min).alias("opened"))
    marked = after.where("kind = 'acknowledge'").join(opened, "alert_id").where("at > opened").groupBy("alert_id").agg(F.min("at").alias("acknowledged"))
    out = last.join(opened, "alert_id", "left").join(marked, "alert_id", "left")
    state = F.when(F.col("acknowledged").isNotNull(), "acknowledged").when(F.col("opened").isNotNull(), "open").when(F.col("resolved").isNotNull(), "resolved").otherwise("none")
    return out.select("alert_id", state.alias("state"), "opened", "acknowledged")


def anonymised(path: Column) -> Column:
    """Home folders and long numbers out of paths and messages."""
    c = F.regexp_replace(path, r"(/home/|/Users/|C:\\Users\\)[^/\\]+", "$1[USER]")
    return F.regexp_replace(c, r"\d{6,}", "[NUMBER]")


def batches(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """Numbered batches of size rows in order, within each day so that numbering stays parallel."""
    w = Window.partitionBy("day").orderBy(*order)
    return df.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("int"))


def prometheus(points: DataFrame) -> DataFrame:
    """One gauge line for each metric: its last value."""
    last = points.groupBy("metric").agg(F.max_by("value", F.struct("ts", "seq")).alias("value"))
    name = F.regexp_replace("metric", r"[^A-Za-z0-9_]", "_")
    return last.select(F.concat(F.lit("# TYPE "), name, F.lit(" gauge\n"), name, F.lit(" "), F.col("value").cast("string")).alias("line"))


def cache_key(query: Column, filters: Column) -> Column:
    """Key of a cached search: normalised query and sorted filters."""
    parts = F.array_sort(F.transform(F.map_entries(filters), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return F.sha2(F.concat_ws("|", F.lower(F.trim(query)), F.array_join(parts, "&")), 256)


def cache_ttl(base_s: int, hits: Column, score: Column) -> Column:
    """Longer for what is asked often or scores well, shorter for weak results."""
    return F.lit(float(base_s)) * F.when(hits > 10, 1.5).otherwise(1.0) * F.when(score > 0.8, 1.2).when(score < 0.3, 0.5).otherwise(1.0)


def cache_quality(relevance: Column, ms: Column) -> Column:
    return 0.7 * relevance + 0.3 * F.least(F.lit(1.0), 1000 / F.greatest(ms, F.lit(1.0)))


def evicted(models: DataFrame, target: int) -> DataFrame:
    """models(model, bytes, used, last_used) whose running size, unused and longest idle first, is needed to free target."""
    w = Window.orderBy(F.asc("used"), F.asc("last_used"), "model").rowsBetween(Window.unboundedPreceding, -1)  # a row for each model
    return models.withColumn("before", F.coalesce(F.sum("bytes").over(w), F.lit(0))).where(F.col("before") < target).drop("before")
