"""Sessions, interactions and what is learned from them."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import Tables

#: What an interaction teaches.
SIGNAL = {"click": 0.3, "dwell": 0.6, "open": 0.7, "share": 0.9, "bookmark": 1.0}
DEFAULT_WEIGHTS = {"relevance": 0.5, "recency": 0.2, "frequency": 0.3}


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """events(user_id, ts, ...) -> + session_id: a new session after a gap; ids are user:number."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.lag("ts").over(w).isNull() | (F.col("ts") - F.lag("ts").over(w) > F.expr(f"INTERVAL {gap}"))
    n = F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumn("session_no", n).withColumn("session_id", F.concat_ws(":", "user_id", "session_no"))


def capped_sessions(events: DataFrame, gap_s: int = 1800, cap_s: int = 8 * 3600) -> DataFrame:
    """Sessions that also end cap_s after their start. The cap restarts the clock, so rows of a user are walked in order."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["ts", "event_id"], ignore_index=True)
        t = f["ts"].astype("int64").to_numpy() // 10**6 if str(f["ts"].dtype).startswith("datetime64[us") else f["ts"].astype("datetime64[us]").astype("int64").to_numpy() // 10**6
        out, n, start, last = [], 0, None, None
        for x in t:
            if last is None or x - last > gap_s or x - start > cap_s:
                n, start = n + 1, x
            out.append(n)
            last = x
        f["session_no"] = out
        return f[["event_id", "user_id", "session_no"]].astype({"session_no": "int32"})

    return events.select("event_id", "user_id", "ts").groupBy("user_id").applyInPandas(run, "event_id long, user_id long, session_no int")


def session_metrics(s: DataFrame) -> DataFrame:
    """Per session: events, searches, selections, span and click-through (selections over searches)."""
    a = s.groupBy("user_id", "session_no").agg(
        F.count("*").alias("events"), F.count_if(F.col("event_type") == "view").alias("searches"), F.count_if(F.col("event_type") == "click").alias("selections"),
        F.min("ts").alias("start"), F.max("ts").alias("end"),
    )
    seconds = (F.unix_micros(F.col("end").cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))) / 1_000_000
    ctr = F.when(F.col("searches") > 0, F.col("selections") / F.col("searches")).otherwise(0.0)
    return a.select("user_id", "session_no", "events", "searches", "selections", seconds.alias("seconds"), F.round(ctr, 9).alias("ctr"))


def refinements(queries: DataFrame, key: str, order: str, tokens: Column) -> DataFrame:
    """Likeness to the query before: refined beyond 0.5 (reformulated below 0.95), pivot below, none for the first."""
    from ..functions import text as T

    w = Window.partitionBy(key).orderBy(order)
    t = queries.withColumn("_t", tokens).withColumn("_p", F.lag("_t").over(w))
    s = F.round(T.jaccard(F.array_distinct("_t"), F.array_distinct("_p")), 9)
    kind = F.when(F.col("_p").isNull(), "none").when(s > 0.5, "refine").otherwise("pivot")
    return t.select(key, order, s.alias("similarity"), kind.alias("transition"), ((s > 0.5) & (s < 0.95)).alias("reformulated"))


def transitions(queries: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(from, to, n): queries that follow each other."""
    w = Window.partitionBy(key).orderBy(order)
    return queries.withColumn("from", F.lag(text).over(w)).where(F.col("from").isNotNull()).groupBy("from", F.col(text).alias("to")).agg(F.count("*").alias("n"))


def satisfaction(events: Column) -> Column:
    """A fold over ordered struct(kind, dwell_s): bookmarks and shares lift, long dwell lifts, short dwell lowers; kept in [0, 1]."""

    def step(acc, e):
        v = (
            F.when(e["kind"] == "bookmark", F.greatest(acc, F.lit(0.9)))
            .when(e["kind"] == "share", F.least(F.greatest(acc, F.lit(0.8)) + 0.1, F.lit(1.0)))
            .when(e["dwell_s"] > 120, F.greatest(acc, F.lit(0.8)))
            .when(e["dwell_s"] < 10, F.least(acc, F.lit(0.6)))
            .otherwise(acc)
        )
        return v

    return F.aggregate(events, F.lit(0.7), step)


def signal(kind: Column) -> Column:
    c = F.lit(0.0)
    for k, v in SIGNAL.items():
        c = F.when(kind == k, v).otherwise(c)
    return c


def moving(values: Column, rate: float = 0.1, start: float = 0.5) -> Column:
    """Exponential average over an ordered array of doubles."""
    return F.aggregate(values, F.lit(start), lambda a, v: a * (1 - rate) + v * rate)


NEAR = 0.2  # values nearer than that agree


SIDE = 4096  # users of a block


def _nearest(k: int):
    """Rows (i, j, asks, id, names, values) of two blocks -> (rep, other, s, place): of each that asks the k + 1 nearest others of the block, itself included.

    Memory is bounded by a strip of about a million pairs; a pair costs its shared features."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        a, b = t.filter(t["asks"]), t.filter(pc.invert(t["asks"])).sort_by("id")
        every = pa.chunked_array([*pc.list_flatten(a["names"]).chunks, *pc.list_flatten(b["names"]).chunks], pa.string()).unique()
        parts = []
        for side in (a, b):
            rows, code = pc.list_parent_indices(side["names"]).to_numpy(), pc.index_in(pc.list_flatten(side["names"]), every).to_numpy()
            value = pc.list_flatten(side["values"]).to_numpy()
            parts.append([(rows[at], value[at]) for at in (np.flatnonzero(code == c) for c in range(len(every)))])
        out = [], [], [], []
        step = max(1, (1 << 20) // max(1, len(b)))
        for low in range(0, len(a) if len(b) else 0, step):
            size = (min(step, len(a) - low), len(b))
            total, near, shared = np.zeros(size), np.zeros(size, np.int32), np.zeros(size, np.int32)
            for (ra, va), (rb, vb) in zip(*parts, strict=True):
                first, last = np.searchsorted(ra, (low, low + size[0]))
                at = np.ix_(ra[first:last] - low, rb)
                if (last - first, len(rb)) == size:
                    at = slice(None)  # all hold it: no copies
                d = np.abs(va[first:last, None] - vb[None])
                total[at] += 1 - d
                near[at] += d < NEAR
                shared[at] += 1
            ok = 2 * near > shared
            total /= np.maximum(shared, 1)
            place = np.where(ok, np.floor(total * 1e9 + 0.5), -np.inf)  # as the score is rounded
            if size[1] > k + 1:  # all that can be among the first, those of the last score too
                least = np.partition(place, size[1] - k - 1, axis=1)[:, size[1] - k - 1]
                ok &= place >= least[:, None]
            for r in np.flatnonzero(ok.any(1)):
                c = np.flatnonzero(ok[r])
                c = c[np.argsort(-place[r, c], kind="stable")[: k + 1]]  # b is in order of its ids
                out[0].append(np.full(len(c), low + r))
                out[1].append(c)
                out[2].append(total[r, c])
                out[3].append(place[r, c])
        rep, other, s, place = (np.concatenate(x) if x else np.zeros(0, int) for x in out)
        return pa.table({"rep": a["id"].take(pa.array(rep, pa.int64())), "other": b["id"].take(pa.array(other, pa.int64())), "s": s.astype(float), "place": place.astype(float)})

    return run


def similar_users(features: DataFrame, k: int = 5) -> DataFrame:
    """features(user_id, feature, value) -> (user_id, other, similarity, rank): mean nearness over shared features, if
    over half of them are within NEAR.

    Users of equal features are one class. Of a class the k + 1 least users can be near others only, since they go before the rest of
    it; each class asks those of all classes, by blocks of SIDE rows, and its users share what it found. Every pair of a class and such a
    user is looked at, in tasks of two blocks; only the nearest are written. Rows are one a user and feature."""
    f = features.where("user_id is not null and feature is not null and value is not null").select("user_id", "feature", F.col("value").cast("double").alias("value"))
    kind = f.schema["user_id"].dataType.simpleString()
    with Tables(f.sparkSession, "similarusers") as tables:
        users = tables.write(f.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(F.col("feature").cast("string").alias("feature"), "value"))).alias("own")))
        classes = tables.write(users.groupBy("own").agg(F.min("user_id").alias("id")))
        member = tables.write(users.join(classes.withColumnRenamed("id", "rep"), "own").select("user_id", "rep"))
        order = Window.partitionBy("rep").orderBy("user_id")
        first = member.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).select(F.col("rep"), F.col("user_id").alias("id"))
        others = first.join(classes.withColumnRenamed("id", "rep"), "rep").select("id", "own")
        blocks = max(1, -(-classes.count() // SIDE))
        block, every = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        told = [F.col("id"), F.col("own.feature").alias("names"), F.col("own.value").alias("values")]
        cells = classes.select(block.alias("i"), every.alias("j"), F.lit(True).alias("asks"), *told).union(others.select(every.alias("i"), block.alias("j"), F.lit(False).alias("asks"), *told))
        near = cells.repartition(min(blocks * blocks, 2000), "i", "j").groupBy("i", "j").applyInArrow(_nearest(k), f"rep {kind}, other {kind}, s double, place double")
        best = near.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("place"), "other"))).where(F.col("n") <= k + 1)
        best = tables.write(best)
        own = member.join(best, "rep").where("other <> user_id")
        w = Window.partitionBy("user_id").orderBy("n")
        out = own.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        return tables.release(tables.write(out.select("user_id", "other", F.round("s", 9).alias("similarity"), "rank")))


def drift(values: DataFrame, key: str, order: str, value: str, n: int = 20, least: int = 10) -> DataFrame:
    """Mean of the last n values against the n before, where both have least values."""
    w = Window.partitionBy(key).orderBy(order)
    now, old = w.rowsBetween(-(n - 1), 0), w.rowsBetween(-(2 * n - 1), -n)
    v = F.col(value)
    out = values.select(key, order, F.avg(v).over(now).alias("now"), F.avg(v).over(old).alias("old"), F.count(v).over(now).alias("n_now"), F.count(v).over(old).alias("n_old"))
    return out.where((F.col("n_now") >= least) & (F.col("n_old") >= least)).select(key, order, F.round(F.abs(F.col("now") - F.col("old")), 9).alias("drift"))


def learning_state(n: Column, accuracy: Column) -> Column:
    return F.when(n <= 5, "ColdStart").when(n <= 20, "Bootstrapping").when(accuracy >= 0.8, "Stable").when(accuracy >= 0.6, "Active").otherwise("Degraded")


def adaptations(models: DataFrame, conditions: list[tuple[str, str, str, float]]) -> DataFrame:
    """(user_id, strategy): strategies all of whose conditions (strategy, metric, '<' or '>', threshold) hold for a model's metrics.

    A null metric fulfils no condition; conditions are a stated list and become expressions."""
    need: dict[str, Column] = {}
    for strategy, metric, op, bound in conditions:
        ok = F.col(metric) < bound if op == "<" else F.col(metric) > bound
        need[strategy] = need[strategy] & ok if strategy in need else ok
    apply = F.array_compact(F.array(*[F.when(ok, F.lit(s)) for s, ok in need.items()]))
    return models.select("user_id", F.explode(apply).alias("strategy"))


def due(state: Column, adapted: Column, accuracy: Column) -> Column:
    """Whether a model in this learning state is to be adapted now."""
    return F.when(state.isin("ColdStart", "Degraded"), True).when(state == "Bootstrapping", adapted % 10 == 0).when(state == "Active", accuracy < 0.8).otherwise(False)


def session_suggestions(sessions: DataFrame, goals: DataFrame, areas: DataFrame) -> DataFrame:
    """(session_id, kind, content, relevance) from sessions(session_id, queries), goals(session_id, goal, progress, active) and
    areas(session_id, area, queries, success): unfinished goals, areas of little success, goals to split, goals to set."""
    g = goals.where("active AND progress < 1")
    on = g.select("session_id", F.lit("query").alias("kind"), F.concat(F.lit("continue: "), "goal").alias("content"), (0.8 * (1 - F.col("progress"))).alias("relevance"))
    split = g.where("progress < 0.2").select("session_id", F.lit("refine_goal").alias("kind"), F.concat(F.lit("split: "), "goal").alias("content"), F.lit(0.5).alias("relevance"))
    other = areas.where("queries > 2 AND success < 0.5").select("session_id", F.lit("query").alias("kind"), F.concat(F.lit("other ways: "), "area").alias("content"), F.lit(0.7).alias("relevance"))
    none = sessions.where("queries > 3").join(goals.select("session_id").distinct(), "session_id", "left_anti")
    fresh = none.select("session_id", F.lit("set_goal").alias("kind"), F.lit("set goals").alias("content"), F.lit(0.6).alias("relevance"))
    return on.unionByName(split).unionByName(other).unionByName(fresh)
