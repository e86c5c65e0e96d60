"""Ranking: features, linear model with reasons, and diversity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Weights of the linear model and preferences by type.
WEIGHTS = {"text": 0.4, "vector": 0.3, "recency": 0.15, "quality": 0.1, "frequency": 0.05}
TYPE_PREFERENCE = {"pdf": 0.8, "doc": 0.7, "docx": 0.7, "txt": 0.6, "jpg": 0.5, "png": 0.5, "jpeg": 0.5}
MMR_LIMIT = 50
#: How well types serve an intent: (intent, types, value), and the value for the others.
ALIGNMENT = {
    "DocumentSearch": ([("pdf doc docx txt", 0.95), ("md rtf", 0.85), ("jpg png jpeg", 0.3)], 0.4),
    "QuestionAnswering": ([("pdf doc docx txt md", 0.9), ("rtf", 0.7)], 0.3),
    "SimilaritySearch": ([], 0.8),
    "PersonSearch": ([("msg eml", 0.95), ("pdf doc docx", 0.8)], 0.4),
    "ContentSearch": ([("pdf doc docx txt md", 0.9)], 0.5),
    "TemporalSearch": ([], 0.7),
}


def recency(days: Column) -> Column:
    return F.exp(-days / 30)


def frequency(n: Column) -> Column:
    return F.least(n / 10, F.lit(1.0))


def size_factor(n_bytes: Column) -> Column:
    return F.exp(-F.pow(F.log(n_bytes / (1 << 20) + 1) - 2, F.lit(2)) / 4)


def type_preference(kind: Column, query: Column | None = None) -> Column:
    c = F.lit(0.4)
    for t, v in TYPE_PREFERENCE.items():
        c = F.when(kind == t, v).otherwise(c)
    return c if query is None else F.least(c + F.when(F.contains(F.lower(query), kind), 0.3).otherwise(0.0), F.lit(1.0))


def alignment(intent: Column, kind: Column) -> Column:
    out = F.lit(0.6)
    for name, (rules, other) in ALIGNMENT.items():
        c = F.lit(other)
        for types, v in reversed(rules):
            c = F.when(kind.isin(types.split()), v).otherwise(c)
        out = F.when(intent == name, c).otherwise(out)
    return out


def predicted(weights: dict[str, float] = WEIGHTS) -> Column:
    total = sum((F.col(k) * w for k, w in weights.items()), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def explained(weights: dict[str, float] = WEIGHTS, top: int = 3) -> Column:
    """The features that add most, greatest first."""
    parts = F.array(*[F.struct((-F.col(k) * w).alias("v"), F.lit(k).alias("name")) for k, w in weights.items()])
    return F.transform(F.slice(F.array_sort(parts), 1, top), lambda x: x["name"])


def mmr(hits: DataFrame, trade: float = 0.5, limit: int = MMR_LIMIT) -> DataFrame:
    """hits(query_id, id, relevance, vec, kind) -> + mmr_rank, greedily by relevance against likeness to what is picked.

    At most limit candidates a query go into the greedy step, which is what it is defined on; groups are
    therefore bounded. Likeness: 0.7 of nearness of cosine values and 0.3 for the same kind."""
    w = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "id")
    best = hits.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")

    def pick(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["relevance", "id"], ascending=[False, True], ignore_index=True)
        vec, kind, rel = f["vec"].to_numpy(float), f["kind"].to_numpy(), f["relevance"].to_numpy(float)
        like = 0.7 * (1 - np.abs(vec[:, None] - vec[None, :])) + 0.3 * (kind[:, None] == kind[None, :])
        left, order, most = np.ones(len(f), bool), [], np.full(len(f), -np.inf)
        while left.any():
            score = rel if not order else trade * rel - (1 - trade) * most
            k = int(np.argmax(np.where(left, score, -np.inf)))
            order.append(k)
            left[k] = False
            most = np.maximum(most, like[k])
        f["mmr_rank"] = np.argsort(order) + 1
        return f[["query_id", "id", "relevance", "mmr_rank"]]

    return best.groupBy("query_id").applyInPandas(pick, "query_id long, id long, relevance double, mmr_rank int")


def greedy_leaders(rows: DataFrame, similar, limit: int = 10) -> DataFrame:
    """Leader clustering of rows(query_id, id, tokens): each joins the first leader it is similar to, else leads;
    clusters of one are dropped and at most limit kept. Groups are result lists, bounded by their k."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("id", ignore_index=True)
        leaders: list[int] = []
        own = []
        for i in range(len(f)):
            c = next((n for n, j in enumerate(leaders) if similar(f.loc[j], f.loc[i])), None)
            if c is None:
                leaders.append(i)
                c = len(leaders) - 1
            own.append(c)
        f["cluster"] = own
        sizes = f["cluster"].value_counts()
        f = f[f["cluster"].map(sizes) > 1]
        keep = sorted(f["cluster"].unique())[:limit]
        return f[f["cluster"].isin(keep)][["query_id", "id", "cluster"]].astype({"cluster": "int32"})

    return rows.groupBy("query_id").applyInPandas(run, "query_id long, id long, cluster int")

