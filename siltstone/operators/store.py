"""The document store: keyed tables as DataFrames, changed by anti-joins and unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upsert(old: DataFrame, new: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """Rows of new replace those of old with the same key; the columns in keep stay as they were."""
    was = old.select(key, *[F.col(c).alias(f"was_{c}") for c in keep])
    merged = new.join(was, key, "left").select(*[F.coalesce(f"was_{c}", c).alias(c) if c in keep else F.col(c) for c in old.columns])
    return old.join(new.select(key), key, "left_anti").select(old.columns).unionByName(merged)


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Insert-or-replace: of rows with equal keys the first by order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def without(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Cascade step: df without the rows whose key is in gone."""
    return df.join(gone.select(key).distinct(), key, "left_anti")


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def reindex_decisions(listing: DataFrame, indexed: DataFrame, key: str) -> DataFrame:
    """new, changed (later mtime and another hash) or unchanged for each listed item."""
    had = indexed.select(key, F.col("hash").alias("old_hash"), F.col("indexed_at"))
    return listing.join(had, key, "left").withColumn(
        "decision",
        F.when(F.col("old_hash").isNull(), "new").when((F.col("mtime") > F.col("indexed_at")) & ~F.col("hash").eqNullSafe(F.col("old_hash")), "changed").otherwise("unchanged"),
    )


def size_category(n: Column) -> Column:
    return F.when(n == 0, "empty").when(n <= 1 << 10, "tiny").when(n <= 10 << 10, "small").when(n <= 1 << 20, "medium").when(n <= 100 << 20, "large").otherwise("huge")
