"""Registry of the engine's queries: how to build each with Spark and its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}
MODULES = ("documents", "texts", "chunks", "search", "vectors", "fusion", "understanding", "ranking", "results", "suggestions", "behaviour", "operations", "security", "media", "streams", "extras", "upkeep")


def query(sql: str | None = None, name: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its name."""

    def add(f):
        QUERIES[name or f.__name__] = Query(f, sql)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load() -> dict[str, Query]:
    for m in MODULES:
        import_module(f"siltstone.plans.{m}")
    return QUERIES
