"""Streaming forms: windows, sessions, debouncing, running averages and alerts.

Event time is ts, late rows are dropped after ten minutes, windows are appended once closed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..storage import scratch

LATE = "10 minutes"


def event_stream(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """events as a stream of files; ts becomes a timestamp for watermarks."""
    schema = spark.read.parquet(path).schema
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path[:-1] + f"[{path[-1]}]")
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def drained(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Runs the stream over all that is there into a table and reads it: exactly once by the file sink's log."""
    out = scratch(spark, name)
    df.writeStream.format("parquet").outputMode("append").option("path", f"{out}/table").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/table")


def windowed(s: DataFrame, length: str = "30 seconds", slide: str | None = None) -> DataFrame:
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    g = s.withWatermark("ts", LATE).groupBy(w.alias("w"), "event_type")
    return g.agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("highest")).select(F.col("w.start").alias("start"), "event_type", "n", "mean", "highest")


def sessions(s: DataFrame, gap: str = "30 minutes") -> DataFrame:
    g = s.withWatermark("ts", LATE).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return g.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def debounced(s: DataFrame, keys: list[str], within: str = "10 minutes") -> DataFrame:
    """Leading edge: the first of equal keys within a time."""
    return s.withWatermark("ts", within).dropDuplicatesWithinWatermark(keys)


def last_of_burst(s: DataFrame, key: str, gap: str) -> DataFrame:
    """Trailing edge: the last of each burst."""
    g = s.withWatermark("ts", LATE).groupBy(F.session_window("ts", gap).alias("w"), key)
    return g.agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count("*").alias("n")).select(key, "event_id", "n")


def running_average(s: DataFrame, rate: float = 0.1) -> DataFrame:
    """(user_id, n, average) after each batch; the average of a user is kept as state."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, avg = state.get if state.exists else (0, 0.5)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for v in rows["value"]:
            avg = avg * (1 - rate) + v * rate
            n += 1
        state.update((n, avg))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "average": [avg]})

    return s.groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, average double", "n long, average double", "append", GroupStateTimeout.NoTimeout)
