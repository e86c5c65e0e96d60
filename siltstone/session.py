"""Session helpers."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


def session(name: str = "siltstone", cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the engine's settings; on a cluster the session comes from spark-submit."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(name)
    base = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return reachable(b.getOrCreate())


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def reachable(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package where it is not installed but its folder is shared.

    Also takes smaller Arrow batches where the session has Spark's default: documents are long."""
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, "1024")
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if root not in have.split(":"):
        env["PYTHONPATH"] = f"{root}:{have}".rstrip(":")
    return spark
