"""Keeping tables up to date: changes between listings, expiry, re-processing, recorded queries, samples, progress."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two listings (path, hash) -> (change, path, from_path): created, modified, renamed or deleted.

    A rename is told where exactly one path with a content went and exactly one with it came; from_path is null
    otherwise. Contents are counted before the shuffle, so one that a third of all files share is no hot group."""
    o, n = old.select("path", F.col("hash").alias("was")), new.select("path", F.col("hash").alias("now"))
    both = o.withColumn("had", F.lit(True)).join(n.withColumn("has", F.lit(True)), "path", "full")
    change = F.when(F.col("had").isNull(), "created").when(F.col("has").isNull(), "deleted").when(~F.col("was").eqNullSafe(F.col("now")), "modified")
    told = both.withColumn("change", change).where("change IS NOT NULL").withColumn("hash", F.coalesce("now", "was"))
    came, went = F.col("change") == "created", F.col("change") == "deleted"
    moved = (
        told.where((came | went) & F.col("hash").isNotNull())
        .groupBy("hash")
        .agg(F.count_if(came).alias("c"), F.count_if(went).alias("w"), F.min(F.when(came, F.col("path"))).alias("path"), F.min(F.when(went, F.col("path"))).alias("from_path"))
        .where("c = 1 AND w = 1")
        .select("path", "from_path")
    )
    ends = moved.select(F.explode(F.array("path", "from_path")).alias("path"))
    rest = told.join(ends, "path", "left_anti").select("change", "path", F.lit(None).cast("string").alias("from_path"))
    return rest.unionByName(moved.select(F.lit("renamed").alias("change"), "path", "from_path"))


def swept(expires: Column, every_s: int) -> Column:
    """Seconds (epoch) of the first periodic sweep that finds an entry expired; expires in microseconds."""
    return F.ceil(expires / (every_s * 1_000_000)) * every_s


def sampled(df: DataFrame, key: str, rate: float) -> DataFrame:
    """A share of the rows by a hash of their key: the same rows on every run and on every part of the table."""
    bits = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 7), 16, 10).cast("long")
    return df.where(bits < int(rate * (1 << 28)))


def prefix_similarity(a: Column, b: Column) -> Column:
    """Share of the characters of two hashes before the first that differs."""
    x, y = F.split(a, ""), F.split(b, "")
    differs = F.array_position(F.zip_with(x, y, lambda p, q: ~p.eqNullSafe(q)), True)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(differs == 0, longest).otherwise(differs - 1) / longest


def reprocessed(docs: DataFrame, key: str, hook: Callable[[pd.Series], pd.Series], least: int = 1) -> DataFrame:
    """docs(key, text) + reprocessed: texts below ``least`` characters (null: none) come anew from a hook such as OCR or speech.

    The hook gets the keys of a batch and runs on the executors; only rows that need it go through Python."""
    short = F.coalesce(F.length(F.trim("text")), F.lit(0)) < least
    done = docs.where(~short).withColumn("reprocessed", F.lit(False))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["text"] = hook(f[key])
            f["reprocessed"] = True
            yield f

    todo = docs.where(short)
    return done.unionByName(todo.withColumn("reprocessed", F.lit(True)).mapInPandas(run, done.schema))


def recorded(counts: DataFrame, asked: DataFrame) -> DataFrame:
    """The query log after new queries: counts(query, n, selected, last) and asked(query, selected boolean, ts)."""
    new = asked.groupBy("query").agg(F.count("*").alias("n"), F.count_if("selected").alias("selected"), F.max("ts").alias("last"))
    return counts.select(new.columns).unionByName(new).groupBy("query").agg(F.sum("n").alias("n"), F.sum("selected").alias("selected"), F.max("last").alias("last"))


def dictionary_words(texts: Column) -> Column:
    """Words for a user dictionary: lower case, without signs at their ends, of three bytes or more."""
    bare = F.transform(F.split(texts, r"\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return F.transform(F.filter(bare, lambda w: F.octet_length(w) >= 3), F.lower)


def reset(spark: SparkSession, path: str) -> None:
    """A table without its rows; its columns stay."""
    schema = spark.read.parquet(path).schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def progress(df: DataFrame, name: str = "progress", **measures: Column) -> tuple[DataFrame, Observation]:
    """The same rows, and an observation that holds their count and other measures once a job has run over them."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in measures.items()]), seen
