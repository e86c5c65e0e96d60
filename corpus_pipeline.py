"""Corpus pipeline: each stage reads what the one before it kept.

STAGES are (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame,
which is written as Parquet and read again for the next. All but the last return the columns of
documents. run() applies them to documents.

* toxicity: documents that the classifier chain finds toxic go.
* line_dedup: later repeated runs of lines of 50 words or more are cut out of the texts; a
  document of which nothing is left goes, since all of it stands in earlier ones.
* near_duplicates: of each group of near-duplicates (five-word shingles, similarity of 0.8 or
  more) the smallest doc_id stays.
* decontamination: documents that hold a window of a benchmark item go.
* packing: the last stage returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm.common import drop_since, mark, written
from siltstone.llm.decontam import decontaminate
from siltstone.llm.linededup import drop_repeated_lines
from siltstone.llm.neardup import drop_near_duplicates
from siltstone.llm.packing import pack
from siltstone.llm.toxicity import reject_toxic
from siltstone.session import reachable


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return reject_toxic(docs, reachable(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    reachable(spark)
    return drop_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    reachable(spark)
    return drop_near_duplicates(docs, shingle=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, reachable(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    reachable(spark)
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

ORACLE_SQL = None  # the classifier and the tokenizer aren't SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        start = mark()
        done = written(stage(spark, docs, sf_dir))
        drop_since(start, done)
        docs = done
    return docs
