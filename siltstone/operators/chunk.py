"""Chunking of documents: by sentences (a fold in the plan), by characters, with context and checks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T


@dataclass(frozen=True)
class ChunkOptions:
    max_size: int = 1500
    target: int = 1000
    overlap: float = 0.15
    min_size: int = 100


def overlap_text(c: Column, share: float) -> Column:
    """The last share of a chunk, from its first word start on."""
    n = F.floor(F.length(c) * share).cast("int")
    tail = F.right(c, n)
    at = F.locate(" ", tail)
    return F.when(n < 1, F.lit("")).when(at > 0, F.substring(tail, at + 1, F.length(tail))).otherwise(tail)


def sentence_chunks(docs: DataFrame, o: ChunkOptions | None = None) -> DataFrame:
    """(doc_id, chunk_index, content, word_count, sentence_count, overlap_start, overlap_end).

    The sentences of ``packed``, with measures."""
    out = packed(docs, o).select("doc_id", F.size("parts").alias("n"), F.posexplode("parts").alias("chunk_index", "part")).withColumn("content", F.col("part.content"))
    return out.select(
        "doc_id", "chunk_index", "content",
        T.word_count(F.col("content")).alias("word_count"), T.sentence_count(F.col("content")).alias("sentence_count"),
        (F.col("chunk_index") > 0).alias("overlap_start"), (F.col("chunk_index") < F.col("n") - 1).alias("overlap_end"),
    )


def packed(docs: DataFrame, o: ChunkOptions | None = None) -> DataFrame:
    """(doc_id, parts): the chunks of each text as an array of (content, sentences), the number of sentences they were packed from.

    Texts are folded sentence by sentence: a chunk is closed when the next sentence would carry it beyond max_size,
    and the next begins with its overlap; so texts up to max_size are one chunk.
    The fold is an aggregate over the sentence array, so it needs no shuffle and no Python."""
    o = o or ChunkOptions()
    part = "struct<content:string,sentences:int>"
    kind = f"struct<done:array<{part}>,cur:string,n:int>"
    empty = F.struct(F.array().cast(f"array<{part}>").alias("done"), F.lit("").alias("cur"), F.lit(0).alias("n"))

    def step(acc, s):
        joined = F.when(acc["cur"] == "", s).otherwise(F.concat(acc["cur"], F.lit(" "), s))
        over = (F.length(joined) > o.max_size) & (acc["cur"] != "")
        ahead = overlap_text(acc["cur"], o.overlap)
        fresh = F.when(ahead == "", s).otherwise(F.concat(ahead, F.lit(" "), s))
        return F.struct(F.when(over, closed(acc)).otherwise(acc["done"]).alias("done"), F.when(over, fresh).otherwise(joined).alias("cur"), F.when(over, 1).otherwise(acc["n"] + 1).alias("n")).cast(kind)

    def closed(acc):
        return F.concat(acc["done"], F.array(F.struct(acc["cur"].alias("content"), acc["n"].alias("sentences")).cast(part)))

    sentences = T.sentences(T.folded(F.coalesce("text", F.lit(""))))
    return docs.select("doc_id", F.aggregate(sentences, empty.cast(kind), step, lambda a: F.when(a["cur"] == "", a["done"]).otherwise(closed(a))).alias("parts"))


_BREAKS = (re.compile(r"[.!?](?=\s|$)"), re.compile(r"\n\s*\n"), re.compile(r"\n"), re.compile(r" "))


def cut_characters(text: str, o: ChunkOptions) -> list[tuple[int, int]]:
    """Spans of about target characters, ending at the best break of the last hundred."""
    spans, start, n = [], 0, len(text)
    while start < n:
        end = min(n, start + o.target)
        if end < n:
            low = max(start + 1, end - 100, spans[-1][1] if spans else 0)
            for b in _BREAKS:
                if hits := list(b.finditer(text, low, end)):
                    end = hits[-1].end()
                    break
        spans.append((start, end))
        if end >= n:
            break
        start = max(start + 1, end - int((end - start) * o.overlap))
    return spans


def character_chunks(docs: DataFrame, o: ChunkOptions | None = None) -> DataFrame:
    """(doc_id, chunk_index, start_char, end_char, content); spans need a search backwards, so pandas."""
    o = o or ChunkOptions()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, k, a, b, t[a:b]) for i, t in zip(f.doc_id, f.text, strict=True) if t for k, (a, b) in enumerate(cut_characters(t, o))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "start_char", "end_char", "content"])

    folded = docs.select("doc_id", T.folded(F.col("text")).alias("text"))
    return folded.mapInPandas(run, "doc_id long, chunk_index int, start_char int, end_char int, content string")


def with_context(chunks: DataFrame, k: int, content: str = "content") -> DataFrame:
    """Each chunk with its k neighbours on both sides, joined by spaces."""
    w = Window.partitionBy("doc_id").orderBy("chunk_index").rowsBetween(-k, k)
    return chunks.withColumn("context", F.concat_ws(" ", F.collect_list(content).over(w)))


def merged(chunks: DataFrame) -> DataFrame:
    """The chunks of a document joined in order."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", "content")))
    return chunks.groupBy("doc_id").agg(F.concat_ws(" ", F.transform(ordered, lambda x: x["content"])).alias("content"), F.count("*").alias("n_chunks"))


def validated(chunks: DataFrame, o: ChunkOptions | None = None, strict: bool = False) -> DataFrame:
    """Flag valid: within max_size, and at least min_size where a document has several chunks.

    strict drops all chunks of a document of which one isn't valid."""
    o = o or ChunkOptions()
    w = Window.partitionBy("doc_id")
    n = F.count("*").over(w)
    ok = (F.length("content") <= o.max_size) & ((n == 1) | (F.length("content") >= o.min_size))
    out = chunks.withColumn("valid", ok)
    return out.withColumn("whole", F.bool_and("valid").over(w)).where("whole").drop("whole") if strict else out


def timed_chunks(segments: DataFrame, target: int = 1000, overlap_words: int = 5) -> DataFrame:
    """Transcript segments (media_id, start_ms, end_ms, text) packed to target characters; offsets are times."""
    kind = "struct<done:array<struct<a:bigint,b:bigint,t:string>>,a:bigint,b:bigint,t:string>"
    empty = F.struct(F.array().cast("array<struct<a:bigint,b:bigint,t:string>>").alias("done"), F.lit(None).cast("bigint").alias("a"), F.lit(None).cast("bigint").alias("b"), F.lit("").alias("t"))

    def step(acc, s):
        joined = F.when(acc["t"] == "", s["text"]).otherwise(F.concat(acc["t"], F.lit(" "), s["text"]))
        begin = F.coalesce(acc["a"], s["start_ms"])
        full = F.length(joined) >= target
        tail = F.array_join(F.slice(F.split(joined, " "), -max(1, overlap_words), overlap_words), " ")
        done = F.concat(acc["done"], F.array(F.struct(begin.alias("a"), s["end_ms"].alias("b"), joined.alias("t"))))
        return F.struct(
            F.when(full, done).otherwise(acc["done"]).alias("done"), F.when(full, F.lit(None)).otherwise(begin).alias("a"),
            s["end_ms"].alias("b"), F.when(full, F.when(F.size(F.split(joined, " ")) > overlap_words, tail).otherwise(F.lit(""))).otherwise(joined).alias("t"),
        ).cast(kind)

    ordered = F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "text")))
    last = lambda a: F.when(a["a"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(F.struct(a["a"].alias("a"), a["b"].alias("b"), a["t"].alias("t")))))
    out = segments.groupBy("media_id").agg(ordered.alias("s")).select("media_id", F.posexplode(F.aggregate("s", empty.cast(kind), step, last)).alias("chunk_index", "c"))
    return out.select("media_id", "chunk_index", F.col("c.a").alias("start_ms"), F.col("c.b").alias("end_ms"), F.col("c.t").alias("content"))
