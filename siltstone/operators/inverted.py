"""A kept inverted index: what lexical and boolean searches read instead of the texts.

An index is a folder of immutable segments and a list of them (a manifest for each generation). Documents of a segment
are numbered in blocks of ``BLOCK``, the short ones first within each run (``RUN`` bytes of words that follow one another
in a task), so that documents of a block have about the same length. A segment holds four Parquet tables:

* ``postings`` (term, block, bits, max_tf, min_len, slots, doc_ids, lens, tfs, places): a row for each block a term is in.
  Rows are made a run at a time where the texts are read and written as they come, each run sorted by (term, block), so
  that neither words nor their places are shuffled or sorted by Spark; a scan reads the pages of its terms in each run. ``bits``
  has a bit for each of the block's documents; max_tf and min_len bound what a document of the block can score. Before each
  run stand rows without a term, which hold its documents (``docs``); no search finds them, and the table of documents is written from them.
* ``terms`` (term, df, blocks) and ``grams`` (gram, term): the dictionary, and the three-letter pieces of ``^term$``.
* ``docs`` (block, slot, doc_id, len, fields): a row for each document, with the other columns that were to be stored.

Deleted documents are tombstones: a table (block, bits) of the generation, taken away from every row that is read. Adding
writes one segment of the new documents only; once ``FAN`` segments are of a size (a power of FAN), they are merged into one
without the deleted. Counts of documents and words are kept in the manifest, so that no search counts the collection.

Defined results: a null text has no words but counts as a document; a null doc_id is a document of its own name, and is
never deleted; an empty table makes an empty index. Rows of one doc_id add up in a search, as in ``lexical.bm25``; where an
index holds such rows nothing is pruned, since bounds are of single rows.
"""

from __future__ import annotations

import hashlib
import json
import math
import uuid
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from .. import storage as shared
from ..functions import text as T
from . import lexical

BLOCK, FAN, FORMAT = 64, 8, 5
RUN = 32 << 20  # bytes of words whose postings are made at a time
ROWS = 4096  # of postings that a task hands over at a time
LITERAL_TERMS = 1000  # up to so many different terms are told to the scan; beyond, the terms are joined
ASKED_ROWS = 20_000  # of a batch of queries that is pruned; larger batches are joined and scored in full
POSTINGS = "term string, block long, bits long, max_tf int, min_len int, slots array<int>, doc_ids array<long>, lens array<int>, tfs array<int>, places array<array<int>>"
PLANNED = 200_000  # rows of block maxima that a search takes to the driver, and that an index remembers
SLACK = 1e-6  # of sums of scores in another order
_KEPT: dict[tuple, InvertedIndex] = {}


@dataclass(frozen=True)
class Segment:
    path: str
    docs: int
    words: int
    first: int  # its blocks
    last: int


@dataclass(frozen=True)
class Manifest:
    format: int
    generation: int
    fields: str  # schema of what is stored of each document besides its id
    id_type: str
    segments: list[Segment] = field(default_factory=list)
    dead: str | None = None  # tombstones
    dead_docs: int = 0
    dead_words: int = 0
    unnamed: int = 0  # documents without an id
    unique: bool = True

    @property
    def docs(self) -> int:
        return sum(s.docs for s in self.segments) - self.dead_docs

    @property
    def words(self) -> int:
        return sum(s.words for s in self.segments) - self.dead_words


class InvertedIndex:
    def __init__(self, spark: SparkSession, folder: str, manifest: Manifest):
        self.spark, self.folder, self.manifest = spark, folder, manifest
        self._known: dict[str, tuple[int, int] | None] = {}
        self._maxima: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    # -- writing ---------------------------------------------------------------------------------------------------

    @classmethod
    def build(cls, docs: DataFrame, folder: str, tokens: Column | None = None, fields: Iterable[str] = ()) -> InvertedIndex:
        """Generation 0 of an index of ``docs(doc_id, text)``; fields are other columns to be stored."""
        stored_type = ST.StructType([docs.schema[c] for c in fields])
        empty = cls(docs.sparkSession, folder, Manifest(FORMAT, -1, stored_type.json(), docs.schema["doc_id"].dataType.simpleString()))
        return empty._published(empty._with(docs, tokens))

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> InvertedIndex | None:
        """The last generation in a folder, whoever wrote it; None where there is none."""
        files = shared.listed(spark, f"{folder}/manifests")
        if not files:
            return None
        told = json.loads(shared.read(spark, max(files)))
        if told["format"] != FORMAT:
            return None
        return cls(spark, folder, Manifest(**told | {"segments": [Segment(**s) for s in told["segments"]]}))

    def _published(self, manifest: Manifest) -> InvertedIndex:
        """Another generation; fails where somebody else has published it first."""
        manifest = replace(manifest, generation=self.manifest.generation + 1)
        shared.create(self.spark, f"{self.folder}/manifests/{manifest.generation:012d}.json", json.dumps(asdict(manifest)))
        return InvertedIndex(self.spark, self.folder, manifest)

    def fork(self, folder: str) -> InvertedIndex:
        """The same documents as the beginning of another index, which shares the segments."""
        return InvertedIndex(self.spark, folder, replace(self.manifest, generation=-1))._published(self.manifest)

    def _with(self, docs: DataFrame, tokens: Column | None = None) -> Manifest:
        """The manifest with a segment of docs."""
        m, path = self.manifest, f"{self.folder}/segments/{uuid.uuid4().hex}"
        base = 1 + max((s.last for s in m.segments), default=-1)
        tokens = T.ascii_tokens(F.coalesce("text", F.lit(""))) if tokens is None else tokens
        names = [f.name for f in ST.StructType.fromJson(json.loads(m.fields))]
        kept = F.struct(*(docs[c] for c in names)) if names else F.lit(None).cast("struct<none:int>")
        rows = docs.select("doc_id", kept.alias("fields"), tokens.alias("tokens")).withColumn("len", F.size("tokens"))
        entry = ST.StructType([ST.StructField("slot", ST.IntegerType()), rows.schema["doc_id"], ST.StructField("len", ST.IntegerType()), rows.schema["fields"]])
        made_of = ST.StructType([*ST._parse_datatype_string(self._postings_type), ST.StructField("docs", ST.ArrayType(entry))])
        rows.select("doc_id", "len", "fields", "tokens").mapInArrow(_runs(base), made_of).write.parquet(f"{path}/postings")
        held = self.spark.read.schema(made_of).parquet(f"{path}/postings").where("term IS NULL")
        held.select("block", F.inline("docs")).write.parquet(f"{path}/docs")
        docs = self.spark.read.parquet(f"{path}/docs")
        n = docs.agg(F.count("*").alias("docs"), F.sum("len").alias("words"), F.countDistinct("doc_id").alias("ids"), F.count("doc_id").alias("named"), F.max("block").alias("last")).first()
        self._write_dictionary(path)
        unnamed = m.unnamed + n.docs - n.named
        made = Segment(path, n.docs, n.words or 0, base, base if n.last is None else n.last)
        return replace(m, segments=[*m.segments, made], unnamed=unnamed, unique=m.unique and n.ids == n.named and unnamed <= 1)

    def _write_dictionary(self, path: str) -> None:
        """The dictionary of the postings; each of its files is sorted."""
        posts = self.spark.read.schema(self._postings_type).parquet(f"{path}/postings").where("term IS NOT NULL")
        posts.groupBy("term").agg(F.sum(F.bit_count("bits")).alias("df"), F.count("*").alias("blocks")).sortWithinPartitions("term").write.parquet(f"{path}/terms")
        terms = self.spark.read.parquet(f"{path}/terms")
        terms.select(F.explode(F.array_distinct(grams(F.col("term")))).alias("gram"), "term").sortWithinPartitions("gram", "term").write.parquet(f"{path}/grams")

    def _without(self, ids: DataFrame) -> Manifest:
        """The manifest with tombstones on the documents of ``ids(doc_id)``."""
        m = self.manifest
        if not m.segments:
            return m
        own = f"{self.folder}/dead/{uuid.uuid4().hex}"
        self.docs.join(ids.select("doc_id").distinct(), "doc_id", "left_semi").select("block", "slot", "len").write.parquet(f"{own}/rows")
        rows = self.spark.read.parquet(f"{own}/rows")
        n = rows.agg(F.count("*").alias("docs"), F.sum("len").alias("words")).first()
        if not n.docs:
            return m
        bits = rows.select("block", _bit("slot").alias("dead"))
        all_bits = bits if m.dead is None else bits.union(self.dead)
        all_bits.groupBy("block").agg(F.bit_or("dead").alias("dead")).write.parquet(f"{own}/bits")
        return replace(m, dead=f"{own}/bits", dead_docs=m.dead_docs + n.docs, dead_words=m.dead_words + n.words)

    def delete(self, ids: DataFrame) -> InvertedIndex:
        """Another generation without the documents of ``ids(doc_id)``."""
        return self._published(self._without(ids))

    def upsert(self, docs: DataFrame, tokens: Column | None = None) -> InvertedIndex:
        """Another generation in which docs stand in place of those of their ids; writes one segment, and merges those of one size."""
        marked = InvertedIndex(self.spark, self.folder, self._without(docs))
        grown = InvertedIndex(self.spark, self.folder, marked._with(docs, tokens))
        return self._published(grown._merged())

    def _merged(self) -> Manifest:
        m = self.manifest
        tiers: dict[int, list[Segment]] = {}
        for s in m.segments:
            tiers.setdefault(int(math.log(max(1, s.docs), FAN)), []).append(s)
        full = [some for some in tiers.values() if len(some) >= FAN]
        for some in full:
            m = InvertedIndex(self.spark, self.folder, m)._merging(some)
        return m

    def merge(self) -> InvertedIndex:
        """Another generation of one segment, without what was deleted."""
        return self._published(self._merging(self.manifest.segments)) if self.manifest.segments else self

    def _merging(self, some: list[Segment]) -> Manifest:
        """The manifest with one segment in place of some; blocks keep their numbers, and the deleted leave them."""
        m, path = self.manifest, f"{self.folder}/segments/{uuid.uuid4().hex}"
        part = InvertedIndex(self.spark, self.folder, replace(m, segments=some))
        part.docs.write.parquet(f"{path}/docs")
        part.blocks.where("term IS NOT NULL").repartitionByRange("term", "block").sortWithinPartitions("term", "block").write.parquet(f"{path}/postings")
        part._write_dictionary(path)
        n = self.spark.read.parquet(f"{path}/docs").agg(F.count("*").alias("docs"), F.sum("len").alias("words")).first()
        gone_docs, gone_words = sum(s.docs for s in some) - n.docs, sum(s.words for s in some) - (n.words or 0)
        dead = m.dead
        if dead is not None:
            inside = F.lit(False)
            for s in some:
                inside = inside | F.col("block").between(s.first, s.last)
            dead = f"{self.folder}/dead/{uuid.uuid4().hex}/bits"
            self.dead.where(~inside).write.parquet(dead)
        made = Segment(path, n.docs, n.words or 0, min(s.first for s in some), max(s.last for s in some))
        left = replace(m, segments=[s for s in m.segments if s not in some] + [made], dead_docs=m.dead_docs - gone_docs, dead_words=m.dead_words - gone_words)
        return replace(left, dead=dead if left.dead_docs else None)

    def vacuum(self) -> None:
        """Deletes the segments, tombstones and manifests that this generation doesn't need; only where no other index shares them."""
        keep = {s.path for s in self.manifest.segments}
        for f in shared.listed(self.spark, f"{self.folder}/segments"):
            if not any(f.endswith(k.rsplit("/", 1)[-1]) for k in keep):
                shared.delete(self.spark, f)
        for f in shared.listed(self.spark, f"{self.folder}/dead"):
            if not (self.manifest.dead and f.rsplit("/", 1)[-1] in self.manifest.dead):
                shared.delete(self.spark, f)
        for f in sorted(shared.listed(self.spark, f"{self.folder}/manifests"))[:-1]:
            shared.delete(self.spark, f)

    # -- tables ----------------------------------------------------------------------------------------------------

    @property
    def _postings_type(self) -> str:
        return POSTINGS.replace("doc_ids array<long>", f"doc_ids array<{self.manifest.id_type}>")

    def _table(self, name: str, schema) -> DataFrame:
        paths = [f"{s.path}/{name}" for s in self.manifest.segments]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    @cached_property
    def dead(self) -> DataFrame:
        """Tombstones (block, dead)."""
        return self.spark.read.schema("block long, dead long").parquet(self.manifest.dead)

    @cached_property
    def raw_blocks(self) -> DataFrame:
        """Rows of the postings, tombstones not heeded; those without a term aren't postings."""
        return self._table("postings", self._postings_type)

    @cached_property
    def blocks(self) -> DataFrame:
        """Rows of the postings without deleted documents. max_tf and min_len stay bounds."""
        rows = self.raw_blocks
        if self.manifest.dead is None:
            return rows
        rows = rows.join(self.dead, "block", "left")
        live = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("dead", F.lit(0).cast("long"))))
        same = F.col("dead").isNull() | (live == F.col("bits"))
        kept = F.filter(F.arrays_zip(*(a for _, a in _ARRAYS)), lambda e: _has(F.col("live"), e["slots"]))
        rows = rows.withColumn("live", live).where("live <> 0").withColumn("same", same).withColumn("e", F.when(~F.col("same"), kept))
        arrays = [F.when(F.col("same"), F.col(a)).otherwise(F.col(f"e.{a}")).alias(a) for _, a in _ARRAYS]
        return rows.select("term", "block", F.col("live").alias("bits"), "max_tf", "min_len", *arrays)

    @cached_property
    def bits(self) -> DataFrame:
        """(term, block, bits) of documents that aren't deleted."""
        rows = self.raw_blocks.select("term", "block", "bits")
        if self.manifest.dead is None:
            return rows
        live = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("dead", F.lit(0).cast("long"))))
        return rows.join(self.dead, "block", "left").select("term", "block", live.alias("bits")).where("bits <> 0")

    @cached_property
    def docs(self) -> DataFrame:
        """(block, slot, doc_id, len, fields) of documents that aren't deleted."""
        names = ST.StructType.fromJson(json.loads(self.manifest.fields))
        kept = names if len(names) else ST.StructType([ST.StructField("none", ST.IntegerType())])
        kind = ST.StructType([ST.StructField(n, t) for n, t in (("block", ST.LongType()), ("slot", ST.IntegerType()), ("doc_id", ST._parse_datatype_string(self.manifest.id_type)), ("len", ST.IntegerType()), ("fields", kept))])
        rows = self._table("docs", kind)
        if self.manifest.dead is None:
            return rows
        gone = rows.join(self.dead, "block", "left").where(F.col("dead").isNull() | ~_has(F.col("dead"), F.col("slot")))
        return gone.select(rows.columns)

    @cached_property
    def postings(self) -> DataFrame:
        """(term, doc_id, len, tf, positions), a row for each document of a term."""
        zipped = self.blocks.select("term", F.explode(F.arrays_zip("doc_ids", "lens", "tfs", "places")).alias("e"))
        return zipped.select("term", F.col("e.doc_ids").alias("doc_id"), F.col("e.lens").alias("len"), F.col("e.tfs").alias("tf"), F.col("e.places").alias("positions"))

    @cached_property
    def dictionary(self) -> DataFrame:
        """(term, df, blocks); of deleted documents too."""
        rows = self._table("terms", "term string, df long, blocks long")
        return rows if len(self.manifest.segments) < 2 else rows.groupBy("term").agg(F.sum("df").alias("df"), F.sum("blocks").alias("blocks"))

    @cached_property
    def terms(self) -> DataFrame:
        """(term, df) without deleted documents, for terms that are left."""
        return self._counted(self.dictionary, self.raw_blocks).drop("blocks")

    def _counted(self, dictionary: DataFrame, rows: DataFrame) -> DataFrame:
        """Only the blocks that hold a deleted document are looked at."""
        if self.manifest.dead is None:
            return dictionary
        gone = rows.select("term", "block", "bits").join(self.dead, "block").groupBy("term").agg(F.sum(F.bit_count(F.col("bits").bitwiseAND(F.col("dead")))).alias("gone"))
        return dictionary.join(gone, "term", "left").select("term", (F.col("df") - F.coalesce("gone", F.lit(0))).alias("df"), "blocks").where("df > 0")

    @cached_property
    def grams(self) -> DataFrame:
        return self._table("grams", "gram string, term string")

    @cached_property
    def corpus(self) -> DataFrame:
        m = self.manifest
        return self.spark.createDataFrame([(m.docs, m.words / m.docs if m.docs else None)], "n long, mean_len double")

    # -- searching -------------------------------------------------------------------------------------------------

    def of_terms(self, table: DataFrame, terms: DataFrame | Iterable[str]) -> DataFrame:
        """The rows of a table of this index whose term is asked; few terms are pushed into the scan."""
        if isinstance(terms, DataFrame):
            terms = terms.select("term").distinct()
            asked = [r.term for r in terms.where("term is not null").limit(LITERAL_TERMS + 1).collect()]
        else:
            asked = sorted(set(terms))
            if len(asked) > LITERAL_TERMS:
                terms = self.spark.createDataFrame([(t,) for t in asked], "term string")
                terms = F.broadcast(terms) if len(asked) <= ASKED_ROWS else terms  # so that the postings aren't shuffled to be joined
        if len(asked) > LITERAL_TERMS:
            return table.join(terms.select("term"), "term", "left_semi")
        return table.where(F.col("term").isin(asked)) if asked else table.where(F.lit(False))

    def statistics(self, terms: Iterable[str]) -> dict[str, tuple[int, int]]:
        """(documents, blocks) of each of the terms that some document holds; of up to PLANNED terms remembered, since a generation doesn't change."""
        if missing := sorted(t for t in set(terms) if t not in self._known):
            if len(self._known) > PLANNED:
                self._known.clear()
            table = self._counted(self.of_terms(self.dictionary, missing), self.of_terms(self.raw_blocks, missing))
            self._known.update(dict.fromkeys(missing) | {r.term: (r.df, r.blocks) for r in table.collect()})
        return {t: known for t in set(terms) if (known := self._known.get(t))}

    def block_maxima(self, terms: Iterable[str]) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks, highest tf and least length of terms that together have no more than PLANNED blocks."""
        if missing := sorted(t for t in set(terms) if t not in self._maxima):
            if sum(len(x[0]) for x in self._maxima.values()) > PLANNED:
                self._maxima.clear()
                missing = sorted(set(terms))
            table = self.of_terms(self.raw_blocks.select("term", "block", "max_tf", "min_len"), missing).toArrow()
            term = np.array(table.column("term").to_pylist(), object)
            block, tf, length = (table.column(c).to_numpy() for c in ("block", "max_tf", "min_len"))
            order = np.argsort(term, kind="stable")
            edge = np.flatnonzero(np.concatenate([[True], term[order][1:] != term[order][:-1], [True]])) if len(term) else np.zeros(1, int)
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                at = order[a:b]
                self._maxima[term[at[0]]] = block[at], tf[at], length[at]
        return {t: self._maxima[t] for t in set(terms)}

    def document_counts(self, terms: Iterable[str]) -> dict[str, int]:
        """How many documents hold each of the terms; terms that none holds are left out."""
        return {t: df for t, (df, _) in self.statistics(terms).items()}

    def search(self, queries: DataFrame | list[tuple], k: int | None = 20) -> DataFrame:
        """(query_id, doc_id, score, rank) for ``queries(query_id, term)``; ties go to the smaller doc_id.

        Of up to ASKED_ROWS rows of queries, blocks that can't hold one of the best k are not read (``TopK``)."""
        from .topk import TopK

        if not isinstance(queries, DataFrame):
            queries = [(q, t) for q, t in queries if t is not None]
            kind = "long" if any(abs(q) >> 31 for q, _ in queries) else "int"
        else:
            kind = queries.schema["query_id"].dataType.simpleString()
            asked = queries.select("query_id", "term").where("term is not null").distinct()
            rows = asked.limit(ASKED_ROWS + 1).collect() if k is not None and self.manifest.unique else []
            if k is None or not self.manifest.unique or len(rows) > ASKED_ROWS:
                return self.scored_in_full(asked, k)
            queries = [(r.query_id, r.term) for r in rows]
        if k is None or not self.manifest.unique:
            return self.scored_in_full(self.spark.createDataFrame(sorted(set(queries)), f"query_id {kind}, term string"), k)
        return TopK(self, queries, kind, k).best()

    def scored_in_full(self, asked: DataFrame, k: int | None) -> DataFrame:
        found = self.of_terms(self.postings, asked).join(self.of_terms(self.terms, asked), "term").join(asked, "term")
        return lexical.ranked(found, self.corpus, k)

    def prefixed(self, prefix: str) -> DataFrame:
        """(block, slot, doc_id, hits): words that begin with the prefix."""
        rows = self.blocks.where(F.col("term").startswith(prefix)).select("block", F.explode(F.arrays_zip("slots", "doc_ids", "tfs")).alias("e"))
        return rows.groupBy("block", F.col("e.slots").alias("slot"), F.col("e.doc_ids").alias("doc_id")).agg(F.sum("e.tfs").alias("hits"))

    def placed(self, words: list[str]) -> DataFrame:
        """(block, slot, doc_id, p0, p1, ...): the places of each of the words in documents that hold all."""
        different = sorted(set(words))
        rows = self.of_terms(self.blocks, different).select("term", "block", "bits", F.struct("slots", "doc_ids", "places").alias("e"))
        met = rows.groupBy("block").agg(*(F.first(F.when(F.col("term") == w, F.struct("bits", "e")), ignorenulls=True).alias(f"w{i}") for i, w in enumerate(different)))
        both = F.col("w0.bits")
        for i in range(1, len(different)):
            both = both.bitwiseAND(F.col(f"w{i}.bits"))
        met = met.withColumn("both", both).where("both <> 0")
        slot = F.explode(F.filter(F.sequence(F.lit(0), F.lit(BLOCK - 1)), lambda s: _has(F.col("both"), s))).alias("slot")
        one = met.select("*", slot)
        at = [F.array_position(f"w{i}.e.slots", F.col("slot")).cast("int") for i in range(len(different))]
        places = {w: F.element_at(F.col(f"w{i}.e.places"), at[i]) for i, w in enumerate(different)}
        return one.select("block", "slot", F.element_at(F.col("w0.e.doc_ids"), at[0]).alias("doc_id"), *(places[w].alias(f"p{i}") for i, w in enumerate(words)))

    def phrase(self, words: list[str]) -> DataFrame:
        """(block, slot, doc_id, hits): places where the words follow each other."""
        found = self.placed(words)
        both = F.col("p0")
        for i in range(1, len(words)):
            both = F.array_intersect(both, F.expr(f"transform(p{i}, p -> p - {i})"))
        return found.select("block", "slot", "doc_id", F.size(both).alias("hits")).where("hits > 0")

    def like(self, pattern: str) -> DataFrame:
        """Terms that match a pattern of * (any letters) and ? (one): candidates by the grams that it must hold, then the pattern itself."""
        glob = "^" + "".join(".*" if c == "*" else "." if c == "?" else c for c in pattern) + "$"
        pieces = f"^{pattern}$".replace("?", "*").split("*")
        need = sorted({p[i : i + 3] for p in pieces for i in range(len(p) - 2)})
        terms = self.grams.where(F.col("gram").isin(need)).groupBy("term").agg(F.countDistinct("gram").alias("n")).where(F.col("n") == len(need)) if need else self.dictionary
        return terms.where(F.col("term").rlike(glob)).select("term")

    def near_terms(self, word: str, distance: int) -> DataFrame:
        """Terms within an edit distance: one edit changes three grams at most, so that they share the rest."""
        own = grams_of(word)
        least = len(own) - 3 * distance
        terms = self.grams.where(F.col("gram").isin(own)).groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") >= least) if least > 0 else self.dictionary
        close = F.abs(F.length("term") - len(word)) <= distance
        return terms.where(close & (F.levenshtein(F.col("term"), F.lit(word)) <= distance)).select("term")


def _runs(base: int):
    """Batches (doc_id, len, fields, tokens) of a task -> postings by runs; blocks are numbered from base, each task in a range of its own."""

    def run(batches):
        first, held, size = base + (TaskContext.get().partitionId() << 27), [], 0
        for batch in batches:
            step = max(1, min(batch.num_rows, (8 << 20) * batch.num_rows // max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                held.append(batch.slice(at, step))
                size += held[-1].nbytes
                if size >= RUN:
                    yield from _run(held, first)
                    first += -(-sum(b.num_rows for b in held) // BLOCK)
                    held, size = [], 0
        if held:
            yield from _run(held, first)

    return run


def _run(held: list[pa.RecordBatch], first: int):
    """One run: a row for each block with its documents, then the postings of all."""
    rows = pa.Table.from_batches(held)
    rows = rows.take(pc.sort_indices(rows.column("len"))).combine_chunks()
    number = np.arange(rows.num_rows)
    rows = rows.append_column("block", pa.array(first + number // BLOCK)).append_column("slot", pa.array((number % BLOCK).astype(np.int32)))
    posts = _block_postings(rows)
    entry = pa.StructArray.from_arrays([rows.column(c).combine_chunks() for c in _ENTRY], _ENTRY)
    docs = pa.ListArray.from_arrays(pa.array(np.append(number[::BLOCK], len(number)), pa.int32()), entry)
    blocks = pa.array(first + np.arange(len(docs)))
    yield pa.record_batch([blocks if c == "block" else pa.nulls(len(docs), posts.schema.field(c).type) for c in posts.column_names] + [docs], [*posts.column_names, "docs"])
    for batch in posts.append_column("docs", pa.nulls(posts.num_rows, docs.type)).to_batches(ROWS):
        yield batch


def _block_postings(rows: pa.Table) -> pa.Table:
    """The postings of blocks from their documents (block, slot, doc_id, len, tokens), sorted: a row for each term of each block.

    Occurrences are ordered by term, document and place, so that entries and rows are runs of them."""
    rows = rows.sort_by([("block", "ascending"), ("slot", "ascending")]).combine_chunks()
    tokens, ids = (rows.column(c).combine_chunks() for c in ("tokens", "doc_id"))
    slots, lens = (rows.column(c).to_numpy().astype(np.int32) for c in ("slot", "len"))
    blocks = rows.column("block").to_numpy()
    each = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    words = tokens.flatten().dictionary_encode()
    by_term = pc.sort_indices(words.dictionary)
    rank = np.empty(len(by_term), np.int64)
    rank[by_term.to_numpy()] = np.arange(len(by_term))
    keys = np.sort(rank[words.indices.to_numpy()] << 32 | np.arange(len(words)))  # by term, and as they come within it
    code, order = keys >> 32, keys & 0xFFFFFFFF
    doc = np.repeat(np.arange(len(each), dtype=np.int32), each)[order]
    place = (np.arange(len(order)) - np.repeat(np.cumsum(each) - each, each)).astype(np.int32)[order]
    differs = lambda x: np.concatenate([[True], x[1:] != x[:-1]])[: len(x)]
    entry = np.flatnonzero(differs(code) | differs(doc))  # the first occurrence of each term in each document
    at = doc[entry]
    first = np.flatnonzero(differs(code[entry]) | differs(blocks[at]))  # the first entry of each term in each block
    tfs = np.diff(np.append(entry, len(code))).astype(np.int32)
    lists = lambda values: pa.ListArray.from_arrays(pa.array(np.append(first, len(entry)), pa.int32()), values)
    each_place = pa.ListArray.from_arrays(pa.array(np.append(entry, len(code)), pa.int32()), pa.array(place))
    over = lambda how, x: how.reduceat(x, first) if len(first) else x[:0]
    bits = over(np.bitwise_or, np.uint64(1) << slots[at].astype(np.uint64)).view(np.int64)
    return pa.table({
        "term": words.dictionary.take(by_term).take(pa.array(code[entry][first])), "block": pa.array(blocks[at[first]]), "bits": pa.array(bits),
        "max_tf": pa.array(over(np.maximum, tfs)), "min_len": pa.array(over(np.minimum, lens[at])), "slots": lists(pa.array(slots[at])),
        "doc_ids": lists(ids.take(pa.array(at))), "lens": lists(pa.array(lens[at])), "tfs": lists(pa.array(tfs)), "places": lists(each_place),
    })


_ENTRY = ["slot", "doc_id", "len", "fields"]
_ARRAYS = (("slot", "slots"), ("doc_id", "doc_ids"), ("len", "lens"), ("tf", "tfs"), ("places", "places"))


def _bit(slot: str) -> Column:
    return F.expr(f"shiftleft(1L, {slot})")


def _has(bits: Column, slot: Column) -> Column:
    return F.getbit(bits, slot) == 1


def grams(term: Column) -> Column:
    """Three-letter pieces of ^term$."""
    marked = F.concat(F.lit("^"), term, F.lit("$"))
    return F.when(F.length(marked) < 3, F.array(marked)).otherwise(T.chargrams(marked, 3))


def grams_of(word: str) -> list[str]:
    marked = f"^{word}$"
    return sorted({marked[i : i + 3] for i in range(max(1, len(marked) - 2))})


def stored(docs: DataFrame) -> InvertedIndex:
    """The index of the words of ``docs(doc_id, text)``, a table of files; its other columns are stored with it.

    That of a whole table is kept below the shared folder under a name made of the table's files, their sizes and times, and
    opened again by later sessions as long as they are the same; that of another plan over files lives as long as the session."""
    spark = docs.sparkSession
    files = shared.stamped(spark, docs.inputFiles())
    whole = docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"
    key = (spark.sparkContext.applicationId, None if whole else docs.semanticHash(), tuple(files))
    if key not in _KEPT:
        fields = [c for c in docs.columns if c not in ("doc_id", "text")]
        if whole:
            name = hashlib.sha256(json.dumps([FORMAT, files, docs.schema.json()]).encode()).hexdigest()[:32]
            folder = f"{shared.root(spark)}/kept-index-{name}"
            index = InvertedIndex.open(spark, folder)
        else:
            folder, index = shared.scratch(spark, "index"), None
            shared.delete_at_exit(spark, folder)
        _KEPT[key] = index or _built(docs, folder, fields)
    return _KEPT[key]


def _built(docs: DataFrame, folder: str, fields: list[str]) -> InvertedIndex:
    try:
        return InvertedIndex.build(docs, folder, fields=fields)
    except Exception:
        # another session may have published the same index meanwhile
        if (index := InvertedIndex.open(docs.sparkSession, folder)) is None:
            raise
        return index
