"""Alignment of two tokenizers over the same texts, and how often their ids are linked.

Tokens of both are nodes of a bipartite graph, with an edge where two tokens share bytes. A union-find over
it, as arrays, gives the components: each token is hooked to the first token of the other side that it overlaps,
which is the first of its component or leads to an earlier one, and paths are shortened by pointer jumping. The
components are the minimal groups: stretches between places where tokens of both end. All pairs of tokens in a
group are links.

1. A text is cut before single spaces, where neither vocabulary joins what lies on both sides, so that most texts
   are made of pieces whose tokens, groups and links are worked out once; other texts are one piece. A text takes part
   only if both tokenizers give back its bytes.
2. A task takes texts in batches of about ``BATCH`` signs, and sums their pairs before anything is shuffled: of
   each batch one row a pair goes to the count, whatever the number of its texts that hold the pair.
3. Pairs are counted over all batches, the highest count of each id of A is found, and each batch gets the
   counts of its own pairs back, to sum them for its texts. Nothing is broadcast; the pairs of all texts are never
   in one place.

Defined results: null and empty texts, and those whose tokens don't give back their bytes, have no tokens: zeros and
''. Rows are documents each, also those with one doc_id or none. Special tokens inside a text are plain text.
An empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunked, rows, written
from .tokens import PieceEncoder, vocabulary_path

BATCH = 4 << 20
PIECES = 300_000  # that a worker remembers; beyond, it begins anew before the next batch
BLOCK = 4096  # larger groups are paired by their different ids
_READY: dict[tuple[str, str], Aligner] = {}


class PlainEncoder(PieceEncoder):
    """Byte-level pieces in which special tokens are ordinary text."""

    CACHE = 200_000  # the aligner remembers pieces too

    def __init__(self, path: str):
        super().__init__(path, True)
        self.tok.encode_special_tokens = True
        self.apart = re.compile(rb"(?!)")
        runs = [chr(c) + " " for c in range(0x3001) if chr(c).isspace()]
        self.runs = {True: [r for r in runs if r.isascii()], False: runs}  # by whether the text is ASCII: a space behind them isn't cut off

    def token_bytes(self) -> list[bytes]:
        back = {c: b for b, c in self.letters.items()}
        names = (self.tok.id_to_token(i) for i in range(self.tok.get_vocab_size()))
        return [bytes(back[c] for c in n) if all(c in back for c in n) else n.encode() for n in names]


def _arange(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] of them), start[1], ..."""
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


def components(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of its component for each token of A and of B, from where tokens end; both cover the same bytes."""
    first_b = np.searchsorted(ends_b, np.concatenate([[0], ends_a[:-1]]), side="right")  # that holds the first byte of each token of A
    first_a = np.searchsorted(ends_a, np.concatenate([[0], ends_b[:-1]]), side="right")
    root = first_a[first_b]
    while True:
        further = root[root]
        if (further == root).all():
            break
        root = further
    number = np.cumsum(root == np.arange(len(root))) - 1
    return number[root], number[root[first_a]]


def grouped_links(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, pair, times) of the links within groups; a pair is id of A << 32 | id of B, given more than once where that is cheaper."""
    n = int(group_a[-1]) + 1 if len(group_a) else 0
    na, nb = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
    at_b = np.cumsum(nb) - nb
    few = np.flatnonzero(na[group_a] * nb[group_a] <= BLOCK)
    g = group_a[few]
    group = np.repeat(g, nb[g])
    pair = np.repeat(a[few], nb[g]).astype(np.int64) << 32 | b[_arange(at_b[g], nb[g])]
    out = [(group, pair, np.ones(len(pair), np.int64))]
    at_a = np.cumsum(na) - na
    for k in np.flatnonzero(na * nb > BLOCK):
        x, cx = np.unique(a[at_a[k] : at_a[k] + na[k]], return_counts=True)
        y, cy = np.unique(b[at_b[k] : at_b[k] + nb[k]], return_counts=True)
        out.append((np.full(len(x) * len(y), k), (x[:, None].astype(np.int64) << 32 | y).ravel(), (cx[:, None] * cy).ravel()))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


class Aligned:
    """What is known of pieces: counts, text form and pairs, by piece number."""

    def __init__(self):
        self.counts = np.zeros((0, 4), np.int64)  # tokens of A and B, groups, links
        self.forms: list[str] = []
        self.at = np.zeros(1, np.int64)
        self.pairs = np.zeros(0, np.int64)
        self.times = np.zeros(0, np.int64)

    def add(self, a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, vocabulary: Vocabulary) -> None:
        """Pieces with na[k] and nb[k] tokens each, of the ids a and b one after another."""
        if not len(na):
            return
        group_a, group_b = components(np.cumsum(vocabulary.len_a[a]), np.cumsum(vocabulary.len_b[b]))
        item = np.repeat(np.arange(len(na)), na)
        of = item[np.searchsorted(group_a, np.arange(int(group_a[-1]) + 1))]  # the piece of each group
        ga, gb = np.bincount(group_a), np.bincount(group_b)
        group, pair, times = grouped_links(a, b, group_a, group_b)
        sums = np.zeros((len(na), 4), np.int64)
        sums[:, 0], sums[:, 1] = na, nb
        np.add.at(sums[:, 2], of, 1)
        np.add.at(sums[:, 3], of, ga * gb)
        order = np.lexsort((pair, of[group]))
        where, pair, times = of[group][order], pair[order], times[order]
        new = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1]) | (pair[1:] != pair[:-1])]))
        self.counts = np.concatenate([self.counts, sums])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(np.bincount(where[new], minlength=len(na)))])
        self.pairs = np.concatenate([self.pairs, pair[new]])
        self.times = np.concatenate([self.times, np.add.reduceat(times, new)])
        # each token with what follows it: another of its side, the other side, another group, the end of its piece
        last_a, last_b = np.cumsum(ga) - 1, np.cumsum(gb) - 1
        end_a, end_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        end_a[last_a], end_b[last_b] = 1, 2
        end_b[np.cumsum(nb) - 1] = 3
        codes = np.concatenate([a + end_a * vocabulary.size, b + end_b * vocabulary.size])
        codes = codes[np.argsort(np.concatenate([group_a * 2, group_b * 2 + 1]), kind="stable")]
        self.forms += "".join(map(vocabulary.names.__getitem__, codes.tolist())).split("\n")[:-1]


class Vocabulary:
    """Bytes of the tokens of both sides, and ids as text with each of the signs that can follow."""

    def __init__(self, bytes_a: list[bytes], bytes_b: list[bytes]):
        self.bytes_a, self.bytes_b = bytes_a, bytes_b
        self.len_a, self.len_b = (np.array([len(x) for x in t]) for t in (bytes_a, bytes_b))
        self.size = max(len(bytes_a), len(bytes_b))
        self.names = [f"{i}{end}" for end in ",|;\n" for i in range(self.size)]

    def whole(self, a: np.ndarray, b: np.ndarray, text: str) -> bool:
        """Whether both give back the text behind a space."""
        want = text.encode("utf-8", "surrogatepass")
        return b"".join(map(self.bytes_a.__getitem__, a.tolist())) == want == b"".join(map(self.bytes_b.__getitem__, b.tolist()))


class Aligner:
    def __init__(self, name_a: str, name_b: str):
        from sentencepiece import SentencePieceProcessor

        self.a = PlainEncoder(name_a)
        self.b = SentencePieceProcessor(model_file=name_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.vocabulary = Vocabulary(self.a.token_bytes(), [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        self.kind = np.dtype(f"<u{self.a.itemsize}")
        self.space = self.b.piece_to_id("▁")
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}  # of a piece; -1: its tokens don't give it back
        self.known = Aligned()

    def _ids_b(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids one after another and how many each text has; the tokenizer puts a space before each text, but for an empty one."""
        ids = [x or [self.space] for x in self.b.encode(texts, num_threads=1)]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum())), n

    def learn(self, pieces: set[str]) -> None:
        names, v = list(pieces), self.vocabulary
        got = self.a.batch([" " + p for p in names])
        a = np.frombuffer(b"".join(got), self.kind).astype(np.int64)
        na = np.fromiter(map(len, got), np.int64, len(names)) // self.kind.itemsize
        b, nb = self._ids_b(names)
        if v.whole(a, b, " " + " ".join(names)) and (np.add.reduceat(v.len_a[a], np.cumsum(na) - na) == np.add.reduceat(v.len_b[b], np.cumsum(nb) - nb)).all():
            good = np.ones(len(names), bool)
        else:
            ends_a, ends_b = np.cumsum(na), np.cumsum(nb)
            good = np.array([v.whole(a[i - m : i], b[j - n : j], " " + p) for p, i, m, j, n in zip(names, ends_a, na, ends_b, nb, strict=True)])
            a, b = a[np.repeat(good, na)], b[np.repeat(good, nb)]
        n = len(self.known.forms)
        self.known.add(a, na[good], b, nb[good], v)
        self.number.update(zip(names, np.where(good, n + np.cumsum(good) - 1, -1).tolist(), strict=True))

    def alone(self, text: str) -> tuple[Aligned, np.ndarray] | None:
        """A text as one piece."""
        a = np.frombuffer(self.a.whole(" " + text), self.kind).astype(np.int64)
        b, n = self._ids_b([text])
        if not self.vocabulary.whole(a, b, " " + text):
            return None
        own = Aligned()
        own.add(a, np.array([len(a)]), b, n, self.vocabulary)
        return own, np.zeros(1, np.int64)

    def texts(self, texts: list[str]) -> list[tuple[Aligned, np.ndarray] | None]:
        """Each text as numbers of pieces, or None where it has no tokens."""
        if len(self.number) > PIECES:
            self.forget()
        cut = [None if not t or t.startswith(" ") or any(map(t.__contains__, self.a.runs[t.isascii()])) else t.split(" ") for t in texts]
        if missing := {p for ps in cut if ps for p in ps if p not in self.number}:
            self.learn(missing)
        out: list[tuple[Aligned, np.ndarray] | None] = []
        for t, ps in zip(texts, cut, strict=True):
            numbers = np.array([self.number[p] for p in ps], np.int64) if ps else None
            if numbers is not None and numbers.min() >= 0:
                out.append((self.known, numbers))
            else:
                out.append(self.alone(t) if t else None)
        return out


def aligner(name_a: str, name_b: str) -> Aligner:
    """One for each worker process; names are files of the tokenizers folder or paths."""
    key = (name_a, name_b)
    if key not in _READY:
        _READY[key] = Aligner(*(n if "/" in n else vocabulary_path(n) for n in key))
    return _READY[key]


_FOUND = "batch long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, uses binary, asked binary, held binary"


def _packed(*columns: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.concatenate([np.asarray(c, "<u4") for c in columns]).tobytes())


def _unpacked(data: bytes, columns: int) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<u4").reshape(columns, -1)


def aligned_batches(docs: DataFrame, name_a: str, name_b: str) -> DataFrame:
    """A row for each document, with its uses of the pairs of its batch, and one for each batch (asked, held): its pairs, and how many of its documents hold each."""

    def run(batches):
        know, batch = aligner(name_a, name_b), TaskContext.get().partitionId() << 32
        for part in chunked(rows(batches, "doc_id", "text"), lambda r: len(r[1] or "") + 200, BATCH):
            got = know.texts([t or "" for _, t in part])
            facts, doc, pair, times = [], [], [], []
            for k, x in enumerate(got):
                if x is None:
                    facts.append((0, 0, 0, 0, ""))
                    continue
                known, numbers = x
                facts.append((*known.counts[numbers].sum(axis=0).tolist(), hashlib.sha256(";".join([known.forms[n] for n in numbers.tolist()]).encode()).hexdigest()))
                some, often = np.unique(numbers, return_counts=True)
                size = known.at[some + 1] - known.at[some]
                at = _arange(known.at[some], size)
                doc.append(np.full(len(at), k))
                pair.append(known.pairs[at])
                times.append(known.times[at] * np.repeat(often, size))
            uses: list[bytes | None] = [None] * len(part)
            asked = held = None
            if doc:
                doc, pair, times = map(np.concatenate, (doc, pair, times))
                asked, local = np.unique(pair, return_inverse=True)
                order = np.lexsort((local, doc))
                doc, local, times = doc[order], local[order], times[order]
                new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (local[1:] != local[:-1])]))
                doc, local, times = doc[new], local[new], np.add.reduceat(times, new)
                held = np.bincount(local, minlength=len(asked))
                edge = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1], [True]]))
                for a, b in zip(edge[:-1], edge[1:], strict=True):
                    uses[doc[a]] = _packed(np.diff(local[a:b], prepend=0), times[a:b] & 0xFFFFFFFF, times[a:b] >> 32)
            out = [(batch, i, *fact, use, None, None) for (i, _), fact, use in zip(part, facts, uses, strict=True)]
            if asked is not None:
                out.append((batch, *[None] * 7, asked.astype("<i8").tobytes(), held.astype("<i8").tobytes()))
            kinds = [pa.int64()] * 6 + [pa.string(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[c.split()[0] for c in _FOUND.split(", ")])
            batch += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _FOUND)


def _asks(batches):
    for b in batches:
        for batch, asked, held in rows([b], "batch", "asked", "held"):
            pair = np.frombuffer(asked, "<i8")
            for at in range(0, len(pair), 1 << 16):
                own = pair[at : at + (1 << 16)]
                place = np.arange(at, at + len(own))
                yield pa.record_batch([pa.array(np.full(len(own), batch)), pa.array(own), pa.array(place, pa.int32()), pa.array(np.frombuffer(held, "<i8")[at : at + len(own)])], names=["batch", "pair", "place", "held"])


_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _summed(docs: pa.Table, told: pa.Table) -> pa.Table:
    """The documents of a batch and the counts of its pairs."""
    place = told.column("place").to_numpy()
    count, best = np.zeros(len(place), np.int64), np.zeros(len(place), bool)
    count[place], best[place] = told.column("count").to_numpy(), told.column("best").to_numpy()
    sums = np.zeros((docs.num_rows, 2), np.int64)
    for k, data in enumerate(docs.column("uses").to_pylist()):
        if data is not None:
            step, low, high = _unpacked(data, 3).astype(np.int64)
            at, times = np.cumsum(step), high << 32 | low
            sums[k] = times[best[at]].sum(), (times * count[at]).sum()
    out = docs.drop_columns(["batch", "uses", "groups_sha256"])
    return out.append_column("n_best", pa.array(sums[:, 0])).append_column("count_sum", pa.array(sums[:, 1])).append_column("groups_sha256", docs.column("groups_sha256"))


def alignment(docs: DataFrame, name_a: str = "byte_bpe_50k.json", name_b: str = "piece_bpe_32k.model") -> DataFrame:
    """For each row of docs(doc_id, text): tokens, groups and links, how many links are the best of their id of A, and the sum of their counts."""
    found = written(aligned_batches(docs, name_a, name_b))
    asks = found.where("asked is not null").select("batch", "asked", "held").mapInArrow(_asks, "batch long, pair long, place int, held long")
    counts = written(asks.groupBy("pair").agg(F.sum("held").alias("count")))
    of_a = F.shiftright("pair", 32)
    top = counts.groupBy(of_a.alias("a")).agg(F.max("count").alias("top"))
    judged = counts.withColumn("a", of_a).join(top, "a").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))
    told = asks.join(judged, "pair").select("batch", "place", "count", "best")
    own = found.where("asked is null").drop("asked", "held")
    return own.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(_summed, _OUT)


def op12_overlap_components(spark, sf_dir):
    return alignment(spark.read.parquet(f"{sf_dir}/documents.parquet"))
