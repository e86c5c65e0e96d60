"""Harmonic packing of documents into sequences.

Lengths fall into reciprocal-capacity classes: class k takes pieces of more than
capacity/(k+1) and at most capacity/k tokens, and each of its bins holds exactly k of
them. Because documents may be cut, a remainder that would waste more than 1/SLACK of its
slot gives a head of exactly the next smaller slot and its rest is classed again. Pieces of
at most capacity/CLASSES share the last class, whose bins are filled to the brim. Each
worker fills its bins without regard to the others. What is left in open bins at a
worker's end is laid end to end; the last sequence of that is cut into sequences whose
lengths are powers of two, which need no padding.

Defined results: a null or empty text has only the end id; repeated rows are packed each;
an empty table gives no rows. No shuffle; memory is one document and the open bins.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import encoded, encoder

CLASSES, SLACK = 16, 64

Piece = tuple  # doc_id, start, ids (array), doc_tokens


class HarmonicPacker:
    def __init__(self, capacity: int, emit):
        self.capacity, self.emit = capacity, emit
        self.open: dict[int, list[Piece]] = {k: [] for k in range(2, CLASSES + 2)}
        self.small = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        c, n, at = self.capacity, len(ids), 0
        while n - at >= c:
            self.emit([(doc_id, at, ids[at : at + c], n)])
            at += c
        while at < n:
            r = n - at
            k = c // r
            if k > CLASSES:
                self._small(doc_id, at, ids[at:], n)
                return
            slot = c // k
            if slot - r <= slot // SLACK:
                take = r
            elif k == CLASSES:
                self._small(doc_id, at, ids[at:], n)
                return
            else:
                k += 1
                take = c // k
            self._put(k, (doc_id, at, ids[at : at + take], n))
            at += take

    def _put(self, k: int, piece: Piece) -> None:
        if k == 1:
            self.emit([piece])
            return
        held = self.open[k]
        held.append(piece)
        if len(held) == k:
            self.emit(held)
            self.open[k] = []

    def _small(self, doc_id, at: int, ids: np.ndarray, n: int) -> None:
        held = self.open[CLASSES + 1]
        room = self.capacity - self.small
        held.append((doc_id, at, ids[:room], n))
        self.small += min(room, len(ids))
        if self.small == self.capacity:
            self.emit(held)
            self.open[CLASSES + 1], self.small = [], 0
            if len(ids) > room:
                self._small(doc_id, at + room, ids[room:], n)

    def close(self) -> None:
        rest = [p for k in sorted(self.open) for p in self.open[k]]
        total = sum(len(p[2]) for p in rest)
        while total:
            want = self.capacity if total >= self.capacity else 1 << total.bit_length() - 1
            seq, have = [], 0
            while have < want:
                doc_id, at, ids, n = rest.pop(0)
                take = min(len(ids), want - have)
                seq.append((doc_id, at, ids[:take], n))
                if take < len(ids):
                    rest.insert(0, (doc_id, at + take, ids[take:], n))
                have += take
            self.emit(seq)
            total -= want


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, capacity: int = 2048, vocabulary: str = "word_bpe_49k.json", end_id: int = 1) -> DataFrame:
    """Pieces of ``docs(doc_id, text)``: where each lies in its document and in which sequence.

    sequence_id holds the worker's number in the upper and a count in the lower 32 bits."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    schema = pa.schema([(n, pa.int64()) for n in names])

    def run(batches):
        enc = encoder(vocabulary, False)
        end = enc._bytes([end_id])
        kind = f"<u{enc.itemsize}"
        seq = TaskContext.get().partitionId() << 32
        out: list[tuple] = []

        def emit(pieces):
            nonlocal seq
            offset = 0
            for doc_id, at, ids, n in pieces:
                out.append((doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, seq, offset))
                offset += len(ids)
            seq += 1

        def batch():
            done = pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * len(names), schema=schema)
            out.clear()
            return done

        packer = HarmonicPacker(capacity, emit)
        for doc_id, ids in encoded(batches, vocabulary, False):
            packer.add(doc_id, np.frombuffer(ids + end, kind))
            if len(out) >= 8192:
                yield batch()
        packer.close()
        yield batch()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def op3_harmonic_packing(spark, sf_dir):
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
