"""Sorted-string-table shards of token ids.

A shard holds documents in ascending key order:

* data blocks of about ``BLOCK`` bytes; an entry is varint shared, varint rest, varint
  value length, the rest of the key behind the ``shared`` bytes it has in common with the
  key before it in the block, and the value; a crc32 closes each block;
* a sparse index with the last key, offset and length of each block;
* a Bloom filter over the keys;
* a footer of fixed length with the places of both, the counts, the bytes of an id and a magic.

A key is a byte for "is set" and the identifier as big-endian integer with flipped sign
bit, so that keys sort as identifiers do and a null sorts first. Values are little-endian
ids. Defined results: a null text has only the end id; rows that repeat an identifier are
all kept, ordered by a hash of their text and then the text; an empty table gives no shard
and no rows.
"""

from __future__ import annotations

import bisect
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import collected, file_system, rows, shared_dir, width
from .tokens import encoded, encoder

BLOCK, SHARD, BLOOM_BITS, BLOOM_HASHES = 64 << 10, 64 << 20, 10, 7
_FOOTER = struct.Struct("<QIQIQQI8s")
MAGIC = b"SILTSST1"


def key_of(doc_id: int | None) -> bytes:
    return b"\0" + bytes(8) if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & (1 << 64) - 1)


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:])[0] - (1 << 63) if key[0] else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(buf: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = buf[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bloom_places(key: bytes, bits: int) -> list[int]:
    a, b = struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())
    b |= 1
    return [(a + k * b) % bits for k in range(BLOOM_HASHES)]


class Writer:
    """Keys must come in ascending order."""

    def __init__(self, sink, itemsize: int):
        self.sink, self.itemsize, self.at = sink, itemsize, 0
        self.block, self.last, self.index, self.keys = bytearray(), b"", [], []
        self.n = self.n_ids = 0

    def add(self, key: bytes, value: bytes) -> None:
        if len(self.block) >= BLOCK:
            self._flush()
        shared = 0
        if self.block:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(key)
        self.n += 1
        self.n_ids += len(value) // self.itemsize

    def _flush(self) -> None:
        if self.block:
            data = bytes(self.block) + struct.pack("<I", zlib.crc32(self.block))
            self.sink.write(data)
            self.index.append((self.last, self.at, len(data)))
            self.at += len(data)
            self.block = bytearray()

    @property
    def size(self) -> int:
        return self.at + len(self.block)

    def close(self) -> None:
        self._flush()
        index = b"".join(_varint(len(k)) + k + _varint(o) + _varint(n) for k, o, n in self.index)
        bits = max(64, self.n * BLOOM_BITS)
        bloom = bytearray(-(-bits // 8))
        for k in self.keys:
            for p in _bloom_places(k, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        self.sink.write(index + bytes(bloom))
        self.sink.write(_FOOTER.pack(self.at, len(index), self.at + len(index), bits, self.n, self.n_ids, self.itemsize, MAGIC))
        self.sink.close()


class Reader:
    """Point lookups by Bloom filter and binary search of the index; scans block by block."""

    def __init__(self, uri: str):
        fs, path = file_system(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        index_at, index_len, bloom_at, self.bits, self.n, self.n_ids, self.itemsize, magic = _FOOTER.unpack(self._at(size - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no shard")
        self.last, self.places = [], []
        buf, at = self._at(index_at, index_len), 0
        while at < len(buf):
            n, at = _read_varint(buf, at)
            self.last.append(buf[at : at + n])
            o, at = _read_varint(buf, at + n)
            length, at = _read_varint(buf, at)
            self.places.append((o, length))
        self.bloom = self._at(bloom_at, -(-self.bits // 8))

    def _at(self, offset: int, length: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(length)

    def _entries(self, block: int) -> Iterator[tuple[bytes, bytes]]:
        data = self._at(*self.places[block])
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("a block is damaged")
        at, end, key = 0, len(data) - 4, b""
        while at < end:
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            length, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            yield key, data[at + rest : at + rest + length]
            at += rest + length

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for block in range(len(self.places)):
            yield from self._entries(block)

    def get(self, doc_id: int | None) -> np.ndarray | None:
        """The ids of the first document with this identifier, or None."""
        key = key_of(doc_id)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places(key, self.bits)):
            return None
        block = bisect.bisect_left(self.last, key)
        if block < len(self.places):
            for k, v in self._entries(block):
                if k >= key:
                    return np.frombuffer(v, f"<u{self.itemsize}") if k == key else None
        return None

    def close(self) -> None:
        self.file.close()


def write_shards(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = 0, shards: int | None = None) -> DataFrame:
    """Shards of the ids of ``docs(doc_id, text)``, in the shared folder; returns their manifest.

    One range shuffle by identifier (with a hash of the text, so that an identifier that
    many rows share doesn't fill one task), a sort in each partition, then a stream of
    rows into files of at most about ``SHARD`` bytes. A task that is run again writes
    other files; only those of the attempt that was counted are in the manifest."""
    spark = docs.sparkSession
    out = shared_dir(spark)

    def write(batches):
        fs, root = file_system(out)
        fs.create_dir(root, recursive=True)
        enc = encoder(vocabulary, True)
        end = enc._bytes([end_id])
        part = TaskContext.get().partitionId()
        done, w, first, prev = [], None, None, None

        def close():
            nonlocal w
            w.close()
            done.append((f"{out}/{name}", part, len(done), first, prev, w.n, w.n_ids))
            w = None

        name = ""
        for doc_id, ids in encoded(batches, vocabulary, True):
            if w is None:
                name, first = f"{part:06d}-{len(done):04d}-{uuid.uuid4().hex}.sst", doc_id
                w = Writer(fs.open_output_stream(f"{root}/{name}"), enc.itemsize)
            w.add(key_of(doc_id), ids + end)
            prev = doc_id
            if w.size >= SHARD:
                close()
        if w is not None:
            close()
        cols = list(zip(*done, strict=True)) or [[]] * 7
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["path", "part", "seq", "first_id", "last_id", "n_docs", "n_ids"])

    laid = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .withColumn("h", F.xxhash64("text"))
        .repartitionByRange(shards or width(spark), "doc_id", "h")
        .sortWithinPartitions("doc_id", "h", "text")
        .select("doc_id", "text")
    )
    return collected(laid.mapInArrow(write, "path string, part int, seq int, first_id long, last_id long, n_docs long, n_ids long"))


def read_shards(manifest: DataFrame) -> DataFrame:
    """A row for each document of the shards: doc_id, start, n_tokens, ids_crc32, n_bytes."""

    def read(batches):
        for path, start in rows(batches, "path", "start"):
            shard = Reader(path)
            out: list[tuple] = []
            for key, value in shard:
                ids = np.frombuffer(value, f"<u{shard.itemsize}")
                out.append((id_of(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), len(value)))
                start += len(ids)
                if len(out) == 4096:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=schema)
                    out = []
            shard.close()
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=schema)

    names = ["doc_id", "start", "n_tokens", "ids_crc32", "n_bytes"]
    schema = pa.schema([(n, pa.int64()) for n in names])
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard, not for each document
    placed = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))
    return placed.repartition(max(1, width(manifest.sparkSession))).mapInArrow(read, ", ".join(f"{n} long" for n in names))


def op1_sstable_shards(spark, sf_dir):
    return read_shards(write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet")))
