"""WARC archives: writing with revisit records and segments, reading with segment reassembly.

Writing: the payloads are grouped by SHA-1; the record with the largest page_id is a response,
the others revisit it. A response's HTTP block is framed in chunks; a block beyond
``segment_bytes`` is cut into a first record and continuation records that name its record
as WARC-Segment-Origin-ID. Each record is a gzip member of its own. Reading: records that
belong together are grouped by origin identifier wherever they lie, ordered by segment
number, held against WARC-Segment-Total-Length, and the chunked framing is taken off; the
digest of what results must be the one recorded.

Defined results: null html is an empty payload; records of equal payload that tie on the
largest page_id are all responses; null page_ids rank below all others (if a payload has
no other, all are responses); repeated rows are archived each; an empty table gives no rows.
A missing, repeated or short segment raises ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import collected, file_system, rows, shared_dir, width, written

SEGMENT, CHUNK, ARCHIVE = 16 << 10, 4 << 10, 64 << 20
DATE = "2000-01-01T00:00:00Z"  # pages have no dates
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunk_encode(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [payload[k : k + size] for k in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def chunk_decode(data: bytes) -> bytes:
    """Takes chunked framing off; chunk extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        eol = data.find(b"\r\n", at)
        if eol < 0:
            raise ValueError("chunked framing breaks off")
        n = int(data[at:eol].split(b";")[0].strip(), 16)
        at = eol + 2
        if not n:
            return b"".join(out)
        if at + n + 2 > len(data) or data[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk is short")
        out.append(data[at : at + n])
        at += n + 2


def payload_of(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return chunk_decode(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head) else body


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


def split_response(fields: list[tuple[str, object]], block: bytes, record_id: str, segment_bytes: int) -> Iterator[bytes]:
    """The gzip members of one response."""
    if len(block) <= segment_bytes:
        yield record([("WARC-Type", "response"), ("WARC-Record-ID", f"<{record_id}>"), *fields], block)
        return
    parts = [block[k : k + segment_bytes] for k in range(0, len(block), segment_bytes)]
    yield record([("WARC-Type", "response"), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Segment-Number", 1), *fields], parts[0])
    for n, p in enumerate(parts[1:], 2):
        own = uuid.uuid5(uuid.UUID(record_id[-36:]), str(n))
        total = ("WARC-Segment-Total-Length", len(block) if n == len(parts) else None)
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{own}>"), ("WARC-Segment-Origin-ID", f"<{record_id}>"), ("WARC-Segment-Number", n), total, ("WARC-Date", DATE)], p)


def read_records(uri: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of an archive, streamed."""
    fs, path = file_system(uri)
    with fs.open_input_stream(path, buffer_size=1 << 20) as f:
        data = f.read(1 << 20)
        while data:
            z, out = zlib.decompressobj(31), []
            while not z.eof:
                if not data and not (data := f.read(1 << 20)):
                    raise ValueError(f"{uri} breaks off")
                out.append(z.decompress(data))
                data = z.unused_data if z.eof else b""
            raw = b"".join(out)
            head, _, rest = raw.partition(b"\r\n\r\n")
            first, *lines = head.decode().split("\r\n")
            if not first.startswith("WARC/"):
                raise ValueError(f"{uri} holds no WARC record")
            fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
            n = int(fields["content-length"])
            if len(rest) < n:
                raise ValueError("a record is short")
            yield fields, rest[:n]
            data = data or f.read(1 << 20)


def write_archives(pages: DataFrame, segment_bytes: int = SEGMENT) -> DataFrame:
    """Archives of ``pages(page_id, url, html)`` in the shared folder; returns a table of their paths.

    Digests are grouped with partial sums before the pages meet them, so a payload that a
    third of all pages share travels as one row for each task; the join is left to
    adaptive execution, which splits such a digest."""
    spark = pages.sparkSession
    out = shared_dir(spark)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("h", F.sha1("html"))
    best = written(pages.groupBy("h").agg(F.max(F.struct("page_id", "url")).alias("best")))
    told = pages.join(best, "h").select("page_id", "url", "html", F.col("best.page_id").alias("best_id"), F.col("best.url").alias("best_url"))

    def clean(url):
        return None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)

    def run(batches):
        fs, root = file_system(out)
        fs.create_dir(root, recursive=True)
        part, sink, size, n, paths = TaskContext.get().partitionId(), None, 0, 0, []
        for page_id, url, html, best_id, best_url in rows(batches, "page_id", "url", "html", "best_id", "best_url"):
            if sink is None:
                paths.append(f"{part:06d}-{len(paths):04d}-{uuid.uuid4().hex}.warc.gz")
                sink, size = fs.open_output_stream(f"{root}/{paths[-1]}"), 0
            payload = html.encode()
            rid = f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{part}/{n}')}"
            n += 1
            common = [("WARC-Date", DATE), ("WARC-Target-URI", clean(url)), ("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"), ("Content-Type", "application/http;msgtype=response"), ("Siltstone-Page-ID", page_id)]
            http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            if page_id == best_id:
                members = split_response(common, http + b"Transfer-Encoding: chunked\r\n\r\n" + chunk_encode(payload), rid, segment_bytes)
            else:
                more = [("WARC-Profile", PROFILE), ("WARC-Refers-To-Target-URI", clean(best_url)), ("WARC-Refers-To-Date", DATE), ("Siltstone-Refers-To-Page-ID", best_id), ("Siltstone-Payload-Length", len(payload))]
                members = [record([("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{rid}>"), *common, *more], http + b"\r\n")]
            for m in members:
                sink.write(m)
                size += len(m)
            if size >= ARCHIVE:
                sink.close()
                sink = None
        if sink is not None:
            sink.close()
        yield pa.record_batch([pa.array([f"{out}/{p}" for p in paths], pa.string())], names=["path"])

    return collected(told.mapInArrow(run, "path string"))


_FIELDS = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
_RAW = [*_FIELDS, ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("data", pa.binary())]


def _ddl(fields) -> str:
    return ", ".join(f"{n} { {'int64': 'long', 'int32': 'int', 'string': 'string', 'binary': 'binary'}[str(t)] }" for n, t in fields)


def join_segments(parts: list[tuple[int, int | None, bytes]]) -> bytes:
    """The block of (segment number, total length or None, data) records, in any order."""
    parts = sorted(parts, key=lambda p: p[0])
    if [p[0] for p in parts] != list(range(1, len(parts) + 1)):
        raise ValueError("a segment is missing or there twice")
    block = b"".join(p[2] for p in parts)
    if parts[-1][1] != len(block):
        raise ValueError("the segments don't have the total length")
    return block


def read_archives(paths: DataFrame) -> DataFrame:
    """A row for each response and revisit of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Only segments carry data through the shuffle by origin; whole records have been digested."""

    def checked(block, digest):
        payload = payload_of(block)
        if (own := digest_of(payload)) != digest:
            raise ValueError("a payload differs from its digest")
        return len(payload), own

    def number(x):
        return None if x is None else int(x)

    def table(got, fields):
        return pa.RecordBatch.from_pylist([dict(zip([n for n, _ in fields], r, strict=True)) for r in got], schema=pa.schema(fields))

    def read(batches):
        for (path,) in rows(batches, "path"):
            out, held = [], 0
            for f, block in read_records(path):
                page, kind = number(f.get("siltstone-page-id")), f["warc-type"]
                digest = f.get("warc-payload-digest", "").removeprefix("sha1:")
                if kind == "revisit":
                    out.append((page, int(f["siltstone-payload-length"]), digest, kind, number(f.get("siltstone-refers-to-page-id")), f["warc-record-id"], None, None, None))
                elif kind == "continuation":
                    out.append((None, None, None, None, None, f["warc-segment-origin-id"], int(f["warc-segment-number"]), number(f.get("warc-segment-total-length")), block))
                elif "warc-segment-number" in f:
                    out.append((page, None, digest, kind, None, f["warc-record-id"], 1, None, block))
                else:
                    out.append((page, *checked(block, digest), kind, None, f["warc-record-id"], None, None, None))
                held += len(out[-1][-1] or b"") + 200
                if held > 4 << 20:
                    yield table(out, _RAW)
                    out, held = [], 0
            yield table(out, _RAW)

    def meet(batches):
        def whole(held):
            if held[0][6] is None:
                return [r[:5] for r in held]
            first = next(r for r in held if r[6] == 1)
            return [(first[0], *checked(join_segments([r[6:] for r in held]), first[2]), first[3], None)]

        out, held = [], []
        for r in rows(batches, *[n for n, _ in _RAW]):
            if held and held[0][5] != r[5]:
                out += whole(held)
                held = []
            held.append(r)
            if len(out) >= 4096:
                yield table(out, _FIELDS)
                out = []
        yield table(out + (whole(held) if held else []), _FIELDS)

    n = width(paths.sparkSession)
    raw = paths.repartition(n).mapInArrow(read, _ddl(_RAW))
    return raw.repartition(n, "origin").sortWithinPartitions("origin", "segment").mapInArrow(meet, _ddl(_FIELDS))


def op4_warc_segments(spark, sf_dir):
    return read_archives(write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet")))


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') html FROM pages),
s AS (SELECT page_id, strlen(html) n, lower(sha1(html)) h FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) best, list_transform(range(0, 40), lambda i: CAST(strpos('0123456789abcdef', h[i + 1]) - 1 AS INTEGER)) d FROM s)
SELECT page_id, CAST(n AS BIGINT) payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((d[5 * i // 4 + 1] * 16 + coalesce(d[5 * i // 4 + 2], 0)) >> CAST(3 - (5 * i) % 4 AS INTEGER)) & 31), 1)), 'string_agg', '') payload_digest,
  CASE WHEN best IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END record_type,
  CASE WHEN best IS NOT DISTINCT FROM page_id THEN NULL ELSE best END refers_to
FROM m
"""
