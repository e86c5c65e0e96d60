"""Files as documents: listing, type detection and text extraction over the binaryFile source."""

from __future__ import annotations

import html
import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from email import message_from_bytes, policy
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..operators.store import latest, size_category
from ..storage import Tables

#: File classes by extension, beginnings of files (hex), folders that are passed over.
CLASSES = {"pdf": "Pdf", "docx": "Docx", "doc": "Docx", "txt": "Text", "md": "Markdown", "markdown": "Markdown", "html": "Html", "htm": "Html", "jpg": "Image", "jpeg": "Image", "png": "Image", "gif": "Image", "bmp": "Image", "mp3": "Audio", "wav": "Audio", "flac": "Audio", "ogg": "Audio", "mp4": "Video", "avi": "Video", "mkv": "Video", "mov": "Video", "eml": "Email", "msg": "Email"}
MAGIC = {"25504446": "Pdf", "504B0304": "Docx", "FFD8FF": "Image", "89504E47": "Image", "47494638": "Image", "424D": "Image", "494433": "Audio", "4F676753": "Audio", "664C6143": "Audio", "3C21444F43545950": "Html", "3C68746D6C": "Html"}
SKIPPED = ["node_modules", "target", ".git", ".svn", "__pycache__", ".vscode", ".idea"]
TEXTUAL = ["txt", "md", "markdown", "html", "htm", "pdf", "docx", "doc", "eml", "csv", "json", "xml", "rs", "py", "js", "ts", "java", "c", "cpp", "go"]


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def file_class(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in CLASSES.items() for x in kv])
    return F.coalesce(F.element_at(known, extension(path)), F.lit("Unknown"))


def magic_class(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 8))
    c = F.lit(None).cast("string")
    for m, k in MAGIC.items():
        c = F.when(F.startswith(head, F.lit(m)), k).otherwise(c)
    return c


def printable_share(content: Column) -> Column:
    """Share of printable ASCII and white space among the first 1024 bytes."""
    head = F.hex(F.substring(content, 1, 1024))
    bad = F.length(F.regexp_replace(head, "(?:[2-6][0-9A-F]|7[0-9A-E]|0[9AD])|(..)", "$1")) / 2
    n = F.length(head) / 2
    return F.when(n > 0, 1 - bad / n).otherwise(0.0)


def detected(path: Column, content: Column) -> Column:
    """struct(kind, confidence): magic 0.9, extension 0.7, text by its looks 0.7, unknown 0.1."""
    magic, ext = magic_class(content), file_class(path)
    return (
        F.when(magic.isNotNull(), F.struct(magic.alias("kind"), F.lit(0.9).alias("confidence")))
        .when(ext != "Unknown", F.struct(ext.alias("kind"), F.lit(0.7).alias("confidence")))
        .when(printable_share(content) > 0.8, F.struct(F.lit("Text").alias("kind"), F.lit(0.7).alias("confidence")))
        .otherwise(F.struct(F.lit("Unknown").alias("kind"), F.lit(0.1).alias("confidence")))
    )


def listing(spark: SparkSession, root: str, max_depth: int | None = None, hidden: bool = False, exclude: list[str] | None = None, least: int = 0, most: int | None = None, content: bool = True) -> DataFrame:
    """Files below root as (path, modificationTime, length[, content]); without content only names are read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    if not content:
        df = df.drop("content")
    rest = F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/").split("//")[-1]), "")
    parts = F.filter(F.split(rest, "/"), lambda p: p != "")
    keep = (F.col("length") >= least) & ~F.exists(parts, lambda p: p.isin(SKIPPED))
    if most is not None:
        keep = keep & (F.col("length") <= most)
    if not hidden:
        keep = keep & ~F.exists(parts, lambda p: p.startswith("."))
    if max_depth is not None:
        keep = keep & (F.size(parts) <= max_depth)
    for x in exclude or []:
        keep = keep & ~F.contains("path", F.lit(x))
    return df.where(keep)


def partial_hash(content: Column, edge: int = 1 << 20, whole: int = 10 << 20) -> Column:
    """SHA-256 of the content, of large files of their first and last edge bytes."""
    n = F.octet_length(content)
    return F.when(n <= whole, F.sha2(content, 256)).otherwise(F.sha2(F.concat(F.substring(content, 1, edge), F.substring(content, n - edge + 1, F.lit(edge))), 256))


def docx_text(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        xml = z.read("word/document.xml").decode("utf-8", "replace")
    return " ".join(re.sub(r"<[^>]*>", " ", xml).split())


_PDF_STREAM = re.compile(rb">>\s*stream\r?\n")
_PDF_SIGN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|[A-Za-z'\"*]+|[-+.\d]+", re.S)
_PDF_ESCAPE = re.compile(rb"\\([nrtbf()\\]|[0-7]{1,3}|\r?\n)")
_PDF_CODES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _pdf_string(token: bytes) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("cp1252", "replace")

    def code(m: re.Match) -> bytes:
        x = m[1]
        return _PDF_CODES.get(x) or (bytes([int(x, 8) & 255]) if x[:1].isdigit() else b"" if x[-1:] == b"\n" else x)

    return _PDF_ESCAPE.sub(code, token[1:-1]).decode("cp1252", "replace")


def pdf_text(data: bytes) -> str:
    """Text that the content streams of a PDF show, words and lines parted by one space.

    Streams are plain or deflated, strings in the common one-byte encoding. Files with fonts of their own encoding, with
    encryption or without text give little or nothing; they are left to character recognition."""
    out: list[str] = []
    at = 0
    while m := _PDF_STREAM.search(data, at):
        about = data[max(data.rfind(b"obj", at, m.start()), at) : m.start()]
        end = data.find(b"endstream", m.end())
        end = end if end >= 0 else len(data)
        body, at = data[m.end() : end], end
        if b"/Subtype" in about or b"/ObjStm" in about or b"/XRef" in about:
            continue  # images, fonts, tables of objects
        if b"/FlateDecode" in about:
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error:
                continue
        for text in re.findall(rb"\bBT\b(.*?)\bET\b", body, re.S):
            strings: list[str] = []
            in_array = False
            for token in _PDF_SIGN.findall(text):
                if token[:1] in b"(<":
                    strings.append(_pdf_string(token))
                elif token == b"[":
                    in_array, strings = True, []
                elif token == b"]":
                    in_array = False
                elif in_array and token[:1] in b"-+.0123456789":
                    if re.fullmatch(rb"-\d*\.?\d+|-\d+\.", token) and float(token) < -200:  # a gap as wide as a space
                        strings.append(" ")
                elif token in (b"Tj", b"TJ", b"'", b'"'):
                    out.append(("\n" if token in (b"'", b'"') else "") + "".join(strings))
                    strings = []
                elif token in (b"Td", b"TD", b"T*", b"Tm"):
                    out.append("\n")
            out.append("\n")
    return " ".join("".join(out).split())


def mail_fields(raw: Column) -> Column:
    """struct(subject, sender, recipient, date, body) of a message: headers end at the first empty line, folded ones are joined.

    Fields that are missing are null, and all of a null text are; a text without an empty line is all headers."""
    text = F.replace(raw, F.lit("\r\n"), F.lit("\n"))
    cut = F.locate("\n\n", text)
    head = F.regexp_replace(F.when(cut > 0, F.left(text, cut - 1)).otherwise(text), r"\n[ \t]+", " ")
    body = F.when(cut > 0, F.substring(text, cut + 2, F.length(text))).when(cut == 0, F.lit(""))
    named = lambda n: F.nullif(F.trim(F.regexp_extract(head, rf"(?im)^{n}:[ \t]*(.*)$", 1)), F.lit(""))
    return F.struct(named("Subject").alias("subject"), named("From").alias("sender"), named("To").alias("recipient"), named("Date").alias("date"), body.alias("body"))


def mail_text(data: bytes) -> str:
    """Subject, sender and body of a message; encoded words and bodies are decoded, of several forms of a body the plain one counts."""
    message = message_from_bytes(data, policy=policy.default)
    body = message.get_body(("plain", "html"))
    text = body.get_content() if body is not None else ""
    if body is not None and body.get_content_type() == "text/html":
        text = html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", " ", text)))
    return " ".join(" ".join([str(message["Subject"] or ""), str(message["From"] or ""), text]).split())


_READERS = {"Docx": docx_text, "Pdf": pdf_text, "Email": mail_text}


def read_by(kind: str, data: bytes) -> tuple[str, str | None]:
    """(text, problem): a file that its reader can't read is a document without text, and tells why."""
    try:
        return _READERS[kind](data).encode("utf-8", "replace").decode(), None
    except Exception as e:  # noqa: BLE001  any bytes may come; one file must not stop the others
        return "", f"{type(e).__name__}: {e}"[:200]


def text_of(content: Column) -> Column:
    """Bytes as text: UTF-8 (a mark in front is dropped), or, where they aren't, Latin-1, which reads any bytes."""
    return F.regexp_replace(F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1")), "^\ufeff", "")


def documents(files: DataFrame, min_chars: int = 0) -> DataFrame:
    """Files as documents: path, kind, size class, hash, text, needs_ocr, problem.

    Text, Markdown and HTML are read by expressions, whatever their bytes; mails (subject, sender and body), office documents
    and PDF need Python. A file that can't be read has no text and a problem; an
    empty file is no document (Spark lists none). Images, and PDF files that show no text, are
    marked for character recognition."""
    f = files.withColumn("kind", detected(F.col("path"), F.col("content"))["kind"])
    raw = text_of(F.col("content"))
    by_python = F.coalesce(F.col("kind").isin(*_READERS), F.lit(False))
    text = F.when(F.col("kind") == "Html", T.strip_html(raw)).when(F.col("kind") == "Markdown", T.strip_markdown(raw)).when(F.col("kind") == "Text", T.folded(raw)).otherwise(F.lit(""))
    plain = f.where(~by_python).withColumn("text", text).withColumn("problem", F.lit(None).cast("string"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            read = [read_by(k, bytes(c)) for k, c in zip(x["kind"], x["content"], strict=True)]
            x["text"], x["problem"] = ([r[i] for r in read] for i in (0, 1))
            yield x

    schema = plain.schema
    office = f.where(by_python).withColumn("text", F.lit("")).withColumn("problem", F.lit(None).cast("string")).mapInPandas(run, schema)
    out = plain.unionByName(office)
    ocr = (F.col("kind") == "Image") | ((F.col("kind") == "Pdf") & (F.col("text") == ""))
    return out.select(
        "path", "kind", "length", F.col("modificationTime").alias("modified"), size_category(F.col("length")).alias("size_category"), partial_hash(F.col("content")).alias("content_hash"),
        "text", T.language(F.col("text")).alias("lang"), ocr.alias("needs_ocr"), "problem",
    ).where((F.length("text") >= min_chars) | F.col("needs_ocr"))


def watch(spark: SparkSession, root: str, target: str, state: str, once: bool = True) -> StreamingQuery:
    """New files below root become documents in target, one folder a batch; ``state`` (a checkpoint) is what it has seen.

    A batch that runs again after a lost driver writes its folder again, so nothing is taken twice. The source tells
    created files and those that got a new name; ``operators.upkeep.changes`` tells the rest from two listings."""
    found = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(root)

    def take(batch: DataFrame, number: int) -> None:
        documents(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    w = found.writeStream.foreachBatch(take).option("checkpointLocation", state)
    return (w.trigger(availableNow=True) if once else w).start()


def watched(spark: SparkSession, target: str) -> DataFrame:
    """What a watch has written: of each path the document of the latest batch."""
    return latest(spark.read.parquet(target), ["path"], F.desc("batch"))


def file_count(spark: SparkSession, root: str, **options) -> int:
    """Files below a folder, by their names alone; options as for ``listing``."""
    return listing(spark, root, content=False, **options).count()


FOLDERS = 512  # of files that are written one a row


def write_files(texts: DataFrame, root: str, key: str) -> int:
    """Each row of (key, value) as a text file of its own, ``root/<folder>/key=...,<task>-<number>.txt``, closed by a line feed; how many.

    Files are dealt to FOLDERS folders by key, so that a listing takes a call for many of them. A task that runs again writes the
    same names. Rows of a null value are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = FileSystem.from_uri(root)
        task, n, known = TaskContext.get().partitionId(), 0, set()
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                name = quote(str(k), safe="")
                folder = f"{base}/{zlib.crc32(name.encode()) % FOLDERS:03d}"
                if folder not in known:
                    fs.create_dir(folder, recursive=True)
                    known.add(folder)
                with fs.open_output_stream(f"{folder}/{key}={name},{task}-{n}.txt") as f:
                    f.write(v + b"\n")
                n += 1
        yield pa.record_batch([pa.array([n], pa.int64())], names=["n"])

    return texts.where("value IS NOT NULL").select(key, F.col("value").cast("string").alias("value")).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


OPEN_COST = "spark.sql.files.openCostInBytes"


def read_once(tables: Tables, files: DataFrame, cost: int = 64 << 10) -> DataFrame:
    """Files of a listing as a table of their own: each is opened once, many small ones in a task (``cost`` bytes count for opening one)."""
    spark = files.sparkSession
    before = spark.conf.get(OPEN_COST)
    spark.conf.set(OPEN_COST, str(cost))
    try:
        return tables.write(files)
    finally:
        spark.conf.set(OPEN_COST, before)


def write_table(df: DataFrame, path: str, kind: str = "parquet", partition: list[str] | None = None, mode: str = "append") -> None:
    """Appends or overwrites a table; kind is any of Spark's file formats."""
    w = df.write.mode(mode).format(kind)
    if kind == "csv":
        w = w.option("header", True)
    (w.partitionBy(*partition) if partition else w).save(path)


def indexable(path: Column, content: Column | None = None) -> Column:
    """Known extensions, or, without one, what looks like text; never hidden files or those of passed-over folders."""
    parts = F.split(path, "/")
    named = extension(path).isin(sorted({*CLASSES, *TEXTUAL}))
    looks = F.lit(False) if content is None else (extension(path) == "") & (printable_share(content) > 0.8)
    return (named | looks) & ~F.exists(parts, lambda p: p.isin(SKIPPED) | p.rlike(r"^\.[^.]"))


def page_estimate(text: Column) -> Column:
    """Pages of a document without page marks: one for each 500 words, at least one."""
    return F.greatest(F.floor(T.word_count(text) / 500), F.lit(1))


def backup(spark: SparkSession, source: str, target: str) -> None:
    """A copy of a table, as it is read now."""
    spark.read.parquet(source).write.mode("errorifexists").parquet(target)
