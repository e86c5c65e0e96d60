"""Shared plumbing: the shared folder, written tables, remote files, Arrow batches."""

from __future__ import annotations

import atexit
import os
import tempfile
import threading
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

_threads = threading.local()
_lists: list[list[tuple[SparkSession, str]]] = []


def _made() -> list[tuple[SparkSession, str]]:
    """The folders made in this thread; operators in other threads of the driver have lists of their own."""
    if not hasattr(_threads, "made"):
        _threads.made = []
        _lists.append(_threads.made)
    return _threads.made


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which every executor can reach.

    Where the setting is absent, a local session gets a folder of its own under the
    machine's temp folder; a cluster session without the setting is an error, because
    executors could not read what others wrote."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/siltstone-{os.getuid()}"
        spark.sparkContext.setCheckpointDir(base)
    out = f"{qualified(spark, base).rstrip('/')}/siltstone-{uuid.uuid4().hex}"
    _made().append((spark, out))
    return out


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder as a URI; one without a scheme lies in the cluster's default file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    uri = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in [m for made in _lists for m in made]:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session is already gone
            return


def written(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read back: cuts lineage, survives lost executors."""
    folder = shared_dir(df.sparkSession)
    df.write.parquet(f"{folder}/table")
    table = df.sparkSession.read.schema(df.schema).parquet(f"{folder}/table")
    table.folder_of_table = folder
    return table


def mark() -> int:
    """What has been written up to here in this thread; for ``drop_since``."""
    return len(_made())


def drop_since(at: int, *keep: DataFrame) -> None:
    """Deletes the folders made in this thread since mark(), but for those of the tables ``keep``, which ``written`` returned.

    Only for what no table still in use reads."""
    own = {df.folder_of_table for df in keep}
    made = _made()
    for spark, path in made[at:]:
        if path not in own:
            _delete(spark, path)
    made[at:] = [m for m in made[at:] if m[1] in own]


def collected(manifest: DataFrame) -> DataFrame:
    """A list of files, run once: a short row for each file of tens of MB, never for each document."""
    spark = manifest.sparkSession
    return spark.createDataFrame([tuple(r) for r in manifest.collect()], manifest.schema)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI (file, hdfs, s3, gs, abfs) and the path in it; usable on executors."""
    return pafs.FileSystem.from_uri(uri)


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def rows(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of the named columns, a few MB of Python objects at a time."""
    for b in batches:
        cols = [b.column(b.schema.get_field_index(n)) for n in names]
        step = max(1, min(1024, 1024 * 1024 * 8 // max(1, b.nbytes // max(1, b.num_rows))))
        for at in range(0, b.num_rows, step):
            yield from zip(*(c.slice(at, step).to_pylist() for c in cols), strict=True)


def chunked(items: Iterable, weight, limit: int) -> Iterator[list]:
    """Lists of consecutive items of about limit weight."""
    out, size = [], 0
    for x in items:
        out.append(x)
        size += weight(x)
        if size >= limit:
            yield out
            out, size = [], 0
    if out:
        yield out
