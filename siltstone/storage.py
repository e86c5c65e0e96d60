"""Folders for checkpoints and tables that a job writes for itself, and small files in them."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in a local session without it, a folder below the temp folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/siltstone-scratch"
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the root."""
    return f"{root(spark)}/{name}-{uuid.uuid4().hex}"


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def listed(spark: SparkSession, folder: str) -> list[str]:
    """What lies in a folder, in order; nothing where there is none."""
    p, fs = _at(spark, folder)
    return sorted(s.getPath().toString() for s in fs.listStatus(p)) if fs.exists(p) else []


def stamped(spark: SparkSession, files: Iterable[str]) -> list[tuple[str, int, int]]:
    """(file, size, time of change), by one listing of each folder that holds some of them."""
    wanted = set(files)
    out = []
    for folder in sorted({f.rsplit("/", 1)[0] for f in wanted}):
        p, fs = _at(spark, folder)
        for s in fs.listStatus(p):
            name = s.getPath().getName()
            if any(x in wanted for x in (f"{folder}/{name}", s.getPath().toUri().toString())):
                out.append((f"{folder}/{name}", s.getLen(), s.getModificationTime()))
    return sorted(out)


def read(spark: SparkSession, path: str) -> str:
    p, fs = _at(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create(spark: SparkSession, path: str, text: str) -> None:
    """A new file; fails where there is one of the name."""
    p, fs = _at(spark, path)
    stream = fs.create(p, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _at(spark, path)
    fs.delete(p, True)


def delete_at_exit(spark: SparkSession, path: str) -> None:
    def run() -> None:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the session is already gone
            return

    atexit.register(run)


class Tables:
    """Tables that one operator writes for itself, deleted when it is done, whatever runs beside it.

    As a context; what ``release`` gives back stays until the session ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.n = spark, scratch(spark, name), 0
        self.places: set[str] = set()
        self.released: set[str] = set()

    def __enter__(self) -> Tables:
        return self

    def write(self, df: DataFrame) -> DataFrame:
        """df as Parquet, read again: cuts its lineage and survives lost executors."""
        path = f"{self.folder}/{self.n}"
        self.n += 1
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.places.add(path)
        table.written_at = path
        return table

    def forget(self, *keep: DataFrame) -> None:
        """Deletes all tables but those to keep."""
        stay = {t.written_at for t in keep} | self.released
        for path in self.places - stay:
            delete(self.spark, path)
        self.places &= stay

    def release(self, table: DataFrame) -> DataFrame:
        self.released.add(table.written_at)
        return table

    def __exit__(self, *error) -> None:
        self.forget()
        if self.released:
            delete_at_exit(self.spark, self.folder)
        else:
            delete(self.spark, self.folder)
