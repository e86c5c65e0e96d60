"""A streaming source of what happens to files: created, modified, renamed and deleted.

``register(spark)``, then ``spark.readStream.format("file_changes").options(root=..., state=...).load()``. An offset is the name of a
listing, a Parquet file in ``state`` that is called after what it holds; a batch is the difference of two listings. So a folder in which
nothing has changed makes no batch, and a query that is started again goes on from the listing of its last batch and repeats nothing.

Rows are (kind, path, previous, length, modified): previous is the old path of a renamed file, else null. A file that came and one that went
count as one renamed file where they are the only ones of their length and time of change. Options: root and state, as URIs that
every executor reaches (state must not lie below root); parts, into how many tasks a batch is dealt (4); every task reads both listings.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "kind string, path string, previous string, length long, modified timestamp"
_LISTING = pa.schema([("path", pa.string()), ("length", pa.int64()), ("modified", pa.timestamp("us", "UTC"))])


def _at(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class Part(InputPartition):
    def __init__(self, before: str, after: str, number: int):
        self.before, self.after, self.number = before, after, number


class ChangeReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.state, self.parts = options["root"], options["state"].rstrip("/"), int(options.get("parts", 4))

    def initialOffset(self) -> dict:
        return {"listing": ""}

    def latestOffset(self) -> dict:
        source, root = _at(self.root)
        found = sorted((f.path, f.size, f.mtime) for f in source.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)) if f.type == pafs.FileType.File)
        table = pa.table([pa.array(c, t) for c, t in zip(list(zip(*found, strict=True)) or [[], [], []], _LISTING.types, strict=True)], schema=_LISTING)
        name = hashlib.sha256(repr([(p, n, t.timestamp()) for p, n, t in found]).encode("utf-8", "surrogatepass")).hexdigest()[:32] if found else "empty"
        store, folder = _at(self.state)
        store.create_dir(folder, recursive=True)
        if store.get_file_info(f"{folder}/{name}.parquet").type == pafs.FileType.NotFound:
            pq.write_table(table, f"{folder}/{name}.parquet", filesystem=store)
        return {"listing": name}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return [Part(start["listing"], end["listing"], k) for k in range(self.parts)] if start["listing"] != end["listing"] else []

    def _listing(self, name: str) -> dict[str, tuple]:
        if not name:
            return {}
        store, folder = _at(self.state)
        t = pq.read_table(f"{folder}/{name}.parquet", filesystem=store)
        return {p: (n, m) for p, n, m in zip(*(t.column(c).to_pylist() for c in ("path", "length", "modified")), strict=True)}

    def read(self, part: Part) -> Iterator[tuple]:
        before, after = self._listing(part.before), self._listing(part.after)

        def own(key: object) -> bool:
            return zlib.crc32(repr(key).encode("utf-8", "surrogatepass")) % self.parts == part.number

        came = {p: s for p, s in after.items() if p not in before and own(s)}
        went = {p: s for p, s in before.items() if p not in after and own(s)}
        once = {s for s, n in Counter(came.values()).items() if n == 1} & {s for s, n in Counter(went.values()).items() if n == 1}
        old = {s: p for p, s in went.items() if s in once}
        for p, s in came.items():
            yield ("renamed", p, old[s], *s) if s in once else ("created", p, None, *s)
        for p, s in went.items():
            if s not in once:
                yield "deleted", p, None, *s
        for p, s in after.items():
            if p in before and before[p] != s and own(p):
                yield "modified", p, None, *s

    def commit(self, end: dict) -> None:
        """Listings stay until the state folder is deleted: a batch may be asked for again."""


class FileChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> ChangeReader:
        return ChangeReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FileChanges)
