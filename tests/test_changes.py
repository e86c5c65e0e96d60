"""The streaming source of file changes: each change once, also over a restart."""

from __future__ import annotations

import os
from pathlib import Path

from siltstone.sources import changes


def put(path: Path, text: str, at: int) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    os.utime(path, (at, at))


def test_changes_are_told_once(spark, tmp_path: Path):
    changes.register(spark)
    root, out = tmp_path / "root", tmp_path / "out"
    root.mkdir()

    def start():
        df = spark.readStream.format("file_changes").options(root=f"file://{root}", state=f"file://{tmp_path}/state", parts="3").load()
        return df.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "check")).start()

    def told():
        if not out.exists():
            return []
        return sorted((r.kind, r.path.split("/root/")[1], r.previous and r.previous.split("/root/")[1], r.length) for r in spark.read.parquet(str(out)).collect())

    put(root / "a.txt", "one", 1000)
    put(root / "sub" / "b.txt", "three", 2000)
    put(root / "c.txt", "same", 3000)
    put(root / "d.txt", "same", 3000)
    q = start()
    q.processAllAvailable()
    first = [("created", "a.txt", None, 3), ("created", "c.txt", None, 4), ("created", "d.txt", None, 4), ("created", "sub/b.txt", None, 5)]
    assert told() == first
    q.stop()

    put(root / "a.txt", "changed", 4000)  # while nobody looks
    (root / "sub" / "b.txt").rename(root / "moved.txt")
    (root / "c.txt").unlink()
    (root / "d.txt").rename(root / "e.txt")  # two of one kind went: not told as renamed
    put(root / "new.txt", "x", 5000)
    second = [("created", "e.txt", None, 4), ("created", "new.txt", None, 1), ("deleted", "c.txt", None, 4), ("deleted", "d.txt", None, 4), ("modified", "a.txt", None, 7), ("renamed", "moved.txt", "sub/b.txt", 5)]
    q = start()
    q.processAllAvailable()
    assert told() == sorted(first + second)
    q.processAllAvailable()  # nothing has happened
    assert told() == sorted(first + second)
    for f in list(root.iterdir()):
        if f.is_file():
            f.unlink()
    q.processAllAvailable()
    q.stop()
    assert len(told()) == len(first + second) + 4 and sum(t[0] == "deleted" for t in told()) == 6
