"""Tables of operators that run side by side."""

from __future__ import annotations

import threading

from siltstone.llm.common import drop_since, mark, written


def test_two_threads_delete_their_own(spark):
    wrote, go, rows = threading.Event(), threading.Event(), []

    def other():
        start = mark()
        table = written(spark.range(7))
        wrote.set()
        go.wait(60)
        rows.append(table.count())
        drop_since(start)

    t = threading.Thread(target=other)
    start = mark()
    first = written(spark.range(3))
    t.start()
    assert wrote.wait(60)
    second = written(spark.range(4))
    drop_since(start, second)
    go.set()
    t.join()
    assert rows == [7] and second.count() == 4 and first.folder_of_table != second.folder_of_table
    drop_since(start)
