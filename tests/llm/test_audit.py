"""The filter audit against plain loops over every order, and against SQL (test_llm.py)."""

from __future__ import annotations

import itertools
import re

from siltstone.llm import filteraudit


def by_loops(rows, labels):
    """Each order applied left to right to (doc_id, source, text) rows, by its definition."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    docs = []
    for i, s, t in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        repeat = i is not None and any(j is not None and j < i and (u or "") == t for j, _, u in rows)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t), "E": repeat}
        docs.append((s or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shapley[f] += len(gone)
                fail = [d for d in own if f in d[1]]
                out[part, order, step] = [len(left), len(gone), len(fail) - len(gone), sum(d[1] == {f} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def test_audit(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [
        (1, "a", long), (2, "b", long), (2, "b", long), (3, "a", "SHOUT #1 " * 40), (4, None, None), (5, "", ""), (6, "a", "x \x1c y　z"), (None, "a", long), (7, None, "same " * 70),
        (8, "c", "ÉTÉ " + long.upper()), (9, "a", "100% " + long), (10, "a", "a\tb\x0bc\x0cd\r\ne " * 15), (12, "b", "w " * 200_000), (12, "c", "w " * 200_000), (None, "c", "w " * 200_000), (11, "b", "100% " + long),
    ]
    labels = [(1, 1, 0), (1, 0, 0), (3, 0, 1), (4, None, 1), (None, 1, 1), (9, 1, None), (12, 1, 1), (99, 1, 1)]
    docs = spark.createDataFrame([(*r, 5, "m", 7, 8) for r in rows], "doc_id long, source string, text string, mask int, part string, first int, n int")
    said = spark.createDataFrame([(*r, 1) for r in labels], "doc_id long, quality int, toxic int, good int")
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in filteraudit.audited(filteraudit.mask_cells(docs.repartition(3), said)).collect()}
    assert got == by_loops(rows, labels)
    assert {k[0] for k in got} == {"", "a", "b", "c"} and len(got) == 4 * 600
    bare = filteraudit.audited(filteraudit.mask_cells(docs, said.limit(0))).where("good_lost + toxic_lost > 0")
    assert bare.isEmpty() and filteraudit.audited(filteraudit.mask_cells(docs.limit(0), said)).isEmpty()


def test_every_order_is_a_swap_away():
    for n in range(1, 6):
        order, seen = list(range(n)), {tuple(range(n))}
        for k in filteraudit.transpositions(n):
            order[k], order[k + 1] = order[k + 1], order[k]
            seen.add(tuple(order))
        assert len(seen) == len(filteraudit.transpositions(n)) + 1 == len(list(itertools.permutations(range(n))))
