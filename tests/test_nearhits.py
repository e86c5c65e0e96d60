"""Near-duplicate hits against brute force over all pairs of documents."""

from __future__ import annotations

import random
import re
from collections import Counter

from siltstone.operators.nearhits import likeness, near_hits
from siltstone.plans.catalog import load

from .conftest import DATA


def brute(docs):
    kept, gone = [], []
    for i, t in sorted((i, t) for i, t in docs if i is not None):
        c = Counter(re.findall("[a-z0-9]+", (t or "").lower()))
        hit = next(((k, s) for k, x in kept if (s := likeness(x, c)) > 0.85), None)
        if hit:
            gone.append((hit[0], i, hit[1]))
        else:
            kept.append((i, c))
    return gone


def test_all_documents(spark):
    got = sorted(map(tuple, load()["near_duplicate_hits"].build(spark, DATA).collect()))
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert got == sorted(brute(docs)) and got


def test_keep_first_whatever_source_and_length(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    rows = []
    for _ in range(40):
        t = rng.sample(words, 40)
        for _ in range(8):  # a chain: each is near to the one before, the last ones not to the first
            rows.append((len(rows), " ".join(t)))
            t = t[2:] + rng.sample(words, 2)
    rng.shuffle(rows)
    rows += [(900, rows[0][1]), (901, rows[0][1].upper() + " !" * 70), (902, None), (903, ""), (None, rows[0][1]), (904, "x"), (905, "x")]
    got = near_hits(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute(rows)
    assert sorted(map(tuple, got)) == sorted(want) and len({a for a, *_ in want}) > 40
