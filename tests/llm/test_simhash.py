"""SimHash by anchors against all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from siltstone.llm import simhash

from ..conftest import DATA


def by_hand(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def components(rows):
    """rows (id, fingerprint) -> {(id, fingerprint, component)} by all pairs."""
    at = list(range(len(rows)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i, (a, f) in enumerate(rows):
        for j, (b, g) in enumerate(rows[:i]):
            if a is not None and b is not None and (f ^ g).bit_count() <= 4:
                at[root(i)] = root(j)
    least = {}
    for i, (a, _) in enumerate(rows):
        if a is not None:
            least[root(i)] = min(a, least.get(root(i), a))
    return sorted(((a if a is not None else -1), f"{f:016x}", least[root(i)] if a is not None else -1) for i, (a, f) in enumerate(rows))


def answered(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id if r.component_id is not None else -1) for r in df.collect())


def test_fingerprints(monkeypatch):
    texts = ["", None, " \n", "one", "One TWO three", "a b c d", "a b c d e", "É é a b c", "x\x1cy z　w v u", "the same " * 50, " ".join(f"w{k % 17} {k}" for k in range(900)), "long" * 500 + " a b c " + "long" * 500]
    want = [by_hand(t) for t in texts]
    assert [simhash.fingerprint(t) for t in texts] == want and want[0] == want[1] == 0
    monkeypatch.setattr(simhash, "STRETCH", 50)  # texts in many stretches
    assert [simhash.fingerprint(t) for t in texts] == want


def test_equals_the_hash_of_spark(spark):
    from pyspark.sql import functions as F

    assert spark.range(1).select(F.xxhash64(F.lit("one two three é"))).first()[0] % (1 << 64) == xxhash.xxh64_intdigest("one two three é".encode(), 42)


def test_linked_fingerprints_meet():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 4000, dtype=np.uint64)
    b = a.copy()
    for k in range(4000):
        for p in rng.choice(64, rng.integers(0, 5), replace=False):
            b[k] ^= np.uint64(1 << int(p))
    ra, ka, ha = simhash.anchors(a)
    rb, kb, _ = simhash.anchors(b)
    at_home = set(zip(ra[ha].tolist(), ka[ha].tolist(), strict=True))
    met = {r for r, k in zip(rb.tolist(), kb.tolist(), strict=True) if (r, k) in at_home}
    assert met == set(range(4000))
    assert np.bincount(ra).max() <= 27 and ha.sum() == 3 * 4000


def test_anchors_cover():
    for code, n in ((simhash._LONG, 15), (simhash._SHORT, 7)):
        x = np.arange(1 << n)
        own = code.anchors(x)[:, 0]
        assert np.bitwise_count((x ^ own).astype(np.uint64)).max() == 1 and len(np.unique(own)) == 1 << n >> (4 if n == 15 else 3)


@pytest.mark.parametrize(("limit", "small"), [(1 << 18, 1024), (40, 1024), (40, 8)])
def test_near_duplicates(spark, monkeypatch, limit, small):
    monkeypatch.setattr(simhash, "SMALL", small)
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefghij") + str(rng.randint(0, 300)) for _ in range(rng.choice((3, 30, 300)))) for _ in range(25)]
    texts = ["", None, " ", "one", "ONE", "a b c"] + base + base[:4]
    for t in base:  # chains and clouds of near copies
        w = t.split()
        for _ in range(8):
            w[rng.randrange(len(w))] = "new" + str(rng.randint(0, 9))
            texts.append(" ".join(w))
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[8]), (None, "alone here"), (3, texts[10]), (5, "another text of an id that is taken")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "x", True) for r in rows], "doc_id long, text string, fp int, key string, home boolean")
    want = components([(i, by_hand(t)) for i, t in rows])
    assert answered(simhash.near_duplicates(df.repartition(3), limit)) == want
    assert len({x[2] for x in want}) < len({x[1] for x in want})


def test_clouds_of_fingerprints(spark, monkeypatch):
    """Anchors that are split again and again, and large ones searched by their own bits."""
    rng = random.Random(8)
    fps = [rng.getrandbits(64) for _ in range(300)]
    for centre in (0, (1 << 64) - 1, rng.getrandbits(64)):
        for _ in range(250):
            x = centre
            for _ in range(rng.randint(0, 9)):
                x ^= 1 << rng.randrange(64)
            fps.append(x)
    monkeypatch.setattr(simhash, "SMALL", 16)
    monkeypatch.setattr(simhash, "WORK", 5000)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in set(fps)], "fp long")
    want = sorted({x[1:] for x in components([(f, f) for f in set(fps)])})
    for limit in (1 << 18, 100):
        found = {r.id % (1 << 64): r.component for r in simhash.connected_components(simhash.links(df, limit)).collect()}
        groups: dict = {}
        for f in set(fps):
            groups.setdefault(found.get(f, f), []).append(f)
        assert sorted((f"{f:016x}", min(g)) for g in groups.values() for f in g) == want


def test_empty_and_given_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert simhash.near_duplicates(docs.limit(0)).isEmpty()
    rows = [(r.doc_id, by_hand(r.text)) for r in docs.collect()]
    assert answered(simhash.near_duplicates(docs)) == components(rows)
