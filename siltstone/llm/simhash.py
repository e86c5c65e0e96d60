"""SimHash near-duplicates by anchor-point covering.

Fingerprints have 64 bits; two are linked if at most 4 bits differ. The bits are laid out in blocks of 24, 24
and 16 bits, which share the threshold as 1, 1 and 0: whoever differs in more than that in every block differs
in at least 2 + 2 + 1 = 5 bits. Each block has a covering code, whose words are the anchors:

* 24 bits: a Hamming code of 15 bits, one of 7 and 2 free bits; covering radius 1 + 1 + 0 = 2, 2^17 anchors;
* 16 bits: every point, radius 0, 2^16 anchors.

A fingerprint is at home at its nearest anchor, which lies within the radius, and is replicated to every anchor
that can be home to a fingerprint within the block's threshold: those within radius plus threshold, where what
the distance exceeds the radius by counts for each part of the code by itself (at most 13 of a block of 24 bits).
Each anchor's homes are then compared with all that came there, on all 64 bits.

1. Texts give fingerprints; equal ones form a class, so a hot fingerprint is one row for each task before the shuffle.
2. Classes are replicated and dealt by anchor. An anchor with more than ``LIMIT`` rows is split by bits that the
   block hasn't used: cut in five, at least one of the five is equal in two linked fingerprints. That is done again
   for what is still too large.
3. An anchor's links are given as a spanning forest. Components are joined over all anchors by rounds of joins.

Defined results: words and shingles as stated by ``fingerprints``; texts without words have fingerprint zero and are
linked like any other; rows are documents each, also those of one doc_id; a null doc_id has a fingerprint, is
linked with nothing and has a null component. Other columns are left alone; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunked, rows, width, written
from .components import connected_components
from .neardup import _forest
from .texthash import LOWER, mix

SHINGLE, SEED, MOST = 4, 42, 4
LIMIT, PAIRS, SMALL, WORK = 1 << 18, 1 << 21, 1024, 1 << 28
SPLITS = 4
STRETCH = 1 << 20
_U = np.uint64
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: First bit and width of each block.
BLOCKS = ((0, 24), (24, 24), (48, 16))


def _word_runs(data: bytes, size: int):
    """Runs of consecutive words of about STRETCH bytes that share size - 1 words; the last may be a short text's only words."""
    at, held, given = 0, [], False
    while at < len(data):
        gap = _SPACE.search(data, min(len(data), at + STRETCH))
        end = gap.start() if gap else len(data)
        held += data[at:end].split()
        at = end
        if len(held) >= size:
            yield held
            held, given = held[1 - size :] if size > 1 else [], True
    if held and not given:
        yield held


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """SimHash of a whole text: A-Z are lower-cased, words are [^\\x20\\x09-\\x0D]+, their shingles, repeats included, are
    joined by spaces and hashed by XXH64 with seed 42. A text of fewer words is one shingle, one of none has zero."""
    from xxhash import xxh64_intdigest as h

    ones, n = np.zeros(64, np.int64), 0
    for run in _word_runs((text or "").encode("utf-8", "surrogatepass").translate(LOWER), size):
        joined = b" ".join(run)
        ends = np.cumsum(np.fromiter(map(len, run), np.int64, len(run)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        last = ends[size - 1 :] if len(run) >= size else ends[-1:]
        hashes = np.array([h(joined[a:b], SEED) for a, b in zip(starts.tolist(), last.tolist(), strict=False)], "<u8")
        for at in range(0, len(hashes), 1 << 16):
            bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.uint32)
        n += len(hashes)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of each row; fp has the 64 bits as a signed number."""

    def run(batches):
        for part in chunked(rows(batches, "doc_id", "text"), lambda r: len(r[1] or "") + 200, 1 << 21):
            fps = np.array([fingerprint(t, size) for _, t in part], _U)
            yield pa.record_batch([pa.array([i for i, _ in part], pa.int64()), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


class Hamming:
    """The perfect code of 2^m - 1 bits: place p (from 0) has the parity column p + 1."""

    def __init__(self, m: int):
        self.n, size = (1 << m) - 1, 1 << m
        x = np.arange(1 << self.n)
        self.syndrome = np.zeros(1 << self.n, np.int64)
        for p in range(self.n):
            self.syndrome ^= np.where(x >> p & 1, p + 1, 0)
        #: By syndrome: what takes a word to its own code word, then to those at distance 2 (-1: none).
        self.steps = np.full((size, size // 2), -1, np.int64)
        for s in range(size):
            self.steps[s, 0] = 1 << (s - 1) if s else 0
            pairs = [(a, a ^ s) for a in range(1, size) if s and a < a ^ s]
            self.steps[s, 1 : 1 + len(pairs)] = [1 << (a - 1) | 1 << (b - 1) for a, b in pairs]

    def anchors(self, x: np.ndarray) -> np.ndarray:
        """For each word its own anchor and those one step beyond the radius; -1 where there is none."""
        step = self.steps[self.syndrome[x]]
        return np.where(step < 0, -1, x[:, None] ^ step)


_LONG, _SHORT = Hamming(4), Hamming(3)


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, home) of the anchors of fingerprints (unsigned); a key tells block and anchor."""
    row, key, home = [], [], []
    for block, (at, bits) in enumerate(BLOCKS):
        x = (fp >> _U(at) & _U((1 << bits) - 1)).astype(np.int64)
        if bits == 16:
            found = x[:, None]
        else:
            a, b, free = _LONG.anchors(x & 0x7FFF), _SHORT.anchors(x >> 15 & 0x7F), x >> 22
            own = a[:, :1] | b[:, :1] << 15 | free[:, None] << 22
            far_a = np.where(a[:, 1:] < 0, -1, a[:, 1:] | own & ~0x7FFF)
            far_b = np.where(b[:, 1:] < 0, -1, b[:, 1:] << 15 | own & ~(0x7F << 15))
            found = np.concatenate([own, far_a, far_b, own ^ (1 << 22), own ^ (1 << 23)], axis=1)
        r, c = np.nonzero(found >= 0)
        row.append(r)
        key.append(found[r, c] | block << 32)
        home.append(c == 0)
    return np.concatenate(row), np.concatenate(key), np.concatenate(home)


_ROW = "key long, used long, fp long, home boolean"
_MASKS = np.array([((1 << bits) - 1) << at for at, bits in BLOCKS], _U)


def _batch(key, used, fp, home):
    return pa.record_batch([pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (key, used, fp)] + [pa.array(home)], names=["key", "used", "fp", "home"])


def _arrays(batch):
    return tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns))


def _fifths(used: int) -> list[int]:
    """Masks of the bits that are free yet, cut in MOST + 1."""
    free = [k for k in range(64) if not used >> k & 1]
    return [sum(1 << k for k in part.tolist()) for part in np.array_split(np.array(free, np.int64), MOST + 1) if len(part)] if len(free) > MOST else []


def replicated(classes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(key, used, fp, home): classes(fp) at each of their anchors, those with more than limit rows split."""

    def deal(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(_U)
            for at in range(0, len(fp), 1 << 15):
                own = fp[at : at + (1 << 15)]
                row, key, home = anchors(own)
                yield _batch(key, _MASKS[key >> 32], own[row], home)

    def split(batches):
        for b in batches:
            key, used, fp, home = _arrays(b)
            for u in np.unique(used):
                k = np.flatnonzero(used == u)
                for mask in _fifths(int(u) % (1 << 64)):
                    m = _U(mask)
                    yield _batch(mix(mix(key[k].view(_U) ^ m) ^ (fp[k].view(_U) & m)), np.full(len(k), u).view(_U) | m, fp[k], home[k])

    done, now = None, classes.select("fp").mapInArrow(deal, _ROW)
    for _ in range(SPLITS):
        hot = written(now.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("key"))
        if hot.isEmpty():
            break
        rest = now.join(hot, "key", "left_anti")
        done = rest if done is None else done.union(rest)
        now = written(now.join(hot, "key", "left_semi").select("key", "used", "fp", "home").mapInArrow(split, _ROW))
    return now if done is None else done.union(now)


def _close(fp: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp[a] ^ fp[b]) <= MOST


def _spread(fp: np.ndarray, home: np.ndarray) -> list[tuple[int, int]]:
    """Breadth-first over one anchor's rows: whatever holds a home is searched until all of it is reached."""
    out, left = [], np.arange(len(fp))
    for start in np.flatnonzero(home):
        at = np.searchsorted(left, start)
        if at == len(left) or left[at] != start:
            continue
        left, queue = np.delete(left, at), [int(start)]
        while queue and len(left):
            u = queue.pop()
            near = np.bitwise_count(fp[left] ^ fp[u]) <= MOST
            if near.any():
                got = left[near].tolist()
                out += [(u, v) for v in got]
                queue += got
                left = left[~near]
    return out


def _large(fp: np.ndarray, home: np.ndarray, used: int) -> list[np.ndarray]:
    """Links within one large anchor, as (2, n) arrays of its rows' numbers."""
    work, parts = int(home.sum()) * len(fp), []
    if work > WORK:
        for mask in _fifths(used):
            value = fp & _U(mask)
            order = np.argsort(value, kind="stable")
            edge = np.flatnonzero(np.concatenate([[True], value[order][1:] != value[order][:-1], [True]]))
            parts += [order[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True) if b - a > 1]
        if _fifths(used) and sum(int(home[p].sum()) * len(p) for p in parts) < work // 4:
            return [p[x] for p in parts if home[p].any() for x in _large(fp[p], home[p], (1 << 64) - 1)]
    return [np.array(x, np.int64).reshape(-1, 2).T for x in [_spread(fp, home)]]


def _linked(key: np.ndarray, used: np.ndarray, fp: np.ndarray, home: np.ndarray):
    """A spanning forest (a, b) of the links in whole anchors; rows are in the order of their keys."""
    fp = fp.view(_U)
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    start, size = edge[:-1], np.diff(edge)
    found = []
    of = np.repeat(np.arange(len(start)), size)
    asks = np.flatnonzero(home & (size[of] <= SMALL) & (size[of] > 1))
    ends = np.cumsum(size[of[asks]])
    done = 0
    while done < len(asks):
        base = ends[done - 1] if done else 0
        stop = max(done + 1, int(np.searchsorted(ends, base + PAIRS, side="right")))
        own, n = asks[done:stop], size[of[asks[done:stop]]]
        a = np.repeat(own, n)
        b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[of[own]], n)
        k = np.flatnonzero(_close(fp, a, b) & (a != b))
        found.append(np.stack([a[k], b[k]]))
        done = stop
    for g in np.flatnonzero(size > SMALL):
        s = slice(start[g], start[g] + size[g])
        if home[s].any():
            found += [x + start[g] for x in _large(fp[s], home[s], int(used[start[g]]) % (1 << 64))]
    pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    if not pairs.shape[1]:
        return None
    ids, root = _forest(fp[pairs[0]].view(np.int64), fp[pairs[1]].view(np.int64))
    return pa.record_batch([pa.array(root[root != ids]), pa.array(ids[root != ids])], names=["a", "b"])


def links(classes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Links (a, b) between fingerprints of classes(fp) whose components are those of all links."""

    def meet(batches):
        held, n = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(_arrays(b))
            n += b.num_rows
            if n < 1 << 18 or held[0][0][0] == held[-1][0][-1]:
                continue
            whole = tuple(map(np.concatenate, zip(*held, strict=True)))
            cut = int(np.searchsorted(whole[0], whole[0][-1]))  # the last anchor may go on
            out = _linked(*(x[:cut] for x in whole))
            held, n = [tuple(x[cut:] for x in whole)], len(whole[0]) - cut
            if out is not None:
                yield out
        if held and (out := _linked(*map(np.concatenate, zip(*held, strict=True)))) is not None:
            yield out

    parts = width(classes.sparkSession)
    return replicated(classes, limit).repartition(parts, "key").sortWithinPartitions("key").mapInArrow(meet, "a long, b long")


def near_duplicates(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, fingerprint, component_id."""
    own = written(fingerprints(docs))
    classes = written(own.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    joined = connected_components(links(classes, limit))
    group = F.coalesce("component", "fp")
    told = written(classes.join(joined, classes["fp"] == joined["id"], "left").select("fp", "rep", group.alias("group")))
    least = told.groupBy("group").agg(F.min("rep").alias("component_id"))
    by_fp = told.join(least, "group").select("fp", "component_id")
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return own.join(by_fp, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), component.alias("component_id"))


def op13_anchor_covered_simhash(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
