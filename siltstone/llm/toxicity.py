"""Toxicity by a classifier chain.

Categories are predicted one after another by logistic models over the words of a text; each
model also reads the probabilities that the models before it gave. In training those
probabilities are out-of-fold: the sample is cut into ``FOLDS`` by the least hash of a text's long
words (copies and most near copies share it), and each fold's probabilities come from a model that hasn't
seen it. Texts with the same set of words and the same label count once; all others of the sample stay.
The last link of the chain is the label ``toxic`` itself and decides.

Labels of the earlier categories: a document labelled toxic has a category if it holds one of the
category's seed words. The models themselves learn their words from the sample.

Fitting uses the labelled documents with the smallest hash of their identifier, and of their different
texts at most ``SAMPLE``; every word of them counts. Tokens are words and their beginnings. They are counted on the
executors by category; the ``FEATURES`` tokens that the models read are chosen from these counts by a chi-squared
test against each category. Only a row of ``FEATURES`` bits for each text of the sample goes to the driver, which
fits the models; scoring reads every word of every document, and only the model goes to the executors.

Defined results: a null or empty text has only the models' intercepts; labels that are null are not
used; documents that repeat are scored each; without any labels, or with labels of one kind
only, nothing is toxic and all probabilities are that share.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunked, rows, written

SAMPLE, FEATURES, FOLDS, CHI2, SUPPORT, THRESHOLD = 12_000, 256, 5, 30.0, 4, 0.5
STEMS = (4, 5, 6)
#: Seed words of the categories, in the order of the chain.
SEEDS = {
    "insult": b"idiot moron stupid loser clown fool dumb jerk imbecile idiots morons losers".split(),
    "contempt": b"worthless pathetic trash useless garbage contemptible inferior".split(),
    "loathing": b"scum disgusting filth vile vermin repulsive hate despicable".split(),
}
CHAIN = (*SEEDS, "toxic")
#: Letters of a word: A-Z as a-z, a-z and all bytes beyond ASCII; everything else parts words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> set[bytes]:
    """The distinct words of a text in UTF-8."""
    return set((text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split())


def tokens_of(words: set[bytes]) -> set[bytes]:
    """Words and, for inflected forms, their first STEMS bytes marked with ^."""
    return words.union(*([b"^" + w[:n] for w in words if len(w) > n] for n in STEMS))


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, steps: int = 30) -> np.ndarray:
    """Weights of a ridge logistic model by Newton's method; the last is the intercept."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(x.shape[1])
    share = (y.sum() + 1) / (len(y) + 2)
    w[-1] = np.log(share / (1 - share))
    keep = np.full(len(w), ridge)
    keep[-1] = 1e-3
    for _ in range(steps):
        p = _sigmoid(x @ w)
        grad = x.T @ (p - y) + keep * w
        grad[-1] -= keep[-1] * w[-1]
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Chain:
    """vocabulary: word -> column; weights: a vector for each link, over words, earlier probabilities, 1."""

    def __init__(self, vocabulary: dict[bytes, int], weights: list[np.ndarray]):
        self.vocabulary, self.weights = vocabulary, weights

    def predict(self, x: np.ndarray) -> np.ndarray:
        p = np.zeros((len(x), 0))
        for w in self.weights:
            p = np.concatenate([p, _sigmoid(np.concatenate([x, p], 1) @ w[:-1] + w[-1])[:, None]], 1)
        return p

    def features(self, texts: list[str | None]) -> np.ndarray:
        x = np.zeros((len(texts), len(self.vocabulary)))
        column = self.vocabulary
        known = set(column)
        for i, t in enumerate(texts):
            for w in known.intersection(tokens_of(words_of(t))):
                x[i, column[w]] = 1
        return x


def choose(counts: list[tuple], total: list[int], n: int) -> dict[bytes, int]:
    """Columns of the tokens that speak most for a category.

    counts: (token, documents that hold it, those of them in each category); total: documents in each category."""
    best: list[tuple[float, bytes]] = []
    for w, m, *c in counts:
        score = 0.0
        for have, of in zip(c, total, strict=True):
            if 0 < of < n and have * n > m * of and m < n:
                score = max(score, n * (have * n - m * of) ** 2 / (m * (n - m) * of * (n - of)))
        if score >= CHI2:
            best.append((-score, w))
    return {w: k for k, (_, w) in enumerate(sorted(best)[:FEATURES])}


def fit_chain(vocabulary: dict[bytes, int], x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> tuple[Chain, np.ndarray]:
    """The chain from features, labels of each link and folds; and the out-of-fold probabilities that its links read."""
    n = len(x)
    weights, held = [], np.zeros((n, 0))
    for k in range(len(CHAIN)):
        target = y[:, k]
        both = np.concatenate([x, held], 1)
        if not n or not 0 < target.sum() < n:
            w = np.zeros(both.shape[1] + 1)
            w[-1] = 30.0 if n and target.sum() == n else -30.0
            weights.append(w)
            held = np.concatenate([held, _sigmoid(np.full((n, 1), w[-1]))], 1)
            continue
        weights.append(_fit(both, target))
        own = np.zeros(n)
        for f in range(FOLDS):
            out = fold == f
            if out.any():
                rest = ~out if (~out).any() else out
                w = _fit(both[rest], target[rest])
                own[out] = _sigmoid(both[out] @ w[:-1] + w[-1])
        held = np.concatenate([held, own[:, None]], 1)
    return Chain(vocabulary, weights), held


def sample_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Different labelled texts: t, y (bits of the categories), fold; written."""
    chosen = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("label_id"), "label_id").limit(SAMPLE)
    some = docs.select(F.col("doc_id").cast("long").alias("label_id"), F.col("text").cast("string").alias("t")).join(F.broadcast(chosen), "label_id")  # at most SAMPLE rows of two numbers

    def read(batches):
        for part in chunked(rows(batches, "label_id", "t", "toxic"), lambda r: len(r[1] or "") + 200, 4 << 20):
            out = []
            for i, t, toxic in part:
                ws = sorted(words_of(t), key=lambda w: (zlib.crc32(w), w))
                long = [w for w in ws if len(w) > 6]
                fold = zlib.crc32(long[0] if long else b" ".join(ws)) % FOLDS
                kinds = [toxic and any(s in ws for s in SEEDS[k]) for k in SEEDS] + [toxic]
                out.append((i, t, sum(bool(v) << k for k, v in enumerate(kinds)), fold, hashlib.blake2b(b" ".join(ws), digest_size=16).digest()))
            cols = list(zip(*out, strict=True))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["label_id", "t", "y", "fold", "same"])

    got = some.mapInArrow(read, "label_id long, t string, y int, fold int, same binary")
    # texts with the same words and labels count once (their words and fold are the same); one row a group travels on
    got = got.groupBy("same", "y").agg(F.min("fold").alias("fold"), F.min(F.struct("label_id", "t")).alias("one"))
    return written(got.orderBy(F.xxhash64("one.label_id"), "one.label_id", "same", "y").limit(SAMPLE).select(F.col("one.t").alias("t"), "y", "fold"))


def train(docs: DataFrame, labels: DataFrame) -> Chain:
    """Counts tokens of the labelled sample on the executors, fits on the driver."""
    return trained(docs, labels)[0]


def trained(docs: DataFrame, labels: DataFrame) -> tuple[Chain, np.ndarray, np.ndarray, np.ndarray]:
    """The chain, with the labels, folds and out-of-fold probabilities of the sample."""
    sample = sample_of(docs, labels)
    bits = [F.sum(F.col("y").bitwiseAND(1 << k).cast("boolean").cast("long")) for k in range(len(CHAIN))]
    n, *total = sample.agg(F.count("*"), *[F.coalesce(b, F.lit(0)) for b in bits]).first()
    names = ["token", "n", *(f"n{k}" for k in range(len(CHAIN)))]

    def count(batches):
        seen: dict[bytes, list[int]] = {}

        def told():
            cols = list(zip(*((w, *c) for w, c in seen.items()), strict=True)) or [[]] * len(names)
            seen.clear()
            return pa.record_batch([pa.array(cols[0], pa.binary()), *(pa.array(c, pa.int64()) for c in cols[1:])], names=names)

        for t, y in rows(batches, "t", "y"):
            step = [1, *(y >> k & 1 for k in range(len(CHAIN)))]
            for w in tokens_of(words_of(t)):
                have = seen.get(w)
                seen[w] = step if have is None else [a + b for a, b in zip(have, step, strict=True)]
            if len(seen) > 200_000:
                yield told()
        yield told()

    counted = sample.mapInArrow(count, "token binary, " + ", ".join(f"{c} long" for c in names[1:])).groupBy("token").agg(*[F.sum(c).alias(c) for c in names[1:]])
    last = F.col(names[-1])
    # a candidate stands in SUPPORT texts or more, and at least every second of them is toxic; the best by chi-squared of
    # any category come to the driver
    fit = counted.where((F.col("n") >= SUPPORT) & (2 * last >= F.col("n")))
    gain = [(F.col(f"n{k}") * n - F.col("n") * of) for k, of in enumerate(total)]
    chi = F.greatest(*[F.when((g > 0) & (F.col("n") < n), n * g.cast("double") * g / (F.col("n") * (n - F.col("n")) * of * (n - of)).cast("double")).otherwise(0.0) if 0 < of < n else F.lit(0.0) for g, of in zip(gain, total, strict=True)])
    got = fit.withColumn("chi", chi).where(F.col("chi") >= CHI2).orderBy(F.desc("chi"), "token").limit(FEATURES).collect()
    vocabulary = choose([(bytes(r.token), *(r[c] for c in names[1:])) for r in got], total, n)
    model = Chain(vocabulary, [])

    def mark(batches):
        for part in chunked(rows(batches, "t", "y", "fold"), lambda r: len(r[0] or "") + 200, 4 << 20):
            x = model.features([t for t, *_ in part]).astype(bool)
            yield pa.record_batch([pa.array([np.packbits(r).tobytes() for r in x], pa.binary()), pa.array([y for _, y, _ in part], pa.int32()), pa.array([f for *_, f in part], pa.int32())], names=["x", "y", "fold"])

    marked = sorted((bytes(r.x), r.y, r.fold) for r in sample.mapInArrow(mark, "x binary, y int, fold int").collect())  # at most SAMPLE rows of FEATURES bits
    x = np.array([np.unpackbits(np.frombuffer(b, np.uint8))[: len(vocabulary)] for b, *_ in marked], float).reshape(len(marked), len(vocabulary))
    y = np.array([[v >> k & 1 for k in range(len(CHAIN))] for _, v, _ in marked], float).reshape(len(marked), len(CHAIN))
    fold = np.array([f for *_, f in marked], int)
    chain, held = fit_chain(vocabulary, x, y, fold)
    return chain, y, fold, held


def score(docs: DataFrame, chain: Chain, keep: list[str] | None = None) -> DataFrame:
    """docs with a probability p_<category> for each link and toxic (the last beyond THRESHOLD)."""
    keep = keep or ["doc_id"]
    kept = [f"kept_{k}" for k in range(len(keep))]
    held = docs.select(*[F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)], F.col("text").cast("string").alias("body"))
    schema = ", ".join([f"{k} {docs.schema[c].dataType.simpleString()}" for c, k in zip(keep, kept, strict=True)] + [f"p_{c} double" for c in CHAIN] + ["toxic boolean"])

    def run(batches):
        for b in batches:
            at, step = 0, max(1, min(2048, (8 << 20) * b.num_rows // max(1, b.nbytes)))
            body = b.schema.get_field_index("body")
            while at < b.num_rows:
                part = b.slice(at, step)
                at += step
                p = chain.predict(chain.features(part.column(body).to_pylist()))
                cols = [part.column(part.schema.get_field_index(k)) for k in kept] + [pa.array(p[:, k]) for k in range(len(CHAIN))] + [pa.array(p[:, -1] >= THRESHOLD)]
                yield pa.RecordBatch.from_arrays(cols, names=[*kept, *(f"p_{c}" for c in CHAIN), "toxic"])

    out = held.mapInArrow(run, schema)
    return out.select(*[F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)], *(f"p_{c}" for c in CHAIN), "toxic")


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the chain doesn't find toxic, with their columns."""
    chain = train(docs, labels)
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["text"])
    return score(row, chain, ["row"]).where(~F.col("toxic")).select("row.*")


def op2_toxicity_chain(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, train(docs, labels))
