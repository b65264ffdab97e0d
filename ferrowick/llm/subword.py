"""Supervised subword embeddings for document quality.

A document is the mean of its words' vectors; a word's vector is the mean of the learned vectors
of its hashed byte n-grams and of the whole word, and of the pair it makes with the word before
it when the two are the same. A softmax over the mean gives the classes. Training is plain
numpy gradient descent on a bounded sample of labelled rows. For scoring, the softmax's weights
are multiplied into the vectors once, so a word costs one cached number.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .caches import worker_cache

BUCKETS, LOW, HIGH, DIM = 1 << 18, 3, 5, 8
TRAIN_ROWS = 2000
REPEAT = 0  # the bucket of a word that repeats the one before it


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint32(15))
    h = h * np.uint32(0x2C1B3C6D)
    return h ^ (h >> np.uint32(12))


def subwords(words: list[bytes], buckets: int = BUCKETS, low: int = LOW, high: int = HIGH) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every hashed feature: the n-grams of <word> and the word itself."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = np.frombuffer(b"<" + b"><".join(words) + b">", np.uint8).astype(np.uint32)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(data))  # bytes from here to the word's end
    ids, feats = [np.arange(len(words))], [_mix(np.fromiter(map(zlib.crc32, words), np.uint32, len(words)))]
    h = np.zeros(len(data), np.uint32)
    for n in range(1, high + 1):
        h = h[: len(data) - n + 1] * np.uint32(0x01000193) + data[n - 1 :] if n > 1 else data + np.uint32(1)
        if n >= low:
            ok = np.flatnonzero(left[: len(h)] >= n)
            ids.append(owner[ok])
            feats.append(_mix(h[ok] + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)))
        if len(data) <= n:
            break
    # bucket 0 is kept for repeats
    return np.concatenate(ids), np.concatenate(feats).astype(np.int64) % (buckets - 1) + 1


class WordValues:
    """A bounded cache from words to numbers; ``learn`` gives the numbers of new words."""

    def __init__(self, learn: Callable[[list[bytes]], np.ndarray], most: int = 400_000):
        self.learn, self.most = learn, most
        self.index: dict[bytes, int] = {}
        self.values = np.zeros(1 << 12)

    def of(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """For each list of words, their places in ``values``."""
        if len(self.index) > self.most:
            self.index = {}
        seen: set[bytes] = set()
        for words in texts:
            seen.update(words)
        if new := [w for w in seen if w not in self.index]:
            at = len(self.index)
            if at + len(new) > len(self.values):
                self.values = np.concatenate([self.values[:at], np.zeros(max(len(new), len(self.values)))])
            self.values[at : at + len(new)] = self.learn(new)
            self.index.update(zip(new, range(at, at + len(new)), strict=True))
        get = self.index.__getitem__
        return [np.fromiter(map(get, words), np.int64, len(words)) for words in texts]


def _vector(words: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """A document as (buckets, weights): the mean over its units of the mean over a unit's features."""
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    names, places, counts = np.unique(np.array(words, object), return_inverse=True, return_counts=True)
    ids, feats = subwords(list(names), buckets)
    per_word = np.bincount(ids, minlength=len(names))
    repeats = int((places[1:] == places[:-1]).sum())
    feats = np.append(feats, REPEAT)
    weights = np.append((counts / per_word)[ids], repeats) / (len(words) + repeats)
    f, back = np.unique(feats, return_inverse=True)
    return f.astype(np.int32), np.bincount(back, weights=weights).astype(np.float32)


class SubwordModel:
    """Softmax over mean subword vectors; ``fit`` runs stochastic gradient descent in numpy."""

    def __init__(self, buckets: int = BUCKETS, dim: int = DIM, classes: int = 2, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.buckets = buckets
        self.embed = rng.normal(0, 1 / dim, (buckets, dim)).astype(np.float32)
        self.out = rng.normal(0, 0.3, (dim, classes)).astype(np.float32)
        self.bias = np.zeros(classes, np.float32)

    def fit(self, texts: list[str | None], labels: list[int], epochs: int = 8, rate: float = 1.0, seed: int = 7) -> SubwordModel:
        docs = [_vector((t or "").encode("utf-8", "surrogatepass").split(), self.buckets) for t in texts]
        rng = np.random.default_rng(seed)
        steps, step = max(1, epochs * len(docs)), 0
        for _ in range(epochs):
            for i in rng.permutation(len(docs)):
                lr = rate * (1 - step / steps)
                step += 1
                f, w = docs[i]
                rows = self.embed[f]
                mean = w @ rows
                z = mean @ self.out + self.bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[labels[i]] -= 1
                back = self.out @ p
                self.out -= lr * 0.2 * np.outer(mean, p)
                self.bias -= lr * 0.2 * p
                # features of a mean get small shares; scale by their number so that rare ones learn too
                self.embed[f] = rows - lr * np.sqrt(len(f)) * np.outer(w, back)
        return self

    def folded(self) -> tuple[np.ndarray, float]:
        """A number for each bucket, and the bias, of the log-odds of class 1 against class 0."""
        return self.embed @ (self.out[:, 1] - self.out[:, 0]), float(self.bias[1] - self.bias[0])


def held_out(key: Column, mod: int, remainder: int) -> Column:
    """crc32(key as text) mod ``mod`` is ``remainder``; false for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % mod == remainder, F.lit(False))


def thinned(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About twice ``rows`` of df's rows by a hash of the key, the same at every run, so that no task is sent
    ``rows`` from every other; all of them where there are no more."""
    n = df.count()
    if n <= 2 * rows + 1000:
        return df
    share = (2 * rows + 1000) / n
    return df.where(F.xxhash64(F.lit(5), F.col(key)) < int((2 * share - 1) * 2**63))


def text_sample(docs: DataFrame, key: str, text: str, rows: int) -> list[str | None]:
    """The texts of at most ``rows`` rows with a key, the same at every run; only keys are ordered."""
    docs = docs.where(F.col(key).isNotNull())
    few = thinned(docs.select(key), key, rows).orderBy(F.xxhash64(F.lit(5), F.col(key)), F.col(key)).limit(rows).distinct()
    got = docs.select(F.col(key), F.col(text).cast("string").alias("_text")).join(F.broadcast(few), key)
    return [r[0] for r in got.orderBy(F.xxhash64(F.lit(5), F.col(key)), F.col(key), F.col("_text")).limit(rows).select("_text").toLocalIterator()]


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, take: Column, rows: int) -> list:
    """At most ``rows`` labelled rows (text, label), the same at every run; ``rows`` bounds what reaches the driver.

    The sample is drawn from the labels alone, so only its ids meet the texts.
    """
    ids = thinned(labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & take), key, rows).groupBy(key).agg(F.min(label).alias("_label"))
    ids = ids.orderBy(F.xxhash64(F.lit(5), F.col(key)), F.col(key)).limit(rows)
    picked = docs.select(F.col(key), F.col(text).cast("string").alias("_text")).join(F.broadcast(ids), key)
    got = picked.orderBy(F.xxhash64(F.lit(5), F.col(key)), F.col(key), F.col("_text")).limit(rows)
    return [(r["_text"], int(r["_label"])) for r in got.select("_text", "_label").toLocalIterator()]


def scorer(table: np.ndarray, bias: float) -> Callable[[list[str | None]], list[float]]:
    """Scores of lists of texts, through a cache of word values."""
    table = table.astype(np.float64)

    def learn(words: list[bytes]) -> np.ndarray:
        ids, feats = subwords(words, len(table))
        return np.bincount(ids, table[feats], len(words)) / np.bincount(ids, minlength=len(words))

    cache = WordValues(learn)

    def score(texts: list[str | None]) -> list[float]:
        out = []
        for at in range(0, len(texts), 128):  # so many texts are split into words at a time
            for places in cache.of([(t or "").encode("utf-8", "surrogatepass").split() for t in texts[at : at + 128]]):
                repeats = int((places[1:] == places[:-1]).sum())
                z = bias + ((cache.values[places].sum() + repeats * table[REPEAT]) / (len(places) + repeats) if len(places) else 0.0)
                out.append(float(1 / (1 + np.exp(-np.clip(z, -60, 60)))))
        return out

    return score


def score_subwords(df: DataFrame, table: np.ndarray, bias: float, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score): the softmax's share of class 1 for every whole text."""
    cast = df.sparkSession.sparkContext.broadcast((table.astype(np.float32), bias))  # of fixed size: one number a bucket
    name = f"scorer {uuid.uuid4()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = worker_cache(name, lambda: scorer(*cast.value))
        for b in batches:
            scores = [x for at in range(0, b.num_rows, 256) for x in score(b.column(1).slice(at, 256).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], [key, "score"])

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key), F.col(text).cast("string").alias("_text")).mapInArrow(run, f"`{key}` {kind}, score double")


def train_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = TRAIN_ROWS) -> tuple[np.ndarray, float]:
    """Fits on at most ``rows`` labelled rows that are not held out (crc32(key) mod 5 is not 0)."""
    got = labelled_sample(docs, labels, key, text, label, ~held_out(F.col(key), 5, 0), rows)
    if not got:
        return np.zeros(BUCKETS, np.float32), 0.0
    return SubwordModel().fit([t for t, _ in got], [y for _, y in got]).folded()


def score_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS, threshold: float = 0.3) -> DataFrame:
    """(key, held_out, score, predicted) for every row.

    Null and empty texts have no words and get the score of the bias alone; null keys pass
    through as not held out; repeated rows are scored each; without labelled rows every score
    is 0.5. Only the text enters a score. The broadcast model is one number for each of BUCKETS.
    """
    table, bias = train_quality(docs, labels, key, text, rows=rows)
    scored = score_subwords(docs, table, bias, key, text)
    return scored.select(F.col(key), held_out(F.col(key), 5, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS, threshold: float = 0.3) -> DataFrame:
    """The rows of docs whose text scores ``threshold`` or more, with all their columns, in one pass.

    Nulls, empty texts and repeats are judged as in ``score_quality``; without labelled rows all stay.
    """
    table, bias = train_quality(docs, labels, key, text, rows=rows)
    cast = docs.sparkSession.sparkContext.broadcast((table.astype(np.float32), bias))
    name = f"scorer {uuid.uuid4()}"

    @F.arrow_udf("boolean")
    def good(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        score = worker_cache(name, lambda: scorer(*cast.value))
        for b in batches:
            # so many texts at a time are Python's; the batch itself stays Arrow's
            yield pa.array([x >= threshold for at in range(0, len(b), 256) for x in score(b.slice(at, 256).to_pylist())], pa.bool_())

    return docs.where(good(F.col(text).cast("string")))
