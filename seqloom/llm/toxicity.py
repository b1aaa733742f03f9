"""Toxicity scores from subword-bag embeddings under a linear softmax.

A word is the bag of its character n-grams; an n-gram has an embedding, a run of words the average of its
words' averages, and a linear softmax over two classes turns that average into a probability.  The embeddings
and the softmax are trained together in numpy.  A text scores as its most toxic run of words does, so a long
text cannot dilute an insult; training pools runs softly at first and then ever closer to the largest.
Misspelt or inflected words that were never seen share n-grams, and so vectors, with words that were.

Learning takes a bounded sample of labelled rows (``per_class``); scoring takes every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import U64, held_out, mix, rows_of

#: ASCII other than letters separates words; A-Z become lower case; bytes of other letters stay.
_FOLD = bytes((c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32) for c in range(256))


def fold_words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_FOLD).split()


def subwords(words: list[bytes], buckets: int, sizes: tuple[int, ...] = (3, 4, 5)) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each word (with marks at both ends, and the word itself), and where each word's start."""
    data = np.frombuffer(b"".join(b"<%b>" % w for w in words), np.uint8).astype(U64)
    length = np.array([len(w) + 2 for w in words])
    start = np.concatenate(([0], np.cumsum(length)))
    word_of = np.repeat(np.arange(len(words)), length)
    owner, gram = [], []
    for n in sizes:
        if len(data) >= n:
            h = np.full(len(data) - n + 1, n, U64)
            for i in range(n):
                h = h * U64(0x100000001B3) + data[i : len(data) - n + 1 + i]
            inside = word_of[: len(h)] == word_of[n - 1 :]
            owner.append(word_of[: len(h)][inside])
            gram.append(mix(h[inside]))
    total = np.concatenate((np.zeros(1, U64), np.cumsum(mix(data * U64(0x9E3779B97F4A7C15) + (np.arange(len(data)) - start[word_of]).astype(U64)))))
    owner.append(np.arange(len(words)))
    gram.append(mix(total[start[1:]] - total[start[:-1]]))
    owner, gram = np.concatenate(owner), np.concatenate(gram)
    order = np.argsort(owner, kind="stable")
    return (gram[order] % U64(buckets)).astype(np.int64), np.searchsorted(owner[order], np.arange(len(words)))


#: Digits and signs that are written for letters become these letters, so ``f00l`` shares its n-grams with ``fool``.
_SPELT = bytes.maketrans(b"0134578@$", b"oieastbas")


def spelt_words(text: str | None) -> list[bytes]:
    """Words in which digits and signs count as the letters they stand for."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPELT).translate(_FOLD).split()


@dataclass
class SubwordSoftmax:
    """Embeddings of ``buckets`` n-grams and the two classes' weights."""

    vectors: np.ndarray
    weights: np.ndarray
    bias: float
    run: int = 3

    @property
    def margin(self) -> np.ndarray:
        """For each n-gram, what it adds to class 1 over class 0: the softmax is linear, so averages may be taken after."""
        return self.vectors @ (self.weights[:, 1] - self.weights[:, 0])

    @classmethod
    def fit(cls, texts: list[str], labels: np.ndarray, buckets: int = 1 << 16, dim: int = 8, epochs: int = 120, run: int = 3, seed: int = 7) -> SubwordSoftmax:
        number: dict[bytes, int] = {}
        docs = [np.array([number.setdefault(w, len(number)) for w in spelt_words(t)], np.int64) for t in texts]
        keep = [i for i, d in enumerate(docs) if len(d)]
        y = np.asarray(labels, float)[keep]
        docs = [docs[i] for i in keep]
        rng = np.random.default_rng(seed)
        e, w, bias = rng.normal(0, 0.1, (buckets, dim)), rng.normal(0, 0.5, (dim, 2)), 0.0
        if not docs or y.min() == y.max():
            rate = float(y.mean()) if len(y) else 0.0
            return cls(np.zeros((buckets, dim)), w, float(np.log((rate + 0.01) / (1.01 - rate))), run)
        grams, at = subwords(list(number), buckets)
        size = np.diff(np.append(at, len(grams)))
        flat, start = np.concatenate(docs), np.concatenate(([0], np.cumsum([len(d) for d in docs])))
        length = np.diff(start)
        doc_of = np.repeat(np.arange(len(docs)), length)
        end = np.minimum(np.arange(len(flat)) + run, start[1:][doc_of])
        begin = np.maximum(end - run, start[:-1][doc_of])  # the last runs of a text begin earlier instead of ending later
        share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
        state = [np.zeros_like(e), np.zeros_like(w), 0.0]
        for epoch in range(epochs):
            sharp = 0.0 if epoch < 10 else min(8.0, 0.25 * (epoch - 9))
            v = w[:, 1] - w[:, 0]
            word = np.add.reduceat((e @ v)[grams], at) / size
            sums = np.concatenate(([0.0], np.cumsum(word[flat])))
            z = (sums[end] - sums[begin]) / (end - begin)
            top = np.maximum.reduceat(z, start[:-1])
            a = np.exp(sharp * (z - top[doc_of]))
            a /= np.add.reduceat(a, start[:-1])[doc_of]
            logit = np.add.reduceat(a * z, start[:-1]) + bias
            g = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) * share
            pull = a * g[doc_of] / (end - begin)
            edge = np.bincount(begin, pull, len(flat) + 1) - np.bincount(end, pull, len(flat) + 1)
            of_word = np.bincount(flat, np.cumsum(edge)[:-1], len(number)) / size
            of_gram = np.bincount(grams, np.repeat(of_word, size), buckets)
            gv = e.T @ of_gram + 1e-4 * v
            grads = [np.outer(of_gram, v) + 1e-7 * e, np.stack([-gv, gv], axis=1), g.sum()]
            for i, grad in enumerate(grads):
                state[i] = state[i] + grad * grad
            e -= 0.3 * grads[0] / (np.sqrt(state[0]) + 1e-9)
            w -= 0.2 * grads[1] / (np.sqrt(state[1]) + 1e-9)
            bias -= 0.2 * grads[2] / (np.sqrt(state[2]) + 1e-9)
        return cls(e, w, float(bias), run)


class Scorer:
    """Scores texts; keeps the margins of words it has met, up to a bound."""

    def __init__(self, margin: np.ndarray, bias: float, run: int, most: int = 300_000):
        self.margin, self.bias, self.run, self.most, self.known = margin, bias, run, most, {}

    def scores(self, texts: list[str | None]) -> list[float]:
        docs = [spelt_words(t) for t in texts]
        new = list({w for d in docs for w in d if w not in self.known})
        if new:
            if len(self.known) + len(new) > self.most:
                self.known.clear()
                new = list({w for d in docs for w in d})
            grams, at = subwords(new, len(self.margin))
            self.known.update(zip(new, (np.add.reduceat(self.margin[grams], at) / np.diff(np.append(at, len(grams)))).tolist(), strict=True))
        found = []
        for d in docs:
            z = np.fromiter(map(self.known.__getitem__, d), float, len(d))
            if len(z) > self.run:
                sums = np.concatenate(([0.0], np.cumsum(z)))
                z = (sums[self.run :] - sums[: -self.run]) / self.run
                logit = z.max() + self.bias
            else:
                logit = (z.mean() if len(z) else 0.0) + self.bias
            found.append(float(1 / (1 + np.exp(-np.clip(logit, -30, 30)))))
        return found


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 1500) -> SubwordSoftmax:
    """Train on at most ``per_class`` toxic and twice as many other labelled rows, those with the smallest hash of doc_id."""
    labels = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pick = lambda y, n: labels.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = pick(1, per_class).union(pick(0, 2 * per_class))  # a proven bound: at most 3 * per_class rows of two numbers
    rows = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic").toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    return SubwordSoftmax.fit(rows["text"].tolist(), rows["toxic"].to_numpy())


def score_toxicity(docs: DataFrame, model: SubwordSoftmax) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document.

    A null or empty text, or one without letters, scores as the bias alone does.  Repeated rows score alike; a null
    doc_id stays null with held_out null.  An empty table gives no rows; other columns are not looked at.
    """
    margin, bias, run = model.margin.astype(np.float32), model.bias, model.run

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(margin.astype(float), bias, run)
        for batch in rows_of(batches, 256):
            yield pa.record_batch([batch.column("doc_id"), pa.array(scorer.scores(batch.column("text").to_pylist()), pa.float64())], ["doc_id", "score"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(score, "doc_id long, score double").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
