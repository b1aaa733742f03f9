"""Language identification as inference of a mixture of languages.

Each language has smoothed frequencies of character n-grams.  A word's likelihood under a language comes from
its n-grams; a document is a mixture whose proportions expectation-maximisation estimates from its words.  The set of
languages is chosen by penalised likelihood: another language must raise the log-likelihood by more than half the
logarithm of the number of words, times ``penalty``.

The sets that are tried hold the languages of the largest proportions: one, two and so on, until no text gains.

Frequencies of every language are learnt from a bounded sample of its rows (``per_language``); every whole text is judged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.llm.common import held_out, rows_of
from seqloom.llm.toxicity import fold_words, subwords

_LETTER = regex.compile(r"\p{L}")
SIZES = (1, 2, 3)


@dataclass
class LanguageModel:
    languages: list[str]
    log_p: np.ndarray  # buckets x languages
    penalty: float = 4.0

    @classmethod
    def fit(cls, texts: list[str], languages: list[str], buckets: int = 1 << 15, smooth: float = 0.3) -> LanguageModel:
        names = sorted(set(languages))
        counts = np.full((buckets, len(names)), smooth)
        for j, name in enumerate(names):
            words: dict[bytes, int] = {}
            for text, language in zip(texts, languages, strict=True):
                if language == name:
                    for w in fold_words(text):
                        words[w] = words.get(w, 0) + 1
            if words:
                grams, at = subwords(list(words), buckets, SIZES)
                size = np.diff(np.append(at, len(grams)))
                counts[:, j] += np.bincount(grams, np.repeat(np.fromiter(words.values(), float), size), buckets)
        return cls(names, np.log(counts / counts.sum(axis=0)))


class Mixtures:
    """Mixtures of languages in texts; keeps the likelihoods of words it has met, up to a bound."""

    def __init__(self, model: LanguageModel, most: int = 300_000):
        self.model, self.most, self.known, self.rows = model, most, {}, np.empty((0, len(model.languages)), np.float32)

    def word_rows(self, docs: list[list[bytes]]) -> np.ndarray:
        new = list(set(chain.from_iterable(docs)).difference(self.known))
        if len(self.known) + len(new) > self.most:
            self.known, self.rows = {}, self.rows[:0]
            new = list(set(chain.from_iterable(docs)))
        if new:
            grams, at = subwords(new, len(self.model.log_p), SIZES)
            # n-grams of three sizes overlap: each letter is counted by about three of them
            self.rows = np.concatenate((self.rows, (np.add.reduceat(self.model.log_p[grams], at, axis=0) / len(SIZES)).astype(np.float32)))
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        return self.rows[np.fromiter(map(self.known.__getitem__, chain.from_iterable(docs)), np.int64, sum(map(len, docs)))]

    def infer(self, texts: list[str | None]) -> list[tuple[str, float, dict[str, float]]]:
        names, out = self.model.languages, [("und", 0.0, {})] * len(texts)
        docs = [fold_words(t) if t and _LETTER.search(t) else [] for t in texts]
        at = [i for i, d in enumerate(docs) if d]
        if not at or not names:
            return out
        docs = [docs[i] for i in at]
        n = np.array([len(d) for d in docs])
        start, of = np.concatenate(([0], np.cumsum(n)[:-1])), np.repeat(np.arange(len(docs)), n)
        logs = self.word_rows(docs)
        top = logs.max(axis=1)
        like = np.exp(logs - top[:, None])
        base = np.add.reduceat(top.astype(float), start)

        def climb(share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
            for _ in range(rounds):
                r = like * share.astype(np.float32)[of]
                r /= r.sum(axis=1, keepdims=True) + np.float32(1e-30)
                share = np.add.reduceat(r, start, axis=0, dtype=float) / n[:, None]
                share /= share.sum(axis=1, keepdims=True)
            return share, base + np.add.reduceat(np.log((like * share.astype(np.float32)[of]).sum(axis=1) + 1e-30), start, dtype=float)

        share, _ = climb(np.full((len(docs), len(names)), 1 / len(names)), 8)
        order = np.argsort(-share, axis=1, kind="stable")
        best, score = np.zeros_like(share), np.full(len(docs), -np.inf)
        for k in range(1, len(names) + 1):  # grow the sets while that pays for some text
            own = np.zeros_like(share)
            np.put_along_axis(own, order[:, :k], np.take_along_axis(share, order[:, :k], 1) + 1e-9, 1)
            own, value = climb(own / own.sum(axis=1, keepdims=True), 0 if k == 1 else 5)
            value = value - self.model.penalty * 0.5 * (k - 1) * np.log(n + 1)
            better = value > score
            if not better.any():
                break
            best[better], score[better] = own[better], value[better]
        for i, b in zip(at, best, strict=True):
            j = int(b.argmax())
            out[i] = (names[j], float(min(1.0, b[j])), {names[m]: float(b[m]) for m in np.flatnonzero(b)})
        return out


def fit_language_model(docs: DataFrame, per_language: int = 400) -> LanguageModel:
    """Learn from rows with a language that are not held out: about ``per_language`` rows for each language, those whose
    hash of doc_id is smallest.  A language has a row of counts on the driver, and the model a column of frequencies."""
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    counts = rows.groupBy("lang").count().orderBy("lang").collect()  # a row a language
    if not counts:
        return LanguageModel([], np.zeros((1, 0)))
    part = F.element_at(F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], min(1.0, per_language / r["count"])))), F.col("lang"))
    draw = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / float(1 << 53)
    sample = rows.where(draw < part).select("doc_id", "lang", "text").toPandas().sort_values(["doc_id", "text"], kind="stable")
    return LanguageModel.fit(sample["text"].tolist(), sample["lang"].tolist())


def with_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with ``_lang_pred, _lang_score, _languages``; all other columns stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixtures = Mixtures(model)
        for batch in rows_of(batches, 128):
            found = mixtures.infer(batch.column("text").to_pylist())
            new = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([list(f[2].items()) for f in found], pa.map_(pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "_lang_pred", "_lang_score", "_languages"])

    docs = docs.drop("_lang_pred", "_lang_score", "_languages")
    schema = T.StructType([*docs.schema.fields, *T.StructType.fromDDL("_lang_pred string, _lang_score double, _languages map<string,double>").fields])
    return docs.mapInArrow(run, schema)


def identify_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, languages`` for every document.

    ``score`` is the proportion of the predicted language and ``languages`` those of the chosen set.  A text that is null or
    without a letter gives ``und`` with score 0, and so does every text if nothing could be learnt.  Repeated rows
    are judged alike; a null doc_id stays null; an empty table gives no rows; other columns are not looked at.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_language(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_lang_pred").alias("lang_pred"), F.col("_lang_score").alias("score"), F.col("_languages").alias("languages"))
