"""Quality rules: word and line counts, and bands of Zstandard compression ratios.

A text is compressed whole and in fixed chunks.  Text that repeats itself compresses too well, text that is noise
hardly at all; how well ordinary text compresses depends on its length, so the limits do too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import WordCache, rows_of, windows

SYMBOLS = b"#*$%&|<>"
#: Everything but ASCII white space, as a table for bytes.translate.
_SPACE = b" \t\n\r\x0b\x0c"


@dataclass(frozen=True)
class Bands:
    """Limits of compressed over plain bytes.  A row is (bytes at least, ratio at least, ratio at most); the last row
    whose length a text reaches holds.  ``chunk`` is the length of the fixed chunks, and ``chunk_band`` their limits:
    a text is rejected when more than ``chunk_share`` of its chunks lie outside.  The last chunk ends with the text and
    may begin inside the one before, so every byte of a text that reaches one chunk's length is in a chunk; shorter
    texts are one chunk themselves, judged by the limits of their length."""

    whole: tuple[tuple[int, float, float], ...] = (
        (0, 0.45, 1.05), (200, 0.42, 0.90), (1_000, 0.39, 0.80), (4_000, 0.36, 0.72), (16_000, 0.33, 0.66), (64_000, 0.28, 0.62),
    )
    chunk: int = 2_048
    chunk_band: tuple[float, float] = (0.34, 0.80)
    chunk_share: float = 0.25
    level: int = 3

    def limits(self, size: int) -> tuple[float, float]:
        return next((low, high) for at, low, high in reversed(self.whole) if size >= at)


def repeated_words(hashes: np.ndarray, size: int = 8) -> int:
    """Words inside runs of ``size`` words that occur twice or more, the first time included."""
    h = windows(hashes, size)
    if len(h) < 2:
        return 0
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(hashes) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return int(np.count_nonzero(np.cumsum(edge)[:-1]))


def measure(text: str | None, words: WordCache, bands: Bands, press: zstandard.ZstdCompressor) -> tuple:
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    found = data.split()
    hashes = words.hashes(found)
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    spaces = len(data) - len(data.translate(None, _SPACE))
    n_symbols = len(data) - len(data.translate(None, SYMBOLS))
    repeat = repeated_words(hashes)
    ratio = len(press.compress(data)) / len(data) if data else None
    starts = [*range(0, len(data) - bands.chunk + 1, bands.chunk)]
    if starts and len(data) % bands.chunk:
        starts.append(len(data) - bands.chunk)
    ratios = [len(press.compress(data[i : i + bands.chunk])) / bands.chunk for i in starts]
    low, high = bands.chunk_band
    outside = sum(not low <= r <= high for r in ratios)
    base_failed = len(found) < 20 or 100 * repeat > 30 * len(found)
    low, high = bands.limits(len(data))
    fits = ratio is not None and low <= ratio <= high and outside <= bands.chunk_share * len(ratios)
    return len(found), len(text) - spaces, n_symbols, len(lines) - len(set(lines)), repeat, base_failed, not base_failed and fits, ratio, len(ratios), outside


_COLUMNS = {"n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(), "base_failed": pa.bool_(), "kept": pa.bool_(), "ratio": pa.float64(), "n_chunks": pa.int64(), "n_chunks_outside": pa.int64()}


def quality_rules(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """``doc_id``, the counts, ``base_failed, kept`` and the compression figures for every document.

    Words are runs of other than ASCII white space.  Null text is empty: no words, so the base rules fail.  Repeated rows
    are judged alike; a null doc_id stays null; an empty table gives no rows; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, press = WordCache(), zstandard.ZstdCompressor(level=bands.level)
        for batch in rows_of(batches):
            rows = [measure(t, words, bands, press) for t in batch.column("text").to_pylist()]
            columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), _COLUMNS.values(), strict=True)]
            yield pa.record_batch([batch.column("doc_id"), *columns], ["doc_id", *_COLUMNS])

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, n_chunks long, n_chunks_outside long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
