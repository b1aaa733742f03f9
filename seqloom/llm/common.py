"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` by writing it as a table in the shared folder.

    A table that is read again has the size of its files.  ``DataFrame.checkpoint`` would carry the estimate of its plan
    along, and over rounds of joins such estimates grow to numbers with millions of digits.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4()}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Delete tables that ``cut`` has written and that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_cut_path", None):
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(path)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    A session that names none gets a temporary folder if it runs in one process, as tests do, and an error if not.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="seqloom-"))
    return sc.getCheckpointDir()


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that no model may learn from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


class WordCache(dict):
    """64-bit hashes of words, as bytes; forgets all when full, so memory is bounded."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def hashes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


def ascii_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` words, in order."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, U64)
    h = np.zeros(n, U64)
    for i in range(size):
        h = mix(h * U64(0x9E3779B97F4A7C15) + words[i : i + n])
    return h


def rows_of(batches: Iterator[pa.RecordBatch], most: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that what is derived from a batch stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            yield batch.slice(at, most)
