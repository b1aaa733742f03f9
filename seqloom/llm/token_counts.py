"""Token counts as rollups that batches of changes keep up to date.

A change says that a document's count under a tokenizer version was inserted, deleted or revised.  It turns into signed
numbers (documents and tokens) of its source, language and tokenizer version; a batch adds up its own and is
written as one table named after the batch.  A batch is committed when that table is complete, and a batch that is
committed is not applied again; one that was interrupted is written anew as a whole.  Totals are the sum over
committed batches, so they are additive, and never need the documents again.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import cut, rows_of, shared_folder

#: Fixed value: the pattern that splits text before the merges of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Where white space is more than single spaces between words, pieces between spaces cannot be told apart safely.
_JOINED = re.compile(r"\s \s|  |\s $|^ \s")


class BpeCounter:
    """Counts byte-level BPE tokens.  A token never crosses a single space between two words, so each word with the
    space before it is encoded once and remembered, up to a bound; texts with other runs of spaces are encoded whole."""

    def __init__(self, ranks: bytes, most: int = 300_000):
        import tiktoken

        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})
        self.known: dict[str, int] = {}
        self.most = most

    def whole(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if _JOINED.search(text):
            return self.whole(text)
        head, *rest = text.split(" ")
        new = set(rest).difference(self.known)
        if new:
            if len(self.known) + len(new) > self.most:
                self.known.clear()
                new = set(rest)
            for word in new:
                self.known[word] = self.whole(" " + word)
        return (self.whole(head) if head else 0) + sum(map(self.known.__getitem__, rest))


def read_vocabulary(path: str = VOCABULARY) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def count_tokens(docs: DataFrame, vocabulary: bytes, version: str = "byte_bpe_50k") -> DataFrame:
    """``doc_id, source, lang, tokenizer, n_tokens, text_sha1`` of every document, for two tokenizer versions: ``version`` and words
    between white space (``words``).  Null text has no tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = BpeCounter(vocabulary)
        for batch in rows_of(batches):
            texts = batch.column("text").to_pylist()
            bpe, words = [counter.count(t) for t in texts], [len((t or "").encode("utf-8", "surrogatepass").split()) for t in texts]
            yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "source", "lang", "text_sha1")), pa.array(bpe, pa.int64()), pa.array(words, pa.int64())], ["doc_id", "source", "lang", "text_sha1", "bpe", "words"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.sha1(F.coalesce(text, F.lit("")).cast("binary")).alias("text_sha1"), text.alias("text"))
    counted = rows.mapInArrow(run, "doc_id long, source string, lang string, text_sha1 string, bpe long, words long")
    versions = F.explode(F.array(F.struct(F.lit(version).alias("tokenizer"), F.col("bpe").alias("n_tokens")), F.struct(F.lit("words").alias("tokenizer"), F.col("words").alias("n_tokens"))))
    return counted.select("doc_id", "source", "lang", "text_sha1", versions.alias("v")).select("doc_id", "source", "lang", "text_sha1", "v.*")


KEYS = ["source", "lang", "tokenizer"]


def signed(changes: DataFrame) -> DataFrame:
    """What a batch of changes ``kind, source, lang, tokenizer, n_tokens, old_tokens`` adds to the totals.

    ``insert`` adds a document and its tokens, ``delete`` takes both away, ``revise`` adds the difference of tokens.
    Null numbers count as 0; other kinds raise an error.
    """
    n, old = F.coalesce("n_tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    wrong = F.raise_error(F.concat(F.lit("unknown kind of change: "), F.coalesce("kind", F.lit("null"))))
    docs = F.when(F.col("kind") == "insert", 1).when(F.col("kind") == "delete", -1).when(F.col("kind") == "revise", 0).otherwise(wrong.cast("int"))
    tokens = F.when(F.col("kind") == "insert", n).when(F.col("kind") == "delete", -n).otherwise(n - old)
    return changes.groupBy(*KEYS).agg(F.sum(docs).cast("long").alias("n_docs"), F.sum(tokens).cast("long").alias("n_tokens"))


class Rollup:
    """Totals by source, language and tokenizer version in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or f"{shared_folder(spark)}/rollup-{uuid.uuid4()}"

    def _files(self, below: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{below}")
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path

    def committed(self, batch: str) -> bool:
        fs, path = self._files(f"batch={batch}/_SUCCESS")
        return fs.exists(path)

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit a batch; False if it was committed before, and then nothing changes."""
        if not re.fullmatch(r"[\w-]+", batch):
            raise ValueError("a batch is named by letters, digits, _ and -")
        if self.committed(batch):
            return False
        signed(changes).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        return True

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, n_docs, n_tokens``; groups whose documents are all gone are left out."""
        fs, path = self._files("")
        found = [str(x.getPath().toString()) for x in (fs.listStatus(path) if fs.exists(path) else []) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))]
        if not found:
            return self.spark.createDataFrame([], "source string, lang string, tokenizer string, n_docs long, n_tokens long")
        return self.spark.read.parquet(*found).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 OR n_tokens <> 0")


def maintain_counts(docs: DataFrame, vocabulary: bytes, path: str | None = None) -> DataFrame:
    """Totals of all documents after four batches: all are inserted; later copies of a text are deleted; what is left is revised
    to have one token more, for the end of the text; and the deletions arrive once more, which changes nothing.

    Null sources and languages are groups of their own; a null doc_id is the first copy of its text only if no other has one;
    rows that repeat a doc_id and text keep one; an empty table gives no rows; other columns are not looked at.
    """
    counts = cut(count_tokens(docs, vocabulary))
    copies = counts.groupBy("text_sha1", "tokenizer").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "source", "lang")).alias("kept"), F.count("*").alias("n"), F.min("n_tokens").alias("n_tokens"))
    kept = copies.select("kept.source", "kept.lang", "tokenizer", "n_tokens")
    change = lambda df, kind, n, old: df.select(F.lit(kind).alias("kind"), *KEYS, n.alias("n_tokens"), old.alias("old_tokens"))
    none, n = F.lit(None).cast("long"), F.col("n_tokens")
    # all rows leave and the kept ones come back: the same sum as deleting each later copy, without joining copies to their first
    deleted = change(counts, "delete", n, none).union(change(kept, "insert", n, none))
    rollup = Rollup(docs.sparkSession, path)
    rollup.apply("1-insert", change(counts, "insert", n, none))
    rollup.apply("2-copies", deleted)
    rollup.apply("3-end-of-text", change(kept, "revise", n + 1, n))
    rollup.apply("2-copies", deleted)
    return rollup.totals()
