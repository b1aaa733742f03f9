"""A corpus pipeline: language, near copies, benchmark passages, source mix, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame.  ``run`` writes each stage's result as Parquet in the
folder that all executors share and rereads it as the next stage's documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import forget, shared_folder, table
from seqloom.llm.decontamination import decontaminate
from seqloom.llm.language_id import fit_language_model, with_language
from seqloom.llm.mixing import mix_sources
from seqloom.llm.ngram_jaccard import ngram_jaccard_join
from seqloom.llm.sharding import shard_as_written

#: Near copies share this many percent of their distinct five-word shingles.
NEAR_PERCENT = 80
NEAR_WORDS = 5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language can be told; texts that are null or have no letter go."""
    return with_language(docs, fit_language_model(docs)).where("_lang_pred <> 'und'").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked by near copies: that with the smallest doc_id.

    A document is told by its doc_id and text together, so different texts with one doc_id, or with none, are documents
    of their own; rows that repeat both are one.  A document without a doc_id is kept if its group has none with one.
    """
    row, again = F.xxhash64("doc_id", "text", F.col("text").isNull()), F.xxhash64(F.lit(1), "doc_id", "text", F.col("text").isNull())
    known = docs.withColumn("_row", row)
    linked = ngram_jaccard_join(known.select(F.col("_row").alias("doc_id"), "text"), NEAR_WORDS, NEAR_PERCENT).select(F.col("doc_id").alias("_row"), "component_id").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row"))
    kept = linked.join(known.select("_row", "doc_id").distinct(), "_row").groupBy("component_id").agg(first.alias("first")).select("first._row")
    return known.join(kept, "_row", "left_semi").withColumn("_again", again).dropDuplicates(["_row", "_again"]).select(*docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the order of the mix.

    The weights are the sources' row counts to the power 0.7.  They decide where a document comes and never whether it
    stays: behind the place where the first source has no block left, the others go on with their relative shares.
    The order is that of the files and their rows; the next stage's slots follow it.
    """
    return mix_sources(docs).orderBy(F.asc_nulls_last("mix_position")).select(*docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shards of the documents with their texts; slots follow the order in which the mix was written."""
    return shard_as_written(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("ngram_jaccard_join", near_copies),
    ("benchmark_decontamination", benchmark_passages),
    ("mixing_sources", source_mix),
    ("sharding", shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        docs._cut_path = path
        forget(before)  # the stage before; the given table is none
    return docs


#: No SQL: the language model, the near copies and the schedule are beyond it.  A test holds the documents that each stage
#: keeps, and the rows of run(), against plain Python on a small table.
ORACLE_SQL = None
