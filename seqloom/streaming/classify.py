"""Classification of a stream of reads against a fixed index (an extension: the batch tools have no streams)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import seq as S
from seqloom.sources.formats import parse_fasta


def read_stream(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """``spotid, bases, arrived`` of FASTA files as they arrive in a folder; records are those of ``read_fasta``."""
    rows = spark.readStream.option("lineSep", "\n>").option("maxFilesPerTrigger", per_trigger).text(folder)
    return parse_fasta(rows.select("value", F.col("_metadata.file_modification_time").alias("arrived"))).drop("description")


def stream_hits(reads: DataFrame, db: DataFrame, k: int, late: str | None = None) -> DataFrame:
    """``spotid, tax_id, n``, kept up to date while reads arrive; parts of a spot may come in different files.

    Without ``late`` every spot stays in the state, and so may go on at any time.  With ``late``, an interval, counts are of a window of that
    length by the time of the files, and a spot leaves the state when files are later than its window by that much: rows then have ``window`` as well.
    """
    if late is not None:
        reads = reads.withWatermark("arrived", late)
    window = [] if late is None else [F.window("arrived", late)]
    rows = reads.select("spotid", "arrived", F.explode(S.acgt_runs("bases")).alias("bases")).where(F.length("bases") >= k)
    kmers = rows.select("spotid", "arrived", F.explode(S.kmers("bases", k)).alias("kmer"))
    return kmers.join(db.where("tax_id <> 0"), "kmer").groupBy("spotid", "tax_id", *window).agg(F.count("*").alias("n"))
