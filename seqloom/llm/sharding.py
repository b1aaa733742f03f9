"""Sharding by weighted rendezvous hashing, with DataFrame functions only.

Each shard draws a number for a record from the record's key and the shard's number; the largest draw takes the record.
A draw is ``weight / -ln(u)``, so a shard takes its weight's share.  A new shard draws beside the others and can
only win records for itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts in which a shard is numbered; a window holds one part of one shard.
PARTS = 1024


def draw(key: Column, shard: int, weight: float = 1.0) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return F.lit(float(weight)) / -F.ln(u)


def rendezvous(key: Column, weights: list[float]) -> Column:
    """Number of the shard that wins the record."""
    draws = [F.struct(draw(key, i, w).alias("d"), F.lit(i).alias("shard")) for i, w in enumerate(weights)]
    return (F.greatest(*draws) if len(draws) > 1 else draws[0])["shard"]


def numbered(rows: DataFrame, group: str, order: list[str], slot: str = "slot") -> DataFrame:
    """``rows`` with ``slot``: gapless from 0 within ``group``.  Names that begin with ``_of_`` are kept for inner use.

    Rows are numbered within parts that a hash of the order columns makes, and parts are then lined up by their
    counts, so no task holds a group.  Repeated rows get numbers of their own; ``group`` has no nulls.
    """
    rows = rows.withColumn("_of_part", F.pmod(F.xxhash64(*order), F.lit(PARTS)).cast("int"))
    before = Window.partitionBy(group).orderBy("_of_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(group, "_of_part").agg(F.count("*").alias("n"))
    offset = F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_of_offset")
    offsets = counts.select(F.col(group).alias("_of_group"), F.col("_of_part").alias("_of_same"), offset)
    within = F.row_number().over(Window.partitionBy(group, "_of_part").orderBy(*order)) - 1
    on = (F.col(group) == F.col("_of_group")) & (F.col("_of_part") == F.col("_of_same"))
    rows = rows.withColumn("_of_within", within).join(offsets, on).withColumn(slot, F.col("_of_within") + F.col("_of_offset"))
    return rows.drop("_of_part", "_of_within", "_of_offset", "_of_group", "_of_same")


def shard_documents(docs: DataFrame, shards: int = 24, weights: list[float] | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every document.

    The law is ``key``: doc_id and the shard count decide.  Null text counts as empty (size 8, checksum 0); rows of a null
    doc_id go to one shard; repeated rows go to the same shard and get slots of their own; an empty table gives no
    rows; other columns are not looked at.  ``weights`` has one number a shard, and one more for the grown set if wanted.
    """
    rows = docs.select(*_placed(shards, weights))
    return numbered(rows, "shard", ["doc_id", "text_crc32", "size"]).select(*COLUMNS)


COLUMNS = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def _placed(shards: int, weights: list[float] | None) -> list[Column]:
    """All of COLUMNS but the slot."""
    weights = list(weights or [1.0] * shards)
    grown = weights if len(weights) > shards else [*weights, 1.0]
    text, key = F.coalesce("text", F.lit("")).cast("binary"), F.col("doc_id")
    return [
        key, (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"),
        rendezvous(key, grown[:shards]).alias("shard"), rendezvous(key, grown).alias("grown_shard"),
    ]


def shard_as_written(docs: DataFrame, shards: int = 24, weights: list[float] | None = None) -> DataFrame:
    """``shard_documents`` of a table read from Parquet files, with ``text, source, lang`` of each row and slots in the order of the rows.

    Rows that were written in an order lie in files that Spark numbers; a shard's slots follow the files' numbers and the
    rows in each.  So a shard that is read by slot keeps the order of the whole table.  Columns of the files that are named
    otherwise are not looked at.  A window holds what one file gives one shard; texts are shuffled once, by their place.
    """
    file, row = F.col("_metadata.file_name"), F.col("_metadata.row_index")
    number = F.coalesce(F.regexp_extract(file, r"^part-(\d+)", 1).try_cast("long"), F.lit(-1).cast("long"))
    rows = docs.select(*_placed(shards, weights), number.alias("_number"), file.alias("_file"), row.alias("_row"))
    before = Window.partitionBy("shard").orderBy("_number", "_file").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "_number", "_file").agg(F.count("*").alias("n"))
    offsets = counts.select("shard", "_file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    within = F.row_number().over(Window.partitionBy("shard", "_file").orderBy("_row")) - 1
    slots = rows.withColumn("_within", within).join(offsets, ["shard", "_file"]).withColumn("slot", F.col("_within") + F.col("_offset"))
    texts = docs.select(file.alias("_file"), row.alias("_row"), "text", "source", "lang")
    return slots.select(*COLUMNS, "_file", "_row").join(texts, ["_file", "_row"]).select(*COLUMNS, "text", "source", "lang")
