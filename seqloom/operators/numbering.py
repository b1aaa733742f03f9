"""Row numbers without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators.store import cut


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``row``, counted from 0 in the given order.

    Rows are dealt by ranges of the order columns, so partitions follow one another; each is numbered alone and moved by the
    sizes of those before it, of which there are as many as partitions.  What was dealt is written once, so both sides
    of the join speak of the same partitions.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    within = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    dealt = cut(dealt.withColumn("_r", within))
    sizes = dealt.groupBy("_p").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = F.broadcast(sizes.withColumn("_before", before).drop("_n"))  # a row a partition
    return dealt.join(sizes, "_p").withColumn("row", F.col("_r") + F.col("_before")).drop("_p", "_r", "_before")
