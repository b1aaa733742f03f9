"""Connected components of a graph of numbered nodes, by contraction with joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import cut, forget


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node that an edge ``a, b`` touches; label: the smallest node reachable.

    In a round each node moves to the first of itself and its neighbours in an order that a hash gives anew for each round,
    and on to where that one moves; edges then run between where their ends have moved, and those within one node go.
    So the graph shrinks by a factor in each round, long paths included.  A node with very many edges meets only joins, which
    adaptive execution splits, and a minimum, which is combined before the shuffle.
    Edges of null are left out; loops and repeated edges do no harm.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL")
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels, turn = None, 0
    while True:
        order = lambda c, turn=turn: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("to"))
        ends = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        near = cut(ends.groupBy(F.col("a").alias("node")).agg(F.min(order("b")).alias("m")).select("node", F.least("m", order("node"))["to"].alias("to")))
        moved = cut(near.join(near.select(F.col("node").alias("to"), F.col("to").alias("next")), "to").select("node", F.col("next").alias("to")))
        end = lambda c: moved.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to"))  # noqa: E731, B023
        left = edges.where("a < b").join(end("a"), "a").join(end("b"), "b").where("a_to <> b_to")
        before, edges = edges, cut(left.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct())
        old = labels
        if labels is None:
            labels = cut(moved.withColumnRenamed("to", "root"))
        else:
            labels = cut(labels.join(moved.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        forget(before, near, moved, old)
        if edges.isEmpty():
            forget(edges)
            return labels.join(labels.groupBy("root").agg(F.min("node").alias("label")), "root").select("node", "label")
        turn += 1
