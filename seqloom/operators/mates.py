"""Mate pairs on a k-mer graph, and assembly over growing k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions import seq as S
from seqloom.operators import assembly as AS
from seqloom.operators import graph as G
from seqloom.operators import kmerdb as KD
from seqloom.operators.store import cut


def sure_edges(found: DataFrame) -> DataFrame:
    """``a, b``: edges whose twin is there, too, so that both directions know of the step."""
    twins = found.select(F.col("b_twin").alias("a"), F.col("a_twin").alias("b"))
    return found.select("a", "b").join(twins, ["a", "b"], "left_semi")


def clip_reads(reads: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """``id, bases, nodes``: the longest stretch of each read, the first of equal ones, whose k-mers follow one another by ``sure_edges``.

    Reads without a step of that kind are left out.  ``reads``: ``id, bases``; ``nodes`` are the stretch's k-mers in order.
    """
    at = reads.select("id", F.posexplode(S.kmers("bases", k, False)).alias("i", "a"))
    w = Window.partitionBy("id").orderBy("i")  # a read
    steps = at.withColumn("b", F.lead("a").over(w)).where("b IS NOT NULL").join(sure_edges(found), ["a", "b"], "left_semi")
    runs = steps.withColumn("run", F.col("i") - F.row_number().over(w))
    longest = runs.groupBy("id", "run").agg(F.min("i").alias("i"), F.count("*").alias("n")).groupBy("id").agg(F.max(F.struct("n", (-F.col("i")).alias("less"))).alias("m"))
    # bases hold only A, C, G and T where k-mers are; the places of k-mers are those of the text
    told = reads.join(longest.select("id", (-F.col("m.less")).alias("_i"), F.col("m.n").cast("int").alias("_n")), "id")
    text = F.substring("bases", F.col("_i") + 1, F.col("_n") + k)
    return told.select("id", text.alias("bases")).withColumn("nodes", S.kmers("bases", k, False))


def connect_mates(pairs: DataFrame, found: DataFrame, nodes: DataFrame, k: int, steps: int, low: int = 0, most: int = 200) -> DataFrame:
    """``id, status, bases``: one read of each pair ``id, first, second`` where the graph says what lies between the mates.

    The second mate runs the other way.  ``connected``: one walk of at most ``steps`` steps alone leads from the first to the second, the
    search back finds the same, and no k-mer comes twice; ``overlapping``: the mates share their inner ends; ``ambiguous``: several walks, or the
    directions differ; ``overflow`` as in ``connect``; ``none``: no walk, or a mate of which no stretch is in the graph.
    """
    one = cut(clip_reads(pairs.select("id", F.col("first").alias("bases")), found, k))
    two = cut(clip_reads(pairs.select("id", S.revcomp("second").alias("bases")), found, k))
    both = cut(one.select("id", F.col("bases").alias("r1"), F.col("nodes").alias("n1")).join(two.select("id", F.col("bases").alias("r2"), F.col("nodes").alias("n2")), "id"))
    turned = nodes.select(F.col("node").alias("_x"), "twin")
    ends = both.select("id", F.element_at("n1", -1).alias("first"), F.element_at("n2", 1).alias("last"))
    back = ends.join(turned.withColumnsRenamed({"_x": "last", "twin": "_f"}), "last").join(turned.withColumnsRenamed({"_x": "first", "twin": "_l"}), "first").select("id", F.col("_f").alias("first"), F.col("_l").alias("last"))
    there = G.connect(ends, found, nodes, steps, low=low, most=most, k=k).select("id", F.col("status").alias("s1"), F.col("bases").alias("b1"))
    again = G.connect(back, found, nodes, steps, low=low, most=most, k=k).select("id", F.col("status").alias("s2"), F.col("bases").alias("b2"))
    rows = both.join(there, "id").join(again, "id")
    forward = F.concat("r1", "b1", F.substring("r2", F.lit(k + 1), F.length("r2")))
    backward = F.concat(F.expr(f"left(r1, length(r1) - {k})"), S.revcomp("b2"), F.col("r2"))
    kmers = S.kmers("joined", k, False)
    # the first mate's last k-mer lies in the second, and what is before it there ends the first
    hit = (F.array_position("n2", F.element_at("n1", -1)) - 1).cast("int")
    fits = (F.col("_h") >= 0) & (F.col("_h") < F.least(F.size("n1"), F.size("n2"))) & (F.slice("n2", F.lit(1), F.greatest(F.col("_h"), F.lit(0)) + 1) == F.slice("n1", F.greatest(F.size("n1") - F.col("_h"), F.lit(1)), F.greatest(F.col("_h"), F.lit(0)) + 1))
    over = F.concat("r1", F.substring("r2", F.col("_h") + k + 1, F.length("r2")))
    rows = rows.withColumn("_h", hit).withColumn("joined", F.when(F.col("s1") == "success", F.when((F.col("s2") == "success") & (forward == backward), forward)).when((F.col("s1") == "none") & fits, over))
    twice = F.size(F.array_distinct(kmers)) < F.size(kmers)
    status = F.when(F.col("s1").isin("ambiguous", "overflow"), F.col("s1")).when(F.col("joined").isNull(), F.when(F.col("s1") == "success", "ambiguous").otherwise("none")).when(twice, "ambiguous").when(F.col("s1") == "success", "connected").otherwise("overlapping")
    told = rows.withColumn("status", status).select("id", "status", F.when(F.col("status").isin("connected", "overlapping"), F.col("joined")).alias("bases"))
    return pairs.select("id").join(told, "id", "left").select("id", F.coalesce("status", F.lit("none")).alias("status"), "bases")


def insert_sizes(pairs: DataFrame, contigs: DataFrame, k: int) -> DataFrame:
    """``id, size``: from the first base of one mate to that of the other, of pairs that lie in one contig and face each other."""
    ends = pairs.select(F.explode(F.array(F.struct("id", F.lit(1).alias("mate"), F.col("first").alias("bases")), F.struct("id", F.lit(2).alias("mate"), F.col("second").alias("bases")))).alias("e")).select(F.struct("e.id", "e.mate").alias("spotid"), "e.bases")
    placed = AS.place_reads(ends, contigs, k).select("spotid.id", "contig", "plus", F.when(F.col("plus"), F.col("contig_pos") - F.col("read_pos")).otherwise(F.col("contig_pos") + k - 1 + F.col("read_pos")).alias("at"))
    by = placed.groupBy("id", "contig").agg(F.min(F.when(F.col("plus"), F.col("at"))).alias("a"), F.max(F.when(~F.col("plus"), F.col("at"))).alias("b"))
    return by.where("b > a").select("id", (F.col("b") - F.col("a") + 1).alias("size"))


def insert_estimate(sizes: DataFrame) -> DataFrame:
    """``nxx, lxx``: the size at which pairs, largest first, reach half of all bases, and how many that takes."""
    return AS.length_statistic(sizes, "size")


#: Places of a read that are looked up before all of its k-mers are.
PLACES = 8


def spent_reads(reads: DataFrame, used: DataFrame, k: int) -> DataFrame:
    """``id`` of the reads that have k-mers, all of them in ``used`` (``kmer``, distinct).

    Few k-mers of each read are looked up first, so only reads of which these are there send all of theirs.
    """
    marked = used.select("kmer", F.lit(1).alias("_u"))
    whole = lambda rows: rows.join(marked, "kmer", "left").groupBy("id").agg(F.count("*").alias("_n"), F.sum("_u").alias("_m")).where("_n = _m").select("id")
    long = reads.where(F.length("bases") >= k)
    place = lambda i: (F.floor((F.length("bases") - k) * i / (PLACES - 1)) + 1).cast("int")
    some = long.select("id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(PLACES - 1)), lambda i: F.substring(F.col("bases"), place(i), F.lit(k)))).alias("bases"))
    likely = whole(some.select("id", F.explode(S.kmers("bases", k)).alias("kmer")))
    return whole(long.join(likely, "id", "left_semi").select("id", F.explode(S.kmers("bases", k)).alias("kmer")))


def assemble(reads: DataFrame, ks: Sequence[int], least: int = 2, fraction: float = 0.1, jump: int = 0, long: int = 2) -> DataFrame:
    """``k, circle, nodes, abundance, bases``: contigs of each k of ``ks``, rising.

    A step counts the k-mers of the reads that are left and of the contigs of the step before, which count ``least`` times so that they stay.  Then reads whose
    k-mers all lie inside contigs of ``long`` times k bases or more, further than k bases from their ends, have told what they can and leave.  The steps end with
    ``ks``, or before a k for which the reads have no k-mer seen ``least`` times.  Each step's contigs and reads are stored tables.  ``reads``: ``id, bases``.
    """
    reads, made, before = cut(reads.select("id", "bases")), None, None
    for k in sorted(ks):
        counts = KD.task_counts(reads, k)
        if before is not None:
            held = KD.task_counts(before, k).select("kmer").distinct().withColumn("n", F.lit(least).cast("long"))
            counts = counts.unionByName(held)
        solid = cut(counts.groupBy("kmer").agg(F.sum("n").alias("n")).where(F.col("n") >= least))
        if solid.isEmpty():
            break
        nodes, _, on = G.unitigs(solid, k, fraction, jump)
        before = cut(G.contigs(on, nodes, k).select(F.lit(k).alias("k"), "circle", "nodes", "abundance", "bases"))
        made = before if made is None else made.unionByName(before)
        inner = before.where(F.length("bases") >= long * k).select(F.expr(f"substr(bases, {k + 1}, length(bases) - {2 * k})").alias("bases"))
        used = cut(KD.task_counts(inner, k).select("kmer").distinct())
        spent = spent_reads(reads, used, k)
        reads = cut(reads.join(spent, "id", "left_anti"))
    if made is None:
        return reads.sparkSession.createDataFrame([], "k int, circle boolean, nodes long, abundance double, bases string")
    return made
