"""Counting alignments on features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators.intervals import cigar_segments, compare_segments, mark_ambiguous, merge_intervals, range_join
from seqloom.operators.store import cut


def build_features(gtf: DataFrame) -> DataFrame:
    """Features ``id, ref, reverse, start, end, segs`` of annotation lines: merged segments, with ambiguous parts marked.

    Lines of one id and reference form a feature wherever they stand; it lies on the strand of its first line.
    """
    rows = gtf.select("id", F.col("chrom").alias("ref"), "start", "end", "strand")
    strand = rows.groupBy("id", "ref").agg((F.min_by("strand", F.struct("start", "end", "strand")) == "-").alias("reverse"))
    segs = mark_ambiguous(merge_intervals(rows, ["id", "ref"]))
    packed = segs.groupBy("id", "ref").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_sort(F.collect_list(F.struct("start", "end", "amb"))).alias("segs"))
    return cut(packed.join(strand, ["id", "ref"]))  # small beside the alignments, and read more than once


def dispositions(alignments: DataFrame, features: DataFrame, mode: str = "UNION", min_mapq: int = 0, ignore_strand: bool = False) -> DataFrame:
    """``id, disposition``: LOW, AMB, NOFT, NC or the feature's id for every alignment.

    LOW has too little mapping quality; AMB touches a feature ambiguously; NOFT meets no feature; NC meets
    none or several without ambiguity.
    """
    low = F.coalesce(F.col("mapq") < min_mapq, F.lit(False)) if min_mapq >= 1 else F.lit(False)
    # each different CIGAR string is parsed once, from place 0 on
    parsed = cut(alignments.select("cigar").where("cigar IS NOT NULL").distinct().select("cigar", cigar_segments(F.col("cigar"), F.lit(0)).alias("_segs")))
    at = F.col("refpos").cast("long")
    moved = F.transform("_segs", lambda x: F.struct((x["start"] + at).alias("start"), (x["end"] + at).alias("end")))
    a = alignments.join(parsed, "cigar", "left").select("id", F.col("refspec").alias("ref"), low.alias("low"), "reversed", F.coalesce(moved, F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("aligned"))
    a = a.select("*", F.get("aligned", F.lit(0))["start"].alias("start"), F.try_element_at("aligned", F.lit(-1))["end"].alias("end"))
    a = cut(a)
    good = a.where("NOT low AND start IS NOT NULL").drop("low")
    f = features.select("ref", F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.col("id").alias("feature"), F.col("reverse").alias("reversed"), "segs")
    met = range_join(good, f.drop("reversed"), ["ref"]) if ignore_strand else range_join(good, f, ["ref", "reversed"])
    none, no = F.lit(None).cast("string"), F.lit(0)
    judged = met.select("id", no.alias("low"), no.alias("rest"), "feature", compare_segments(F.col("aligned"), F.col("segs"), mode).alias("result"))
    # every alignment goes along with what it met, so one shuffle by id tells all
    rows = a.select("id", F.col("low").cast("int").alias("low"), (~F.col("low")).cast("int").alias("rest"), none.alias("feature"), none.alias("result")).unionByName(judged)
    folded = rows.groupBy("id").agg(F.sum("low").alias("low"), F.sum("rest").alias("rest"), F.count("result").alias("met"), F.count_if(F.col("result") == "AMBIGUOUS").alias("amb"), F.count_if(F.col("result") == "FEATURE").alias("hits"), F.max(F.when(F.col("result") == "FEATURE", F.col("feature"))).alias("feature"))
    named = F.when(F.col("amb") > 0, "AMB").when(F.col("met") == 0, "NOFT").when(F.col("hits") == 1, F.col("feature")).otherwise("NC")
    times = lambda x, n: F.array_repeat(x, F.col(n).cast("int"))  # noqa: E731  an id that repeats is a row each time
    return folded.select("id", F.explode(F.concat(times(F.lit("LOW"), "low"), times(named, "rest"))).alias("disposition"))


def count_features(disposed: DataFrame, features: DataFrame) -> DataFrame:
    """``id, n`` for every feature, 0 included; a feature that lies on several references has one count."""
    n = disposed.groupBy(F.col("disposition").alias("id")).agg(F.count("*").alias("n"))
    return features.select("id").distinct().join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


def counters(disposed: DataFrame) -> DataFrame:
    """One row of totals: alignments, counted, and the four kinds that are not."""
    kind = lambda k: F.count_if(F.col("disposition") == k).alias(k.lower())
    return disposed.agg(F.count("*").alias("alignments"), F.count_if(~F.col("disposition").isin("LOW", "AMB", "NOFT", "NC")).alias("counted"), *map(kind, ("LOW", "AMB", "NOFT", "NC")))


def counts_report(disposed: DataFrame, features: DataFrame) -> DataFrame:
    """Lines ``id TAB n`` of all features, then ``#name TAB n`` of the totals."""
    totals = counters(disposed)
    names = F.explode(F.array(*(F.struct(F.lit(f"#{c}").alias("id"), F.col(c).alias("n")) for c in totals.columns))).alias("t")
    rows = count_features(disposed, features).select("id", "n").union(totals.select(names).select("t.id", "t.n"))
    return rows.select(F.concat_ws("\t", "id", F.col("n").cast("string")).alias("line"))


def match_references(annotated: DataFrame, run: DataFrame) -> DataFrame:
    """``name, side``: both, run or annotation.  ``annotated`` has ``name``; ``run`` has ``canonical, common``, either of which may match."""
    names = run.select(F.explode(F.array_distinct(F.array("canonical", "common"))).alias("name"), "canonical")
    in_both = annotated.distinct().join(names, "name").select("name", "canonical")
    both = in_both.select("name", F.lit("both").alias("side"))
    only_run = run.select("canonical").distinct().join(in_both, "canonical", "left_anti").select(F.col("canonical").alias("name"), F.lit("run").alias("side"))
    only_annotated = annotated.distinct().join(in_both, "name", "left_anti").select("name", F.lit("annotation").alias("side"))
    return both.union(only_run).union(only_annotated)


def translate_references(features: DataFrame, names: DataFrame, column: str = "ref") -> DataFrame:
    """Replace reference names by a dictionary ``key, value``; names without an entry stay."""
    return features.join(names.select(F.col("key").alias(column), "value"), column, "left").withColumn(column, F.coalesce("value", column)).drop("value")


def interval_counts(intervals: DataFrame, alignments: DataFrame) -> DataFrame:
    """Counts by typed intervals: each alignment counts for the only feature it meets; several features or an ambiguous
    interval make it count nowhere.  Features without a hit have 0.

    ``intervals``: ``ref, start, end, id, iv_type``; ``alignments``: ``id, ref, start, end``.
    """
    f = intervals.where("iv_type <> 'GAP'").select("ref", F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.col("id").alias("feature"), "iv_type")
    met = range_join(alignments, f, ["ref"]).groupBy("id").agg(F.count_distinct("feature").alias("n"), F.max("feature").alias("feature"), F.bool_or(F.col("iv_type") == "AMBIGUOUS").alias("amb"))
    n = met.where("n = 1 AND NOT amb").groupBy("feature").agg(F.count("*").alias("n"))
    every = intervals.where("iv_type = 'FEATURE'").select(F.col("id").alias("feature")).distinct()
    return every.join(n, "feature", "left").select("feature", F.coalesce("n", F.lit(0)).alias("n"))
