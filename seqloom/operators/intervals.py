"""Interval operators.  An interval is ``start`` and inclusive ``end``; a segment struct is ``start, len, amb``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators.store import cut as cut_lineage

#: Bases in the smallest bin, how much wider each level's bins are, and the number of levels.
BIN, WIDER, LEVELS = 256, 16, 7
#: CIGAR operations that cover reference bases, and those that move along the reference at all.
_COVERS, _MOVES = ["M", "=", "X"], ["M", "=", "X", "D", "N"]


def end_of(start: Column, length: Column) -> Column:
    return start + length - 1


def overlap_len(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(F.least(a_end, b_end) - F.greatest(a_start, b_start) + 1, F.lit(0))


def range_join(left: DataFrame, right: DataFrame, keys: list[str], bin_size: int = BIN, how: str = "inner") -> DataFrame:
    """Pairs of rows with equal ``keys`` whose ``start..end`` and ``r_start..r_end`` overlap.

    An interval has the level whose bins are the smallest that are as long as it is, so it touches two bins at most.  Two
    intervals meet by equality on keys and bin at the higher of their levels, so short ones never share a wide bin with
    each other, and a pair counts only in the bin in which its overlap begins: none is found twice and no distinct is
    needed.  Each side goes only to the levels that the other side has, which a first pass over lengths finds (a
    handful of numbers).  With ``how='left'`` rows of the left side without a partner stay.
    """
    widths = [bin_size * WIDER**k for k in range(LEVELS)]

    def level(start: str, end: str) -> Column:
        length = F.col(end) - F.col(start)
        return sum((F.when(length >= w, 1).otherwise(0) for w in widths[:-1]), F.lit(0))

    one, two = left.withColumn("_level", level("start", "end")), right.withColumn("_level", level("r_start", "r_end"))
    sides = one.select(F.lit(0).alias("side"), "_level").union(two.select(F.lit(1).alias("side"), "_level")).distinct()
    there = [(r["side"], r["_level"]) for r in sides.collect()]  # twice LEVELS rows at most
    levels = [sorted(k for side, k in there if side == s and k is not None) for s in (0, 1)]

    def binned(df: DataFrame, start: str, end: str, own: int) -> DataFrame:
        def spots(k: int) -> Column:  # the side whose own level it is, with the left side first where both are
            kind = F.when(F.col("_level") == k, own).otherwise(1 - own)
            bins = F.sequence(F.expr(f"{start} DIV {widths[k]}"), F.expr(f"{end} DIV {widths[k]}"))
            return F.transform(bins, lambda x: F.struct(F.lit(k).alias("_at"), kind.alias("_kind"), x.alias("_bin")))

        none = F.array().cast("array<struct<_at:int,_kind:int,_bin:bigint>>")
        mine, others = levels[own], levels[1 - own]
        lowest = min(others, default=LEVELS)
        parts = [F.when((F.col("_level") == k) & F.lit(lowest <= k if own == 0 else lowest < k), spots(k)).otherwise(none) for k in mine]
        higher = (lambda k: F.col("_level") < k) if own == 0 else (lambda k: F.col("_level") <= k)
        parts += [F.when(higher(k), F.transform(spots(k), lambda x: x.withField("_kind", F.lit(1 - own)))).otherwise(none) for k in others]
        return df.select(*df.columns, F.inline(F.concat(none, *parts))).drop("_level")

    first = sum((F.when(F.col("_at") == k, F.expr(f"greatest(start, r_start) DIV {w}")).otherwise(0) for k, w in enumerate(widths)), F.lit(0))
    meet = binned(one, "start", "end", 0).join(binned(two, "r_start", "r_end", 1), [*keys, "_at", "_kind", "_bin"])
    overlap = (F.col("start") <= F.col("r_end")) & (F.col("end") >= F.col("r_start")) & (first == F.col("_bin"))
    pairs = meet.where(overlap).drop("_at", "_kind", "_bin")
    if how == "inner":
        return pairs
    missing = left.join(pairs.select(*left.columns).distinct(), left.columns, "left_anti")
    return pairs.unionByName(missing, allowMissingColumns=True)


def merge_intervals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Union of the intervals of each key; intervals that touch become one."""
    before = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    island = F.sum(F.when(F.col("start") > F.col("_top") + 1, 1).otherwise(0)).over(Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(*keys, "start", "end").withColumn("_top", F.max("end").over(before)).withColumn("_island", island).groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def cigar_segments(cigar: Column, position: Column) -> Column:
    """Reference intervals that a CIGAR string covers, as an array of start and end; touching ones are merged.

    A missing number counts as 1; a null or empty CIGAR covers nothing.
    """
    ops = F.regexp_extract_all(cigar, F.lit(r"(\d*)([MIDNSHP=X])"), 2)
    sizes = F.transform(F.regexp_extract_all(cigar, F.lit(r"(\d*)([MIDNSHP=X])"), 1), lambda n: F.when(n == "", 1).otherwise(n.cast("long")))
    steps = F.arrays_zip(ops.alias("op"), sizes.alias("n"))
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def fold(acc: Column, s: Column) -> Column:
        at, segs, n = acc["at"], acc["segs"], s["n"].cast("long")
        last = F.try_element_at(segs, F.lit(-1))
        grown = F.when(last["end"] == at - 1, F.concat(F.slice(segs, 1, F.size(segs) - 1), F.array(F.struct(last["start"].alias("start"), (at + n - 1).alias("end"))))).otherwise(F.concat(segs, F.array(F.struct(at.alias("start"), (at + n - 1).alias("end")))))
        return F.struct((at + F.when(s["op"].isin(_MOVES), n).otherwise(F.lit(0).cast("long"))).alias("at"), F.when(s["op"].isin(_COVERS) & (n > 0), grown).otherwise(segs).alias("segs"))

    return F.coalesce(F.aggregate(steps, F.struct(position.cast("long").alias("at"), empty.alias("segs")), fold)["segs"], empty)


def mark_ambiguous(segments: DataFrame, ref: str = "ref", feature: str = "id") -> DataFrame:
    """Cut the merged segments of features where others begin or end; pieces under two features or more are ambiguous.

    Strand does not matter.  Pieces of a feature that touch and agree are joined again.
    """
    segments = cut_lineage(segments)
    ends = segments.select(ref, F.col("start").alias("pos"), F.lit(1).alias("step")).union(segments.select(ref, (F.col("end") + 1).alias("pos"), F.lit(-1).alias("step")))
    steps = ends.groupBy(ref, "pos").agg(F.sum("step").alias("step"))
    order = Window.partitionBy(ref).orderBy("pos")
    depth = F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0))
    pieces = steps.select(ref, F.col("pos").alias("r_start"), (F.lead("pos").over(order) - 1).alias("r_end"), depth.alias("depth")).where("r_end IS NOT NULL AND depth > 0")
    cut = range_join(segments, pieces, [ref]).select(ref, feature, F.greatest("start", "r_start").alias("start"), F.least("end", "r_end").alias("end"), (F.col("depth") > 1).alias("amb"), F.col("start").alias("_of"))
    by = Window.partitionBy(ref, feature, "_of").orderBy("start")
    fresh = F.when((F.lag("amb").over(by) == F.col("amb")) & (F.lag("end").over(by) == F.col("start") - 1), 0).otherwise(1)
    runs = cut.withColumn("_new", fresh).withColumn("_run", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(ref, feature, "_of", "_run", "amb").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_of", "_run")


def insert_gaps(rows: DataFrame, key: str, last: int = 2_147_483_647) -> DataFrame:
    """Intervals of each key with the gaps between them, and a last gap of ``last`` bases; type GAP or FEATURE.

    Intervals that begin inside what came before are dropped.
    """
    order = Window.partitionBy(key).orderBy("start", "end")
    top = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = rows.withColumn("_top", top).where(F.col("start") > F.col("_top"))
    seen = kept.withColumn("_before", F.coalesce(F.lag("end").over(order), F.lit(0)))
    gaps = seen.where(F.col("start") > F.col("_before") + 1).select(key, (F.col("_before") + 1).alias("start"), (F.col("start") - 1).alias("end"), F.lit("GAP").alias("iv_type"))
    tail = seen.groupBy(key).agg(F.max("end").alias("e")).select(key, (F.col("e") + 1).alias("start"), (F.col("e") + last).alias("end"), F.lit("GAP").alias("iv_type"))
    return seen.select(key, "start", "end", F.lit("FEATURE").alias("iv_type")).union(gaps).union(tail)


def is_sorted(rows: DataFrame, key: str, order: list[str], value: str = "start") -> DataFrame:
    """Whether ``value`` never falls within a key, in the given order."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_falls", F.coalesce(F.lag(value).over(w) > F.col(value), F.lit(False))).groupBy(key).agg((~F.bool_or("_falls")).alias("sorted"))


def events(rows: DataFrame, key: str) -> DataFrame:
    """Starts and ends in order; where an interval begins right after another ends, both become one jump."""
    ends = rows.select(key, F.col("start").alias("pos"), F.lit("start").alias("event")).union(rows.select(key, (F.col("end") + 1).alias("pos"), F.lit("end").alias("event")))
    both = ends.groupBy(key, "pos").agg(F.count_if(F.col("event") == "start").alias("s"), F.count_if(F.col("event") == "end").alias("e"))
    return both.select(key, "pos", F.when((F.col("s") > 0) & (F.col("e") > 0), "jump").when(F.col("s") > 0, "start").otherwise("end").alias("event"))


def policy(mode: str, gen: Column, amb: Column, out: Column) -> Column:
    """FEATURE, AMBIGUOUS or NO_FEATURE: whether bases lie on plain segments, on ambiguous ones, or outside."""
    yes, both, no = F.lit("FEATURE"), F.lit("AMBIGUOUS"), F.lit("NO_FEATURE")
    if mode == "SIMPLE":
        return F.when(gen | amb, yes).otherwise(no)
    if mode == "UNION":
        return F.when(amb, both).when(gen, yes).otherwise(no)
    if mode == "STRICT":
        return F.when(out, no).when(gen, yes).when(amb, both).otherwise(no)
    if mode == "NONEMPTY":
        return F.when(gen, yes).when(amb, both).otherwise(no)
    raise ValueError(f"unknown mode {mode}")


def compare_segments(aligned: Column, segs: Column, mode: str) -> Column:
    """Result of comparing an array of start, end with an array of start, end, amb."""
    zero = F.lit(0).cast("long")
    start = F.struct(F.lit(False).alias("gen"), F.lit(False).alias("amb"), zero.alias("shared"), zero.alias("total"))

    def with_segment(acc: Column, a: Column, g: Column) -> Column:
        n = overlap_len(a["start"], a["end"], g["start"], g["end"])
        return F.struct((acc["gen"] | ((n > 0) & ~g["amb"])).alias("gen"), (acc["amb"] | ((n > 0) & g["amb"])).alias("amb"), (acc["shared"] + n).alias("shared"), acc["total"].alias("total"))

    def with_stretch(acc: Column, a: Column) -> Column:
        grown = F.struct(acc["gen"].alias("gen"), acc["amb"].alias("amb"), acc["shared"].alias("shared"), (acc["total"] + a["end"] - a["start"] + 1).alias("total"))
        return F.aggregate(segs, grown, lambda inner, g: with_segment(inner, a, g))

    return F.aggregate(aligned, start, with_stretch, lambda x: policy(mode, x["gen"], x["amb"], x["shared"] < x["total"]))
