"""Assembly descriptions ``object, beg, end, component, cbeg, cend, strand`` and remaps between builds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators.intervals import range_join
from seqloom.operators.store import cut

COLUMNS = ["object", "beg", "end", "component", "cbeg", "cend", "strand"]


def top_level(agp: DataFrame) -> DataFrame:
    """Objects that are no component."""
    return agp.select("object").distinct().join(agp.select(F.col("component").alias("object")), "object", "left_anti")


def clean(agp: DataFrame) -> DataFrame:
    """Records that do not lie inside an earlier record of their object; longer ones come first at equal starts."""
    w = Window.partitionBy("object").orderBy("beg", F.desc("end"), "component").rowsBetween(Window.unboundedPreceding, -1)
    return agp.withColumn("_top", F.max("end").over(w)).where("_top IS NULL OR end > _top").drop("_top")


def compose(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """Records of ``inner`` placed on the objects of ``outer``; a part that an outer record cuts is an error."""
    i = inner.select(F.col("object").alias("component"), F.col("beg").alias("r_start"), F.col("end").alias("r_end"), F.col("component").alias("c2"), F.col("cbeg").alias("cb2"), F.col("cend").alias("ce2"), F.col("strand").alias("s2"))
    o = outer.select("object", F.col("beg").alias("o_beg"), F.col("end").alias("o_end"), "component", F.col("cbeg").alias("start"), F.col("cend").alias("end"), "strand")
    j = range_join(o, i, ["component"])
    split = F.raise_error(F.concat(F.lit("a part is split: "), F.col("c2"))).cast("bigint")
    there = F.when(F.col("strand") == 1, F.col("o_beg") + F.col("r_start") - F.col("start")).otherwise(F.col("o_end") - (F.col("r_end") - F.col("start")))
    beg = F.when((F.col("r_start") < F.col("start")) | (F.col("r_end") > F.col("end")), split).otherwise(there)
    return j.select("object", beg.alias("beg"), (beg + F.col("r_end") - F.col("r_start")).alias("end"), F.col("c2").alias("component"), F.col("cb2").alias("cbeg"), F.col("ce2").alias("cend"), (F.col("strand") * F.col("s2")).alias("strand"))


def flatten(agp: DataFrame, most: int = 20) -> DataFrame:
    """Top-level objects in terms of components that are no objects; the depth of nesting is at most ``most``.  Each level is a stored table."""
    agp = cut(agp.select(*COLUMNS))
    objects = cut(agp.select(F.col("object").alias("component")).distinct())
    level, done = cut(agp.join(top_level(agp), "object", "left_semi")), None
    for _ in range(most):
        leaves = level.join(objects, "component", "left_anti").select(*COLUMNS)
        done = leaves if done is None else done.unionByName(leaves)
        level = cut(compose(level.join(objects, "component", "left_semi").select(*COLUMNS), agp))
        if level.isEmpty():
            return done
    raise ValueError("the description nests too deep or in a circle")


def pieces(one: DataFrame, two: DataFrame) -> DataFrame:
    """``component, cbeg, cend`` ranges that both builds use, cut wherever a record of either begins or ends."""
    both = one.select("component", "cbeg", "cend").union(two.select("component", "cbeg", "cend"))
    marks = both.select("component", F.col("cbeg").alias("p")).union(both.select("component", (F.col("cend") + 1).alias("p"))).distinct()
    w = Window.partitionBy("component").orderBy("p")
    return marks.select("component", F.col("p").alias("cbeg"), (F.lead("p").over(w) - 1).alias("cend")).where("cend IS NOT NULL")


def place(agp: DataFrame, parts: DataFrame) -> DataFrame:
    """Where the pieces lie on a build's objects."""
    p = parts.select("component", F.col("cbeg").alias("r_start"), F.col("cend").alias("r_end"))
    a = agp.select("object", F.col("beg").alias("o_beg"), F.col("end").alias("o_end"), "component", F.col("cbeg").alias("start"), F.col("cend").alias("end"), "strand")
    j = range_join(a, p, ["component"]).where("r_start >= start AND r_end <= end")
    beg = F.when(F.col("strand") == 1, F.col("o_beg") + F.col("r_start") - F.col("start")).otherwise(F.col("o_end") - (F.col("r_end") - F.col("start")))
    return j.select("component", F.col("r_start").alias("cbeg"), F.col("r_end").alias("cend"), "object", beg.alias("beg"), (beg + F.col("r_end") - F.col("r_start")).alias("end"), "strand")


def remap(source: DataFrame, result: DataFrame, replaced: DataFrame | None = None) -> DataFrame:
    """``seqid, start, length, component, offset, reversed``: places on the result that come from places on the source.

    A piece that lies at one place of either build is a pair.  Of pieces at several places those pairs count whose object of the source has been replaced by that
    of the result, which ``replaced`` says (``old, new``); without it, or where it names neither, such pieces are left out, since nothing tells which belong together.
    """
    parts = cut(pieces(source, result))
    piece = ["component", "cbeg"]

    def at(build: DataFrame, name: str) -> DataFrame:
        return place(build, parts).withColumn(f"{name}_n", F.count("*").over(Window.partitionBy(*piece)))

    s = cut(at(source, "from").select(*piece, F.col("object").alias("from_object"), F.col("beg").alias("from_beg"), F.col("strand").alias("from_strand"), "from_n"))
    r = cut(at(result, "to"))
    j = r.where("to_n = 1").join(s.where("from_n = 1"), piece)
    if replaced is not None:
        known = replaced.select(F.col("old").alias("from_object"), F.col("new").alias("object")).distinct()
        # the accession that replaced a place's own goes with it, so a piece's places never meet all at once
        several = s.join(known, "from_object").join(r, [*piece, "object"]).where("to_n > 1 OR from_n > 1")
        j = j.unionByName(several.select(*j.columns))
    pairs = j.select(F.col("object").alias("seqid"), F.col("beg").alias("start"), (F.col("end") - F.col("beg") + 1).alias("length"), F.col("from_object").alias("component"), F.col("from_beg").alias("offset"), (F.col("strand") != F.col("from_strand")).alias("reversed"))
    return compact(pairs)


def compact(pairs: DataFrame) -> DataFrame:
    """Join pairs that follow each other on both sides in the same direction."""
    w = Window.partitionBy("seqid").orderBy("start")
    prev = lambda c: F.lag(c).over(w)
    follows = (prev("component") == F.col("component")) & (prev("reversed") == F.col("reversed")) & (prev("start") + prev("length") == F.col("start"))
    along = F.when(F.col("reversed"), F.col("offset") + F.col("length") == prev("offset")).otherwise(prev("offset") + prev("length") == F.col("offset"))
    runs = pairs.withColumn("_new", F.when(follows & along, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("seqid", "_run", "component", "reversed").agg(F.min("start").alias("start"), F.sum("length").alias("length"), F.min("offset").alias("offset")).select("seqid", "start", "length", "component", "offset", "reversed")


def remap_table(pairs: DataFrame) -> DataFrame:
    """The remap as it is written out, where the length is that from the first to the last base: one less than their number."""
    return pairs.withColumn("length", F.col("length") - 1)


def split_locations(agp: DataFrame, at: Column) -> DataFrame:
    """Records cut in two before place ``at`` of their component, if that lies inside; on the object a reversed one is cut from its end."""
    left = at - F.col("cbeg")
    inside = (at > F.col("cbeg")) & (at <= F.col("cend"))
    forward = F.col("strand") == 1
    part = lambda b, e, cb, ce: F.struct(b.alias("beg"), e.alias("end"), cb.alias("cbeg"), ce.alias("cend"))
    beg, end, cbeg, cend = (F.col(c).cast("long") for c in ("beg", "end", "cbeg", "cend"))
    first = part(F.when(forward, beg).otherwise(end - left + 1), F.when(forward, beg + left - 1).otherwise(end), cbeg, at.cast("long") - 1)
    second = part(F.when(forward, beg + left).otherwise(beg), F.when(forward, end).otherwise(end - left), at.cast("long"), cend)
    parts = F.when(inside, F.array(first, second)).otherwise(F.array(part(beg, end, cbeg, cend)))
    return agp.withColumn("_p", F.explode(parts)).select("object", "_p.beg", "_p.end", "component", "_p.cbeg", "_p.cend", "strand")
