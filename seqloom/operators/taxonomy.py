"""Operators on a taxonomy ``tax_id, parent_id`` whose root is 1."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators.store import cut

ROOT = 1
UNKNOWN = "unknown"


def lineages(taxonomy: DataFrame, most: int = 100) -> DataFrame:
    """``tax_id, lineage``: the path from the root, a level of the tree at a time; depth is bounded by ``most``, the number of taxa is not.

    A recursive query would stop at a million rows, and hand all of them out from one task.
    """
    edges = taxonomy.select(F.col("parent_id").cast("int").alias("_up"), F.col("tax_id").cast("int").alias("_down")).where(F.col("_down") != ROOT)
    level = taxonomy.sparkSession.range(1).select(F.lit(ROOT).alias("tax_id"), F.array(F.lit(ROOT)).alias("lineage"))
    levels = [level]
    for _ in range(most):
        level = cut(edges.join(level, edges["_up"] == level["tax_id"]).select(F.col("_down").alias("tax_id"), F.array_append("lineage", F.col("_down")).alias("lineage")))
        if level.isEmpty():
            return reduce(DataFrame.unionByName, levels)
        levels.append(level)
    raise ValueError(f"the tree has more than {most} levels or a circle")


def common_prefix(a: Column, b: Column) -> Column:
    n = F.least(F.size(a), F.size(b))
    same = F.size(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & (F.slice(a, F.lit(1), i) == F.slice(b, F.lit(1), i))))
    return F.slice(a, F.lit(1), same)


def consensus(rows: DataFrame, keys: list[str], lineage: DataFrame, tax: str = "tax_id") -> DataFrame:
    """The lowest common ancestor of each key's taxa: ``keys, tax_id``.

    The common prefix of all lineages is that of the smallest and the largest, so the aggregation combines before the shuffle.
    Ids of 0 and below outrank others (the smallest of them stays); the root absorbs all others; an id that the tree does
    not hold counts as hanging from the root.
    """
    # an id that the tree lacks has no lineage
    known = rows.join(lineage, rows[tax] == lineage["tax_id"], "left").select(*(rows[k] for k in keys), rows[tax].alias("_t"), F.coalesce("lineage", F.array(F.lit(ROOT), rows[tax].cast("int"))).alias("_l"))
    low = F.min(F.when(F.col("_t") > 0, F.col("_l"))).alias("lo")
    high = F.max(F.when(F.col("_t") > 0, F.col("_l"))).alias("hi")
    folded = known.groupBy(*keys).agg(low, high, F.bool_or(F.col("_t") == ROOT).alias("root"), F.min(F.when(F.col("_t") <= 0, F.col("_t"))).alias("odd"))
    lca = F.try_element_at(common_prefix(F.col("lo"), F.col("hi")), F.lit(-1))
    return folded.select(*keys, F.when(F.col("root"), ROOT).when(F.col("odd").isNotNull(), F.col("odd")).otherwise(F.coalesce(lca, F.lit(ROOT))).cast("int").alias("tax_id"))


def deepest_unambiguous(rows: DataFrame, keys: list[str], lineage: DataFrame, tax: str = "tax_id") -> DataFrame:
    """The most specific taxon that no hit contradicts: a chain of hits gives its deepest, a fork the node before it.

    A hit that is an ancestor of another hit says nothing, so it goes first; the rest meet at their common ancestor.
    """
    hits = rows.select(*keys, F.col(tax).alias("tax_id")).distinct().join(lineage, "tax_id")
    above = hits.select(*keys, F.explode(F.slice("lineage", F.lit(1), F.size("lineage") - 1)).alias("tax_id")).distinct()
    return consensus(hits.drop("lineage").join(above, [*keys, "tax_id"], "left_anti"), keys, lineage)


def descends(lineage: Column, ancestor: Column | int) -> Column:
    return F.array_contains(lineage, ancestor)


def level(lineage: Column) -> Column:
    return F.size(lineage)


def rollup(counts: DataFrame, taxonomy: DataFrame, lineage: DataFrame) -> DataFrame:
    """``tax_id, parent_id, rank, name, self_count, total_count`` of taxa that have hits below them.

    ``counts``: ``tax_id, n``.  A taxon that the tree lacks hangs from the root and is called unknown.
    """
    own = counts.groupBy("tax_id").agg(F.sum("n").alias("n"))
    paths = own.join(lineage, "tax_id", "left").withColumn("lineage", F.coalesce("lineage", F.array(F.lit(ROOT), F.col("tax_id"))))
    total = paths.select(F.explode("lineage").alias("a"), "n").groupBy("a").agg(F.sum("n").alias("total_count"))
    named = total.join(own.withColumnRenamed("tax_id", "a"), "a", "left").withColumnRenamed("a", "tax_id").join(taxonomy, "tax_id", "left")
    return named.select("tax_id", F.coalesce("parent_id", F.lit(ROOT)).alias("parent_id"), F.coalesce("rank", F.lit("")).alias("rank"), F.coalesce("name", F.lit(UNKNOWN)).alias("name"), F.coalesce("n", F.lit(0)).alias("self_count"), "total_count")


def tree_lines(rolled: DataFrame, lineage: DataFrame) -> DataFrame:
    """``path, line``: an XML tree of all taxa; lines in the order of ``path`` are the document.

    A taxon opens before its children, which come by falling total, and closes behind them; one without children is one line.  Attributes: tax_id, self_count, rank if it
    has one, name (``unknown`` if null) and total_count.  Each line is made alone, so no task holds the tree.
    """
    quoted = lambda c: F.replace(F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    told = lambda name, value, where: F.when(where, F.concat(F.lit(f' {name}="'), value.cast("string"), F.lit('"'))).otherwise("")
    yes = F.lit(True)
    tag = F.concat(
        F.lit("<taxon"), told("tax_id", F.col("tax_id"), yes), told("self_count", F.col("self_count"), yes), told("rank", quoted("rank"), F.coalesce(F.col("rank") != "", F.lit(False))),
        told("name", F.coalesce(quoted("name"), F.lit("unknown")), yes), told("total_count", F.col("total_count"), yes))
    rows = report_lines(rolled, lineage, 0.0).select("tax_id", "path", "depth").join(rolled.select("tax_id", "rank", "name", "self_count", "total_count"), "tax_id")
    parents = rolled.where(F.col("tax_id") != F.col("parent_id")).select(F.col("parent_id").alias("tax_id"), F.lit(True).alias("_inner")).distinct()
    rows = rows.join(parents, "tax_id", "left").withColumn("_pad", F.repeat(F.lit("  "), F.col("depth")))
    opens = F.struct(F.col("path").alias("path"), F.concat("_pad", tag, F.when(F.col("_inner"), ">").otherwise("/>")).alias("line"))
    closes = F.struct(F.concat("path", F.lit("/~")).alias("path"), F.concat("_pad", F.lit("</taxon>")).alias("line"))  # ~ sorts behind all steps
    return rows.select(F.explode(F.when(F.col("_inner"), F.array(opens, closes)).otherwise(F.array(opens))).alias("l")).select("l.*")


def report_lines(rolled: DataFrame, lineage: DataFrame, cutoff_percent: float = 0.01, cutoff_hits: int = 0, skip: str = "none") -> DataFrame:
    """Report rows ``path, tax_id, depth, name, percent, total_count`` in tree order, small taxa left out.

    ``path`` sorts children by falling total.  ``skip``: single children without hits of their own are left out for ``all``,
    or for ``unranked`` if they have no rank.
    """
    whole = rolled.where(F.col("tax_id") == ROOT).select(F.col("total_count").alias("whole"))
    big = rolled.crossJoin(F.broadcast(whole)).withColumn("percent", 100 * F.col("total_count") / F.col("whole"))  # one row: the root's
    big = big.where((F.col("percent") >= cutoff_percent) & (F.col("total_count") >= cutoff_hits))
    if skip != "none":
        children = big.where(F.col("tax_id") != F.col("parent_id")).groupBy(F.col("parent_id").alias("tax_id")).agg(F.count("*").alias("children"))
        single = (F.coalesce("children", F.lit(0)) == 1) & (F.col("self_count") == 0) & (F.col("tax_id") != ROOT)
        single = single & (F.col("rank") == "") if skip == "unranked" else single
        big = big.join(children, "tax_id", "left").where(~single)
    step = big.select(F.col("tax_id").alias("a"), F.concat(F.lpad((F.lit(10**15) - F.col("total_count")).cast("string"), 16, "0"), F.lit("."), F.lpad(F.col("tax_id").cast("string"), 10, "0")).alias("step"))
    walk = big.join(lineage, "tax_id", "left").withColumn("lineage", F.coalesce("lineage", F.array(F.lit(ROOT), F.col("tax_id")))).select("tax_id", "name", "percent", "total_count", F.posexplode("lineage").alias("at", "a")).join(step, "a")
    return walk.groupBy("tax_id", "name", "percent", "total_count").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "step"))), lambda x: x["step"]), "/").alias("path"), (F.count("*") - 1).cast("int").alias("depth"))


def apply_taxdump(nodes: DataFrame, fresh: DataFrame, merged: DataFrame, deleted: DataFrame) -> DataFrame:
    """``tax_id, parent_id, rank, name, change``: old nodes with a dump applied; change is kept, inserted, updated, merged or deleted.

    ``merged``: ``old_id, new_id``; a merged id takes the new id's row as its own.
    """
    cols = ["parent_id", "rank", "name"]
    after = fresh.select("tax_id", *(F.col(c).alias("n_" + c) for c in cols), F.lit(True).alias("there"))
    joined = nodes.withColumn("was", F.lit(True)).join(after, "tax_id", "full").join(deleted.select("tax_id", F.lit(True).alias("gone")), "tax_id", "left")
    alike = F.lit(True)
    for c in cols:
        alike = alike & F.col(c).eqNullSafe(F.col("n_" + c))
    change = F.when(F.col("gone"), "deleted").when(F.col("was").isNull(), "inserted").when(F.col("there").isNull() | alike, "kept").otherwise("updated")
    done = joined.select("tax_id", *(F.when(F.col("there"), F.col("n_" + c)).otherwise(F.col(c)).alias(c) for c in cols), change.alias("change"))
    moved = merged.join(fresh.withColumnRenamed("tax_id", "new_id"), "new_id").select(F.col("old_id").alias("tax_id"), *cols, F.lit("merged").alias("change"))
    return done.join(moved.select("tax_id"), "tax_id", "left_anti").unionByName(moved)


def order_by_total(rolled: DataFrame) -> DataFrame:
    """Rank of each taxon among its siblings, by falling total."""
    w = Window.partitionBy("parent_id").orderBy(F.desc("total_count"), "tax_id")
    return rolled.withColumn("place", F.row_number().over(w))
