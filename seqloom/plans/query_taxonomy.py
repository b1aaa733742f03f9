"""Queries on the taxonomy."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.operators import taxonomy as TX
from seqloom.plans import views as V
from seqloom.plans.registry import query
from seqloom.sources import formats as FM
from seqloom.plans.views import VIEWS

#: Hits of spots: the customers that bought from a supplier, by order month, as taxa.
VIEWS |= {
    "tax_hits": ("", "SELECT l_suppkey AS spotid, CAST(o_custkey + 1000 AS INTEGER) AS tax_id, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2"),
    "few_hits": ("tax_hits", "SELECT spotid * 7 + tax_id % 7 AS spotid, tax_id, n FROM tax_hits UNION ALL SELECT DISTINCT spotid * 7 + tax_id % 7, CAST(100 + tax_id % 2 AS INTEGER), 1 FROM tax_hits WHERE tax_id % 3 = 0"),
    "self_counts": ("", "SELECT CAST(o_custkey + 1000 AS INTEGER) AS tax_id, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT n_nationkey + 100, 3 FROM nation"),
    "lca": ("few_hits lineage", """SELECT spotid, x[len(x)] AS tax_id FROM (SELECT spotid, list_filter(list_transform(range(1, least(len(lo), len(hi))+1), lambda i: CASE WHEN lo[1:i] = hi[1:i] THEN lo[i] END), lambda v: v IS NOT NULL) AS x
      FROM (SELECT spotid, min(lineage) AS lo, max(lineage) AS hi FROM few_hits JOIN lineage USING (tax_id) GROUP BY spotid))"""),
    "rolled": ("self_counts lineage taxonomy", """SELECT a AS tax_id, coalesce(parent_id, 1) AS parent_id, rank, name, coalesce(own, 0) AS self_count, total AS total_count FROM
      (SELECT a, CAST(sum(n) AS BIGINT) AS total, CAST(sum(CASE WHEN a = tax_id THEN n END) AS BIGINT) AS own FROM (SELECT tax_id, n, unnest(lineage) AS a FROM self_counts JOIN lineage USING (tax_id)) GROUP BY a) JOIN taxonomy ON taxonomy.tax_id = a"""),
}


def _hits(spark, d):
    l, o = V.table(spark, d, "lineitem"), V.table(spark, d, "orders")  # noqa: E741
    h = l.join(o, l.l_orderkey == o.o_orderkey).groupBy(F.col("l_suppkey").alias("spotid"), (F.col("o_custkey") + 1000).cast("int").alias("tax_id")).agg(F.count("*").alias("n"))
    spot = F.expr("spotid * 7 + tax_id % 7").alias("spotid")
    up = h.where("tax_id % 3 = 0").select(spot, (100 + F.col("tax_id") % 2).cast("int").alias("tax_id"), F.lit(1).cast("long").alias("n")).distinct()
    return h.select(spot, "tax_id", "n").union(up)


def _self_counts(spark, d):
    o = V.table(spark, d, "orders").groupBy((F.col("o_custkey") + 1000).cast("int").alias("tax_id")).agg(F.count("*").alias("n"))
    return o.union(V.table(spark, d, "nation").select((F.col("n_nationkey") + 100).alias("tax_id"), F.lit(3).cast("long").alias("n")))


def _rolled(spark, d):
    t = V.taxonomy(spark, d)
    return TX.rollup(_self_counts(spark, d), t, TX.lineages(t))


@query("c7_taxonomy_scan", "taxonomy", "SELECT rank, count(*) AS n, min(tax_id) AS first FROM taxonomy WHERE tax_id > 0 AND parent_id > 0 GROUP BY rank")
def _(spark, d):
    return V.taxonomy(spark, d).where("tax_id > 0 AND parent_id > 0").groupBy("rank").agg(F.count("*").alias("n"), F.min("tax_id").alias("first"))


@query("c91_lineage", "lineage", "SELECT tax_id, list_aggregate(lineage, 'string_agg', '/') AS path, CAST(len(lineage) AS INTEGER) AS level FROM lineage")
def _(spark, d):
    return TX.lineages(V.taxonomy(spark, d)).select("tax_id", F.array_join(F.col("lineage").cast("array<string>"), "/").alias("path"), TX.level(F.col("lineage")).alias("level"))


@query("c90_descendants", "lineage", "SELECT a.r_regionkey AS region, count(*) AS n FROM region a JOIN lineage l ON list_contains(l.lineage, a.r_regionkey + 10) GROUP BY 1")
def _(spark, d):
    lin = TX.lineages(V.taxonomy(spark, d)).select(F.explode("lineage").alias("a"))
    r = V.table(spark, d, "region").select(F.col("r_regionkey").alias("region"), (F.col("r_regionkey") + 10).alias("a"))
    return lin.join(r, "a").groupBy("region").agg(F.count("*").alias("n"))


@query("c44_consensus", "lca", "SELECT spotid, tax_id FROM lca")
def _(spark, d):
    return TX.consensus(_hits(spark, d), ["spotid"], TX.lineages(V.taxonomy(spark, d)))


@query("c54_deduced_taxon", "few_hits lineage", """WITH h AS (SELECT DISTINCT spotid, tax_id, lineage FROM few_hits JOIN lineage USING (tax_id)),
  top AS (SELECT a.spotid, a.tax_id, a.lineage FROM h a WHERE NOT EXISTS (SELECT 1 FROM h b WHERE b.spotid = a.spotid AND b.tax_id <> a.tax_id AND list_contains(b.lineage, a.tax_id)))
  SELECT spotid, x[len(x)] AS tax_id FROM (SELECT spotid, list_filter(list_transform(range(1, least(len(lo), len(hi))+1), lambda i: CASE WHEN lo[1:i] = hi[1:i] THEN lo[i] END), lambda v: v IS NOT NULL) AS x FROM (SELECT spotid, min(lineage) AS lo, max(lineage) AS hi FROM top GROUP BY spotid))""")
def _(spark, d):
    return TX.deepest_unambiguous(_hits(spark, d), ["spotid"], TX.lineages(V.taxonomy(spark, d)))


@query("c56_tree_rollup", "rolled", "SELECT * FROM rolled")
def _(spark, d):
    return _rolled(spark, d)


@query("c57_kmer_mode_rollup", "few_hits lineage", "SELECT a AS tax_id, CAST(sum(n) AS BIGINT) AS total_count FROM (SELECT n, unnest(lineage) AS a FROM few_hits JOIN lineage USING (tax_id)) GROUP BY a")
def _(spark, d):
    t = V.taxonomy(spark, d)
    return TX.rollup(_hits(spark, d).select("tax_id", "n"), t, TX.lineages(t)).select("tax_id", "total_count")


@query("c55_spot_merge", "few_hits", "SELECT spotid, string_agg(tax_id || 'x' || n, ' ' ORDER BY tax_id) AS hits FROM (SELECT spotid, tax_id, CAST(sum(n) AS BIGINT) AS n FROM few_hits GROUP BY spotid, tax_id) GROUP BY spotid")
def _(spark, d):
    from seqloom.operators.kmerdb import collate

    return collate(_hits(spark, d)).select("spotid", F.array_join(F.transform("hits", lambda h: F.concat(h["tax_id"], F.lit("x"), h["n"])), " ").alias("hits"))


@query("c102_tree_report", "rolled lineage", "SELECT r.tax_id, r.name, round(100.0 * total_count / (SELECT total_count FROM rolled WHERE tax_id = 1), 6) AS percent, total_count, CAST(len(lineage) - 1 AS INTEGER) AS depth FROM rolled r JOIN lineage USING (tax_id) WHERE 100.0 * total_count / (SELECT total_count FROM rolled WHERE tax_id = 1) >= 0.08")
def _(spark, d):
    return TX.report_lines(_rolled(spark, d), TX.lineages(V.taxonomy(spark, d)), 0.08).select("tax_id", "name", F.round("percent", 6).alias("percent"), "total_count", "depth")


@query("c18_children_by_total", "rolled", "SELECT tax_id, parent_id, total_count, CAST(row_number() OVER (PARTITION BY parent_id ORDER BY total_count DESC, tax_id) AS INTEGER) AS place FROM rolled")
def _(spark, d):
    return TX.order_by_total(_rolled(spark, d)).select("tax_id", "parent_id", "total_count", "place")


@query("c18_tree_lines", "rolled lineage", """SELECT repeat('  ', CAST(len(lineage) - 1 AS INTEGER)) || line AS line FROM (SELECT tax_id, '<taxon tax_id="' || tax_id || '" self_count="' || self_count || '" rank="' || rank || '" name="' || name || '" total_count="' || total_count || '"' ||
  CASE WHEN tax_id IN (SELECT parent_id FROM rolled WHERE tax_id <> parent_id) THEN '>' ELSE '/>' END AS line FROM rolled UNION ALL SELECT tax_id, '</taxon>' FROM rolled WHERE tax_id IN (SELECT parent_id FROM rolled WHERE tax_id <> parent_id)) JOIN lineage USING (tax_id)""")
def _(spark, d):
    return TX.tree_lines(_rolled(spark, d), TX.lineages(V.taxonomy(spark, d))).select("line")


@query("c60_taxdump_changes", "taxonomy", """SELECT change, count(*) AS n FROM (SELECT CASE WHEN tax_id % 13 = 0 THEN 'deleted' WHEN tax_id % 11 = 0 AND tax_id > 1000 THEN 'merged' WHEN tax_id % 5 = 0 AND rank = 'customer' THEN 'inserted' WHEN rank = 'customer' AND tax_id % 7 = 0 THEN 'updated' ELSE 'kept' END AS change FROM taxonomy) GROUP BY change""")
def _(spark, d):
    t = V.taxonomy(spark, d)
    fresh = t.withColumn("name", F.when((F.col("rank") == "customer") & (F.col("tax_id") % 7 == 0), F.concat("name", F.lit(" new"))).otherwise(F.col("name")))
    old = t.where("NOT (tax_id % 5 = 0 AND rank = 'customer')")
    merged = t.where("tax_id % 11 = 0 AND tax_id > 1000 AND tax_id % 13 <> 0").select(F.col("tax_id").alias("old_id"), F.lit(100).alias("new_id"))
    return TX.apply_taxdump(old, fresh, merged, t.where("tax_id % 13 = 0").select("tax_id")).groupBy("change").agg(F.count("*").alias("n"))


@query("c8_taxdump_scan", "taxonomy", "SELECT CAST(tax_id AS VARCHAR) AS tax_id, CAST(parent_id AS VARCHAR) AS parent_id, rank FROM taxonomy")
def _(spark, d):
    columns = [F.col(c).cast("string") for c in ("tax_id", "parent_id", "rank")]
    line = F.concat(F.concat_ws("\t|\t", *columns), F.lit("\t|")).alias("line")
    return FM.parse_taxdump(V.taxonomy(spark, d).select(line), ["tax_id", "parent_id", "rank"])
