"""Queries on intervals and feature counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.operators import features as FT
from seqloom.operators import intervals as IV
from seqloom.plans import views as V
from seqloom.plans.registry import query
from seqloom.sources import formats as FM
from seqloom.plans.views import VIEWS

VIEWS |= {
    "feature_merged": ("gtf", """SELECT id, ref, min(s) AS s, max(e) AS e FROM (SELECT *, sum(CASE WHEN s > top + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY id, ref ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island
      FROM (SELECT id, chrom AS ref, start AS s, "end" AS e, max("end") OVER (PARTITION BY id, chrom ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM gtf)) GROUP BY id, ref, island"""),
    "bounds": ("feature_merged", "SELECT ref, pos AS s, lead(pos) OVER (PARTITION BY ref ORDER BY pos) - 1 AS e FROM (SELECT DISTINCT ref, s AS pos FROM feature_merged UNION SELECT DISTINCT ref, e + 1 FROM feature_merged)"),
    "covered": ("bounds", "SELECT b.ref, b.s, b.e, count(*) AS depth FROM bounds b JOIN feature_merged m ON m.ref = b.ref AND m.s <= b.s AND m.e >= b.e GROUP BY b.ref, b.s, b.e"),
    "pieces": ("covered", "SELECT m.id, m.ref, m.s AS of_s, c.s, c.e, c.depth > 1 AS amb FROM feature_merged m JOIN covered c ON m.ref = c.ref AND m.s <= c.s AND m.e >= c.e"),
    "segs": ("pieces", """SELECT id, ref, amb, min(s) AS s, max(e) AS e FROM (SELECT *, sum(fresh) OVER (PARTITION BY id, ref, of_s ORDER BY s ROWS UNBOUNDED PRECEDING) AS run
      FROM (SELECT *, CASE WHEN lag(amb) OVER w = amb AND lag(e) OVER w = s - 1 THEN 0 ELSE 1 END AS fresh FROM pieces WINDOW w AS (PARTITION BY id, ref, of_s ORDER BY s))) GROUP BY id, ref, of_s, run, amb"""),
    "strands": ("gtf", "SELECT id, chrom AS ref, arg_min(strand, {'a': start, 'b': \"end\", 'c': strand}) = '-' AS reverse FROM gtf GROUP BY id, chrom"),
    "extents": ("feature_merged strands", "SELECT id, ref, min(s) AS s, max(e) AS e, any_value(reverse) AS reverse FROM feature_merged JOIN strands USING (id, ref) GROUP BY id, ref"),
    "steps": ("alignments", """SELECT id, refspec AS ref, refpos, i, ops[i] AS op, CASE WHEN nums[i] = '' THEN 1 ELSE CAST(nums[i] AS BIGINT) END AS n
      FROM (SELECT id, refspec, refpos, ops, nums, unnest(range(1, len(ops)+1)) AS i FROM (SELECT id, refspec, refpos, regexp_extract_all(cigar, '(\\d*)([MIDNSHP=X])', 2) AS ops, regexp_extract_all(cigar, '(\\d*)([MIDNSHP=X])', 1) AS nums FROM alignments))"""),
    "blocks": ("steps", """SELECT id, ref, refpos + before AS s, refpos + before + n - 1 AS e FROM (SELECT *, coalesce(sum(CASE WHEN op IN ('M','=','X','D','N') THEN n ELSE 0 END) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM steps) WHERE op IN ('M','=','X')"""),
    "aligned": ("blocks", "SELECT id, ref, min(s) AS s, max(e) AS e, sum(e - s + 1) AS total FROM blocks GROUP BY id, ref"),
    "met": ("aligned alignments extents", "SELECT a.id, a.ref, a.total, x.id AS feature FROM aligned a JOIN alignments l ON l.id = a.id JOIN extents x ON x.ref = a.ref AND a.s <= x.e AND a.e >= x.s AND x.reverse = l.reversed WHERE l.mapq >= 3"),
    "touched": ("met blocks segs", """SELECT m.id, m.feature, m.total, coalesce(bool_or(NOT g.amb), false) AS gen, coalesce(bool_or(g.amb), false) AS amb, coalesce(sum(CASE WHEN g.id IS NOT NULL THEN least(b.e, g.e) - greatest(b.s, g.s) + 1 END), 0) < m.total AS outside
      FROM met m JOIN blocks b ON b.id = m.id LEFT JOIN segs g ON g.id = m.feature AND g.ref = m.ref AND b.s <= g.e AND b.e >= g.s GROUP BY m.id, m.feature, m.total"""),
}
MODES = {
    "SIMPLE": "CASE WHEN gen OR amb THEN 'FEATURE' ELSE 'NO' END",
    "UNION": "CASE WHEN amb THEN 'AMBIGUOUS' WHEN gen THEN 'FEATURE' ELSE 'NO' END",
    "STRICT": "CASE WHEN outside THEN 'NO' WHEN gen THEN 'FEATURE' WHEN amb THEN 'AMBIGUOUS' ELSE 'NO' END",
    "NONEMPTY": "CASE WHEN gen THEN 'FEATURE' WHEN amb THEN 'AMBIGUOUS' ELSE 'NO' END",
}
for _m, _case in MODES.items():
    VIEWS[f"disposed_{_m.lower()}"] = ("touched alignments", f"""SELECT l.id, CASE WHEN l.mapq < 3 THEN 'LOW' WHEN f.amb > 0 THEN 'AMB' WHEN f.amb IS NULL THEN 'NOFT' WHEN f.hits = 1 THEN f.feature ELSE 'NC' END AS disposition FROM alignments l
      LEFT JOIN (SELECT id, count(*) FILTER (r = 'AMBIGUOUS') AS amb, count(*) FILTER (r = 'FEATURE') AS hits, max(CASE WHEN r = 'FEATURE' THEN feature END) AS feature FROM (SELECT *, {_case} AS r FROM touched) GROUP BY id) f ON f.id = l.id""")


def _ref(df):
    return df.withColumnRenamed("chrom", "ref")


@query("b1_gtf_scan", "gtf", "SELECT chrom, start, \"end\", strand, id FROM gtf WHERE \"end\" >= start")
def _(spark, d):
    return V.gtf(spark, d).where("end >= start")


@query("b11_reference_filter", "gtf", "SELECT id, count(*) AS n FROM gtf WHERE chrom IN ('chr1','chr3') GROUP BY id")
def _(spark, d):
    return V.gtf(spark, d).where(F.col("chrom").isin("chr1", "chr3")).groupBy("id").agg(F.count("*").alias("n"))


@query("b26_assemble_feature", "feature_merged", "SELECT id, ref, s AS start, e AS \"end\" FROM feature_merged")
def _(spark, d):
    return IV.merge_intervals(_ref(V.gtf(spark, d)), ["id", "ref"])


@query("b27_interval_merge", "", """SELECT k, min(s) AS start, max(e) AS "end" FROM (SELECT *, sum(CASE WHEN s > top + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island
  FROM (SELECT user_id AS k, epoch(date_trunc('second', ts))::BIGINT AS s, epoch(date_trunc('second', ts))::BIGINT + CAST(trunc(value) AS BIGINT) AS e, max(epoch(date_trunc('second', ts))::BIGINT + CAST(trunc(value) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY epoch(date_trunc('second', ts))::BIGINT, epoch(date_trunc('second', ts))::BIGINT + CAST(trunc(value) AS BIGINT) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM events)) GROUP BY k, island""")
def _(spark, d):
    s = F.unix_timestamp("ts")
    rows = V.table(spark, d, "events").select(F.col("user_id").alias("k"), s.alias("start"), (s + F.col("value").cast("long")).alias("end"))
    return IV.merge_intervals(rows, ["k"])


@query("b28_cigar_intervals", "blocks", """SELECT id, CAST(min(s) AS BIGINT) AS start, CAST(max(e) AS BIGINT) AS "end" FROM (SELECT *, sum(CASE WHEN s > top + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY s ROWS UNBOUNDED PRECEDING) AS island
  FROM (SELECT *, max(e) OVER (PARTITION BY id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM blocks)) GROUP BY id, island""")
def _(spark, d):
    a = V.alignments(spark, d)
    return a.select("id", F.explode(IV.cigar_segments(F.col("cigar"), F.col("refpos"))).alias("s")).select("id", "s.start", "s.end")


@query("b31_mark_ambiguous", "segs", "SELECT id, ref, s AS start, e AS \"end\", amb FROM segs")
def _(spark, d):
    return IV.mark_ambiguous(IV.merge_intervals(_ref(V.gtf(spark, d)), ["id", "ref"]))


@query("b12_interval_join", "alignments extents", "SELECT a.id, x.id AS feature FROM alignments a JOIN extents x ON x.ref = a.refspec AND a.refpos <= x.e AND a.refpos + a.length - 1 >= x.s")
def _(spark, d):
    a = V.alignments(spark, d).select("id", F.col("refspec").alias("ref"), F.col("refpos").alias("start"), (F.col("refpos") + F.col("length") - 1).alias("end"))
    f = FT.build_features(V.gtf(spark, d)).select("ref", F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.col("id").alias("feature"))
    return IV.range_join(a, f, ["ref"]).select("id", "feature")


@query("b13_slice_counts", "alignments extents", "SELECT x.id AS feature, x.ref, count(a.id) AS n FROM extents x LEFT JOIN alignments a ON x.ref = a.refspec AND a.refpos <= x.e AND a.refpos + a.length - 1 >= x.s AND a.reversed = x.reverse GROUP BY x.id, x.ref")
def _(spark, d):
    a = V.alignments(spark, d).select(F.col("refspec").alias("ref"), F.col("refpos").alias("r_start"), (F.col("refpos") + F.col("length") - 1).alias("r_end"), "reversed")
    f = FT.build_features(V.gtf(spark, d)).select("ref", "start", "end", F.col("id").alias("feature"), "reverse")
    n = IV.range_join(f, a, ["ref"]).where("reversed = reverse").groupBy("feature", "ref").agg(F.count("*").alias("n"))
    return f.select("feature", "ref").join(n, ["feature", "ref"], "left").select("feature", "ref", F.coalesce("n", F.lit(0)).alias("n"))


def _disposed(spark, d, mode):
    return FT.dispositions(V.alignments(spark, d), FT.build_features(V.gtf(spark, d)), mode, 3)


@query("b18_disposition", "disposed_union", "SELECT id, disposition FROM disposed_union")
def _(spark, d):
    return _disposed(spark, d, "UNION")


for _m in MODES:
    @query(f"b21_policy_{_m.lower()}", f"disposed_{_m.lower()}", f"SELECT disposition, count(*) AS n FROM disposed_{_m.lower()} GROUP BY disposition")
    def _(spark, d, mode=_m):
        return _disposed(spark, d, mode).groupBy("disposition").agg(F.count("*").alias("n"))


@query("b19_count_by_value", "disposed_union", "SELECT CASE WHEN disposition IN ('LOW','AMB','NOFT','NC') THEN disposition ELSE 'FEATURE' END AS kind, count(*) AS n FROM disposed_union GROUP BY 1")
def _(spark, d):
    kind = F.when(F.col("disposition").isin("LOW", "AMB", "NOFT", "NC"), F.col("disposition")).otherwise("FEATURE")
    return _disposed(spark, d, "UNION").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("b20_zero_filled_counts", "disposed_union extents", "SELECT x.id, count(u.id) AS n FROM (SELECT DISTINCT id FROM extents) x LEFT JOIN disposed_union u ON u.disposition = x.id GROUP BY x.id")
def _(spark, d):
    f = FT.build_features(V.gtf(spark, d))
    return FT.count_features(FT.dispositions(V.alignments(spark, d), f, "UNION", 3), f)


@query("b22_counters", "disposed_strict", "SELECT count(*) AS alignments, count(*) FILTER (disposition NOT IN ('LOW','AMB','NOFT','NC')) AS counted, count(*) FILTER (disposition = 'LOW') AS low, count(*) FILTER (disposition = 'AMB') AS amb, count(*) FILTER (disposition = 'NOFT') AS noft, count(*) FILTER (disposition = 'NC') AS nc FROM disposed_strict")
def _(spark, d):
    return FT.counters(_disposed(spark, d, "STRICT"))


@query("b23_attribute_reduce", "segs alignments", """SELECT x.id AS feature, coalesce(n, 0) AS n FROM (SELECT DISTINCT id FROM segs WHERE NOT amb) x LEFT JOIN (SELECT feature, count(*) AS n FROM (SELECT a.id, max(g.id) AS feature FROM alignments a
  JOIN segs g ON g.ref = a.refspec AND a.refpos <= g.e AND a.refpos + a.length - 1 >= g.s GROUP BY a.id HAVING count(DISTINCT g.id) = 1 AND NOT bool_or(g.amb)) GROUP BY feature) c ON c.feature = x.id""")
def _(spark, d):
    iv = IV.mark_ambiguous(IV.merge_intervals(_ref(V.gtf(spark, d)), ["id", "ref"])).withColumn("iv_type", F.when(F.col("amb"), "AMBIGUOUS").otherwise("FEATURE"))
    a = V.alignments(spark, d).select("id", F.col("refspec").alias("ref"), F.col("refpos").alias("start"), (F.col("refpos") + F.col("length") - 1).alias("end"))
    return FT.interval_counts(iv, a)


@query("b24_unaligned_count", "", "SELECT count(*) AS reads, CAST(sum(CASE WHEN aligned = 0 THEN n ELSE n - 1 END) AS BIGINT) AS unaligned FROM (SELECT conv_id, count(*) AS n, count(*) FILTER (role = 'assistant' AND turn > 1) AS aligned FROM conversations GROUP BY conv_id)")
def _(spark, d):
    c = V.table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if((F.col("role") == "assistant") & (F.col("turn") > 1)).alias("aligned"))
    return c.agg(F.count("*").alias("reads"), F.sum(F.when(F.col("aligned") == 0, F.col("n")).otherwise(F.col("n") - 1)).alias("unaligned"))


@query("b15_reference_match", "gtf alignments", """SELECT name, side FROM (SELECT r AS name, 'both' AS side FROM (SELECT DISTINCT chrom AS r FROM gtf WHERE chrom <> 'chr4') WHERE r IN (SELECT DISTINCT refspec FROM alignments WHERE refspec <> 'chr0')
  UNION ALL SELECT DISTINCT 'NC_' || substr(refspec, 4), 'run' FROM alignments WHERE refspec <> 'chr0' AND refspec NOT IN (SELECT chrom FROM gtf WHERE chrom <> 'chr4') UNION ALL SELECT DISTINCT chrom, 'annotation' FROM gtf WHERE chrom <> 'chr4' AND chrom NOT IN (SELECT refspec FROM alignments WHERE refspec <> 'chr0'))""")
def _(spark, d):
    run = V.alignments(spark, d).where("refspec <> 'chr0'").select("refspec").distinct().select(F.concat(F.lit("NC_"), F.substring("refspec", 4, 99)).alias("canonical"), F.col("refspec").alias("common"))
    return FT.match_references(V.gtf(spark, d).where("chrom <> 'chr4'").select(F.col("chrom").alias("name")), run)


@query("b16_reference_translation", "gtf", "SELECT CASE chrom WHEN 'chr1' THEN '1' WHEN 'chr2' THEN '2' ELSE chrom END AS ref, count(*) AS n FROM gtf GROUP BY 1")
def _(spark, d):
    names = spark.createDataFrame([("chr1", "1"), ("chr2", "2")], "key string, value string")
    return FT.translate_references(_ref(V.gtf(spark, d)), names).groupBy("ref").agg(F.count("*").alias("n"))


@query("b25_aligned_on_matched", "alignments gtf", "SELECT refspec, count(*) AS n, CAST(sum(length) AS BIGINT) AS bases FROM alignments WHERE refspec IN (SELECT chrom FROM gtf WHERE chrom <> 'chr4') GROUP BY refspec")
def _(spark, d):
    known = V.gtf(spark, d).where("chrom <> 'chr4'").select(F.col("chrom").alias("refspec")).distinct()
    return V.alignments(spark, d).join(known, "refspec", "left_semi").groupBy("refspec").agg(F.count("*").alias("n"), F.sum("length").alias("bases"))


@query("b29_lookup_statistics", "extents", "SELECT ref, count(*) AS features, min(s) AS first, max(e) AS last, count(DISTINCT s // 5000) AS bins, max(e - s + 1) AS longest FROM extents GROUP BY ref")
def _(spark, d):
    return FT.build_features(V.gtf(spark, d)).groupBy("ref").agg(F.count("*").alias("features"), F.min("start").alias("first"), F.max("end").alias("last"), F.count_distinct(F.expr("start DIV 5000")).alias("bins"), F.max(F.expr("end - start + 1")).alias("longest"))


@query("b30_sortedness", "gtf", "SELECT chrom, NOT bool_or(falls) AS sorted FROM (SELECT chrom, coalesce(lag(start) OVER (PARTITION BY chrom ORDER BY strand, start, \"end\") > start, false) AS falls FROM gtf) GROUP BY chrom")
def _(spark, d):
    return IV.is_sorted(V.gtf(spark, d), "chrom", ["strand", "start", "end"])


@query("b32_gap_insertion", "gtf", """WITH k AS (SELECT chrom, s, e FROM (SELECT chrom, start AS s, "end" AS e, coalesce(max("end") OVER (PARTITION BY chrom ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM gtf) WHERE s > top),
  b AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY chrom ORDER BY s, e), 0) AS before FROM k)
  SELECT chrom, s AS start, e AS "end", 'FEATURE' AS iv_type FROM b UNION ALL SELECT chrom, before + 1, s - 1, 'GAP' FROM b WHERE s > before + 1 UNION ALL SELECT chrom, max(e) + 1, max(e) + 2147483647, 'GAP' FROM b GROUP BY chrom""")
def _(spark, d):
    return IV.insert_gaps(V.gtf(spark, d), "chrom")


@query("b33_event_stream", "gtf", """SELECT chrom, pos, CASE WHEN bool_or(ev = 's') AND bool_or(ev = 'e') THEN 'jump' WHEN bool_or(ev = 's') THEN 'start' ELSE 'end' END AS event FROM (SELECT chrom, start AS pos, 's' AS ev FROM gtf UNION ALL SELECT chrom, "end" + 1, 'e' FROM gtf) GROUP BY chrom, pos""")
def _(spark, d):
    return IV.events(V.gtf(spark, d), "chrom")


@query("b34_sorted_features", "extents", "SELECT ref, id, s AS start, CAST(row_number() OVER (PARTITION BY ref ORDER BY s, e, id) AS INTEGER) AS place FROM extents")
def _(spark, d):
    from pyspark.sql import Window

    f = FT.build_features(V.gtf(spark, d))
    return f.select("ref", "id", "start", F.row_number().over(Window.partitionBy("ref").orderBy("start", "end", "id")).alias("place"))


@query("b35_reference_difference", "gtf alignments", "SELECT 'annotation' AS side, count(*) AS n FROM (SELECT chrom || strand FROM gtf EXCEPT SELECT refspec || CASE WHEN mapq > 5 THEN '+' ELSE '*' END FROM alignments) UNION ALL SELECT 'run', count(*) FROM (SELECT refspec || CASE WHEN mapq > 5 THEN '+' ELSE '*' END FROM alignments EXCEPT SELECT chrom || strand FROM gtf)")
def _(spark, d):
    g = V.gtf(spark, d).select(F.concat("chrom", "strand").alias("r"))
    a = V.alignments(spark, d).select(F.concat("refspec", F.when(F.col("mapq") > 5, "+").otherwise("*")).alias("r"))
    side = lambda x, y, name: x.subtract(y).agg(F.count("*").alias("n")).select(F.lit(name).alias("side"), "n")
    return side(g, a, "annotation").union(side(a, g, "run"))


@query("b2_feature_file", "segs", "SELECT id, ref, s AS start, e AS \"end\", amb FROM segs")
def _(spark, d):
    lines = FM.format_features(FT.build_features(V.gtf(spark, d)))
    return FM.parse_features(lines).select("id", "ref", F.explode("segs").alias("s")).select("id", "ref", "s.start", "s.end", "s.amb")


@query("b3_reference_names", "", "SELECT n_name AS key, CAST(n_nationkey AS VARCHAR) AS value FROM nation")
def _(spark, d):
    line = F.concat("n_name", F.lit(" = "), F.col("n_nationkey").cast("string")).alias("line")
    return FM.parse_pairs(V.table(spark, d, "nation").select(line).union(spark.sql("SELECT '# a = comment' AS line")))
