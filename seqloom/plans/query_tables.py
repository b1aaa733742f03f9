"""Queries on declared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.functions import seq as S
from seqloom.plans import tables as TB
from seqloom.plans import views as V
from seqloom.plans.registry import query
from seqloom.plans.views import VIEWS

VIEWS |= {
    "spots": ("fragments", "SELECT spotid AS id, string_agg(bases, '' ORDER BY frag) AS bases, string_agg(quals, '' ORDER BY frag) AS qualities, min(readgroup) AS readgroup, CAST(count(*) AS INTEGER) AS nfragments FROM fragments GROUP BY spotid"),
    "per_base": ("alignments", "SELECT id, refspec, mapq, unnest(range(refpos, refpos + length)) AS refpos FROM alignments"),
}


def _job(spark, d, tables, sql):
    a, f = V.alignments(spark, d), V.fragments(spark, d)
    sources = {"run.ALIG": a, "run.FRAG": f.withColumnsRenamed({"spotid": "id", "quals": "qualities"}), "run.SPOT": TB.spots(f)}
    return TB.run_job(spark, TB.JobOptions.parse(f"OUT=out\nTEMP=tmp\nSQL={sql}\n{tables}"), sources)


@query("a1_alig_scan", "alignments", "SELECT id, refspec, refpos, mapq FROM alignments WHERE refspec = 'chr2' AND refpos >= 1000 AND refpos < 6000")
def _(spark, d):
    return TB.scan(TB.TableSpec.parse("t = run.ALIG {mapq, refpos, id, refspec} #@chr2:1000.5000"), V.alignments(spark, d))


@query("a2_spot_scan", "spots", "SELECT id, bases, readgroup, nfragments FROM spots")
def _(spark, d):
    return TB.spots(V.fragments(spark, d)).select("id", "bases", "readgroup", "nfragments")


@query("a3_frag_scan", "fragments", "SELECT spotid AS id, bases, readgroup, quals AS qualities FROM fragments")
def _(spark, d):
    return TB.scan(TB.TableSpec.parse("t = run.FRAG {id, bases, readgroup, qualities}"), V.fragments(spark, d).withColumnsRenamed({"spotid": "id", "quals": "qualities"}))


@query("a4_ref_scan", "alignments", "SELECT refspec, max(refpos + length - 1) AS length, count(*) AS nalignments, false AS circular FROM alignments GROUP BY refspec")
def _(spark, d):
    return V.alignments(spark, d).groupBy("refspec").agg(F.max(F.col("refpos") + F.col("length") - 1).alias("length"), F.count("*").alias("nalignments")).withColumn("circular", F.lit(False))


@query("a5_rdgrp_scan", "alignments", "SELECT DISTINCT readgroup AS name FROM alignments")
def _(spark, d):
    return V.alignments(spark, d).select(F.col("readgroup").alias("name")).distinct()


@query("a6_pileup_scan", "per_base", "SELECT refspec, refpos, count(*) AS depth FROM per_base GROUP BY refspec, refpos")
def _(spark, d):
    return TB.depth(V.alignments(spark, d))


@query("a6_pileup_events", "per_base", "SELECT refspec, refpos, id, mapq, count(*) OVER (PARTITION BY refspec, refpos) AS depth FROM per_base")
def _(spark, d):
    return TB.pileup(V.alignments(spark, d)).select("refspec", "refpos", "id", "mapq", "depth")


@query("a7_declared_table", "alignments", "SELECT refspec, count(*) AS n FROM alignments WHERE refspec IN ('chr1', 'chr3') GROUP BY refspec")
def _(spark, d):
    return _job(spark, d, "t = run.ALIG {id, refspec} #@chr1 #@chr3 %500", "SELECT refspec, count(*) AS n FROM t GROUP BY refspec")


@query("a8_sql_job", "spots", "SELECT readgroup, count(*) AS n, CAST(sum(nfragments) AS BIGINT) AS frags FROM spots GROUP BY readgroup")
def _(spark, d):
    return _job(spark, d, "# spots\ns = run {readgroup, nfragments}", "SELECT readgroup, count(*) AS n, sum(nfragments) AS frags FROM s GROUP BY readgroup")


@query("a18_sql_where", "alignments", "SELECT id, cigar FROM alignments WHERE cigar LIKE '%D%' OR cigar LIKE '%N%'")
def _(spark, d):
    return _job(spark, d, "t = run.ALIG {id, cigar}", "SELECT id, cigar FROM t WHERE cigar LIKE '%D%' OR cigar LIKE '%N%'")


@query("a20_sql_join", "alignments fragments", "SELECT f.readgroup, a.refspec, count(*) AS n FROM alignments a JOIN fragments f ON CAST(f.spotid AS VARCHAR) = a.readid GROUP BY 1, 2")
def _(spark, d):
    return _job(spark, d, "a = run.ALIG {readid, refspec}\nf = run.FRAG {id, readgroup}", "SELECT f.readgroup, a.refspec, count(*) AS n FROM a JOIN f ON CAST(f.id AS STRING) = a.readid GROUP BY 1, 2")


@query("a21_sql_aggregate", "alignments", "SELECT readgroup, count(DISTINCT cigar) AS cigars, count(cigar) AS n, round(avg(mapq), 6) AS mapq FROM alignments GROUP BY readgroup")
def _(spark, d):
    return _job(spark, d, "t = run.ALIG {readgroup, cigar, mapq}", "SELECT readgroup, count(DISTINCT cigar) AS cigars, count(cigar) AS n, round(avg(mapq), 6) AS mapq FROM t GROUP BY readgroup")


@query("a22_sql_order_limit", "alignments", "SELECT id, refpos FROM alignments ORDER BY refpos DESC, id LIMIT 100")
def _(spark, d):
    return _job(spark, d, "t = run.ALIG {id, refpos}", "SELECT id, refpos FROM t ORDER BY refpos DESC, id LIMIT 100")


@query("a12_csv_lines", "alignments", "SELECT '\"' || id || '\",\"' || refspec || '\",' || refpos || ',' || mapq AS line FROM alignments")
def _(spark, d):
    return TB.delimited_lines(V.alignments(spark, d).select("id", "refspec", "refpos", "mapq"))


@query("a13_fastq_lines", "spots", "SELECT '@' || id || chr(10) || bases || chr(10) || '+' || id || chr(10) || qualities AS line FROM spots")
def _(spark, d):
    return TB.fastq_lines(TB.spots(V.fragments(spark, d)))


@query("c13_quality_mask", "fragments", "SELECT spotid, frag, regexp_replace(bases, '[GT]', 'N', 'g') AS bases FROM (SELECT spotid, frag, translate(bases, 'G', 'T') AS bases FROM fragments) ")
def _(spark, d):
    f = V.fragments(spark, d)
    return f.select("spotid", "frag", S.quality_mask("bases", "quals").alias("bases"))


@query("c10_sam_sequences", "alignments", "SELECT id, refspec || ':' || refpos AS place FROM alignments WHERE mapq > 8")
def _(spark, d):
    from seqloom.sources.formats import parse_sam

    a = V.alignments(spark, d)
    line = F.concat_ws("\t", "id", F.lit("0"), "refspec", F.col("refpos").cast("string"), F.col("mapq").cast("string"), "cigar", F.lit("*"), F.lit("0"), F.lit("0"), F.lit("acgt"), F.lit("*"))
    sam = parse_sam(a.select(line.alias("line")).union(spark.sql("SELECT '@HD\tVN:1.6' AS line")))
    return sam.where("mapq > 8").select("id", F.concat_ws(":", "refspec", F.col("refpos").cast("string")).alias("place"))
