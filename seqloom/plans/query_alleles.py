"""Queries on allele calling: benchmark items as loci, reads as contigs."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.operators import alleles as AL
from seqloom.plans import views as V
from seqloom.plans.registry import query
from seqloom.plans.views import VIEWS

#: Bases in a seed, and the fewest bases of a query.
SEED, FLANK = 15, 30
_TURN = "reverse(translate({0},'ACTG','TGAC'))"
VIEWS |= {
    "loci": ("", "SELECT item_id AS locus, upper(regexp_replace(coalesce(text,''),'[^ACGTacgt]','','g')) AS seq FROM benchmark"),
    "locus_ways": ("loci", f"SELECT locus, true AS plus, seq FROM loci WHERE length(seq) >= {FLANK} UNION ALL SELECT locus, false, {_TURN.format('seq')} FROM loci WHERE length(seq) >= {FLANK}"),
    "locus_diagonals": ("locus_ways reads", f"""SELECT locus, plus, contig, min(qpos) AS qfrom, max(qpos) + {SEED - 1} AS qto, min(qpos) - diagonal AS sfrom, max(qpos) + {SEED - 1} - diagonal AS sto, sum(CASE WHEN fresh THEN {SEED} ELSE step END) AS exact FROM
      (SELECT *, coalesce(step > {SEED}, true) AS fresh FROM (SELECT *, qpos - lag(qpos) OVER (PARTITION BY locus, plus, contig, diagonal ORDER BY qpos) AS step FROM (SELECT DISTINCT q.locus, q.plus, s.contig, q.qpos - s.spos AS diagonal, q.qpos FROM
      (SELECT locus, plus, i - 1 AS qpos, substr(seq, i, {SEED}) AS kmer FROM (SELECT locus, plus, seq, unnest(range(1, length(seq) - {SEED - 2})) AS i FROM locus_ways)) q JOIN
      (SELECT spotid AS contig, i - 1 AS spos, substr(bases, i, {SEED}) AS kmer FROM (SELECT spotid, bases, unnest(range(1, length(bases) - {SEED - 2})) AS i FROM reads WHERE length(bases) >= {SEED})) s USING (kmer)))) GROUP BY locus, plus, contig, diagonal"""),
}


def _loci(spark, d):
    return V.table(spark, d, "benchmark").select(F.col("item_id").alias("locus"), F.lit("1").alias("allele"), V.bases_of("text").alias("seq"))


def _contigs(spark, d):
    return V.reads(spark, d).select(F.col("spotid").alias("contig"), "bases")


def _called(spark, d):
    return AL.call_alleles(_loci(spark, d), _contigs(spark, d), SEED, flank=FLANK)


@query("d12_diagonal_candidates", "locus_diagonals", """SELECT d.locus, d.plus, contig, qfrom, qto, sfrom, sto, score FROM (SELECT *, len(list_filter(range(1, qto - qfrom + 2), lambda i: a[i:i] = b[i:i])) AS score FROM (SELECT d.*, substr(w.seq, qfrom + 1, qto - qfrom + 1) AS a, substr(r.bases, sfrom + 1, sto - sfrom + 1) AS b
  FROM locus_diagonals d JOIN locus_ways w USING (locus, plus) JOIN reads r ON r.spotid = d.contig WHERE exact >= 15)) d WHERE score > 0.5 * (qto - qfrom + 1)""")
def _(spark, d):
    q = AL.both_strands(_loci(spark, d).where(F.length("seq") >= FLANK))
    found = AL.diagonals(q, _contigs(spark, d), SEED)
    return found.select("locus", "plus", "contig", "qfrom", "qto", "sfrom", "sto", "score")


@query("d12_diagonal_chains")
def _(spark, d):
    q = AL.both_strands(_loci(spark, d).where(F.length("seq") >= FLANK))
    return AL.chains(AL.diagonals(q, _contigs(spark, d), SEED))


@query("d38_called_alleles")
def _(spark, d):
    return _called(spark, d).withColumn("identity", F.round("identity", 2))


@query("d6_allele_mappings")
def _(spark, d):
    return AL.format_mappings(_called(spark, d))


@query("d39_placed_loci")
def _(spark, d):
    """Placements without the tests of the reading frame, which invented letters would fail."""
    calls = _called(spark, d).withColumns({c: F.lit(True) for c in ("has_start", "has_stop", "consistent")})
    return AL.resolve_loci(calls, 20)
