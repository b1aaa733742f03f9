"""Queries on k-mer graphs, contigs, alleles and assembly descriptions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seqloom.functions import seq as S
from seqloom.operators import agp as AG
from seqloom.operators import alignment as AL
from seqloom.operators import assembly as AS
from seqloom.operators import graph as GR
from seqloom.operators import kmerdb as KD
from seqloom.operators import mates as MT
from seqloom.operators.store import cut, shared_folder
from seqloom.plans import views as V
from seqloom.plans.registry import query
from seqloom.plans.views import K, VIEWS
from seqloom.sources.files import read_nested

_CANON = "translate(least(translate({0},'ACTG','0123'), translate(reverse(translate({0},'ACTG','TGAC')),'ACTG','0123')),'0123','ACTG')"
_AGP = "sum(100 + c_custkey % 50) OVER (PARTITION BY {0} ORDER BY {1} ROWS UNBOUNDED PRECEDING)"
VIEWS |= {
    "nodes": ("coded", "SELECT kmer, count(*) AS n FROM coded GROUP BY kmer HAVING count(*) >= 10"),
    "edges": ("nodes", f"SELECT t.kmer, t.side, t.base, t.next, m.n FROM (SELECT kmer, side, base, {_CANON.format('x')} AS next FROM (SELECT kmer, side, base, CASE side WHEN 'R' THEN substr(kmer, 2) || base ELSE base || substr(kmer, 1, {K-1}) END AS x FROM nodes, (VALUES ('R'), ('L')) s(side), (VALUES ('A'), ('C'), ('G'), ('T')) b(base))) t JOIN nodes m ON m.kmer = t.next WHERE t.next <> t.kmer"),
    "agp_old": ("", f"SELECT 'scaf' || c_nationkey AS object, CAST(e - (100 + c_custkey % 50) + 1 AS BIGINT) AS beg, CAST(e AS BIGINT) AS \"end\", 'ctg' || c_custkey AS component, CAST(1 AS BIGINT) AS cbeg, 100 + c_custkey % 50 AS cend, CASE WHEN c_custkey % 3 = 0 THEN -1 ELSE 1 END AS strand FROM (SELECT *, {_AGP.format('c_nationkey', 'c_custkey')} AS e FROM customer)"),
    "agp_new": ("", f"SELECT 'chrom' || (c_nationkey % 5) AS object, CAST(e - (100 + c_custkey % 50) + 1 AS BIGINT) AS beg, CAST(e AS BIGINT) AS \"end\", 'ctg' || c_custkey AS component, CAST(1 AS BIGINT) AS cbeg, 100 + c_custkey % 50 AS cend, CASE WHEN c_custkey % 2 = 0 THEN -1 ELSE 1 END AS strand FROM (SELECT *, {_AGP.format('c_nationkey % 5', 'c_acctbal, c_custkey')} AS e FROM customer WHERE c_custkey % 10 <> 7)"),
}


def _nodes(spark, d):
    return KD.count_kmers(V.reads(spark, d), K, 10).select(S.decode("kmer", K).alias("kmer"), "n")


def _agp(spark, d, new):
    c = V.table(spark, d, "customer")
    n = 100 + F.col("c_custkey") % 50
    if new:
        c = c.where("c_custkey % 10 <> 7").withColumn("g", F.concat(F.lit("chrom"), F.col("c_nationkey") % 5))
        w, back = Window.partitionBy("g").orderBy("c_acctbal", "c_custkey"), 2
    else:
        c = c.withColumn("g", F.concat(F.lit("scaf"), F.col("c_nationkey")))
        w, back = Window.partitionBy("g").orderBy("c_custkey"), 3
    e = F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return c.select(F.col("g").alias("object"), (e - n + 1).alias("beg"), e.alias("end"), F.concat(F.lit("ctg"), F.col("c_custkey")).alias("component"), F.lit(1).cast("long").alias("cbeg"), n.alias("cend"), F.when(F.col("c_custkey") % back == 0, -1).otherwise(1).alias("strand"))


@query("d14_sorted_count", "read_kmers", "SELECT translate(d,'0123','ACTG') AS kmer, count(*) AS n, count(*) FILTER (translate(forward,'ACTG','0123') = d) AS plus FROM read_kmers GROUP BY d HAVING count(*) >= 3")
def _(spark, d):
    return KD.count_stranded(V.reads(spark, d), K, 3).select(S.decode("kmer", K).alias("kmer"), "n", "plus")


@query("d10_successors", "edges", "SELECT kmer, side, base, next, n FROM edges")
def _(spark, d):
    return AS.successors(_nodes(spark, d))


@query("d9_fork_filter", "edges", "SELECT kmer, side, base, next, n FROM (SELECT *, sum(n) OVER (PARTITION BY kmer, side) AS total FROM edges) WHERE n > 0.2 * total")
def _(spark, d):
    return AS.filter_forks(AS.successors(_nodes(spark, d)), 0.2)


@query("d32_graph_branches", "edges nodes", "SELECT n.kmer, n.n, count(e.next) FILTER (e.side = 'R') AS right_edges, count(e.next) FILTER (e.side = 'L') AS left_edges FROM nodes n LEFT JOIN edges e ON e.kmer = n.kmer GROUP BY n.kmer, n.n")
def _(spark, d):
    n = _nodes(spark, d)
    e = AS.successors(n).groupBy("kmer").agg(F.count_if(F.col("side") == "R").alias("r"), F.count_if(F.col("side") == "L").alias("l"))
    return n.join(e, "kmer", "left").select("kmer", "n", F.coalesce("r", F.lit(0)).alias("right_edges"), F.coalesce("l", F.lit(0)).alias("left_edges"))


@query("d16_count_histogram", "coded", "SELECT n, count(*) AS kmers FROM (SELECT kmer, count(*) AS n FROM coded GROUP BY kmer) GROUP BY n")
def _(spark, d):
    return AS.histogram(KD.count_kmers(V.reads(spark, d), K))


@query("d18_n50", "reads", "SELECT CAST(min(len) AS BIGINT) AS nxx, min(place) AS lxx FROM (SELECT length(bases) AS len, sum(length(bases)) OVER (ORDER BY length(bases) DESC, spotid ROWS UNBOUNDED PRECEDING) AS run, row_number() OVER (ORDER BY length(bases) DESC, spotid) AS place, sum(length(bases)) OVER () AS total FROM reads WHERE bases <> '') WHERE run - len < total * 0.5 AND run >= total * 0.5")
def _(spark, d):
    return AS.length_statistic(V.reads(spark, d).where("bases <> ''").select(F.length("bases").alias("len")))


@query("d19_contig_abundance", "coded nodes", "SELECT spotid, round(avg(n), 6) AS abundance, count(*) AS kmers FROM coded JOIN nodes USING (kmer) GROUP BY spotid")
def _(spark, d):
    k = KD.explode_kmers(V.reads(spark, d), K, "spotid")
    return k.join(KD.count_kmers(V.reads(spark, d), K, 10), "kmer").groupBy("spotid").agg(F.round(F.avg("n"), 6).alias("abundance"), F.count("*").alias("kmers"))


@query("d20_covered_length", "feature_merged", "SELECT ref, CAST(sum(e - s + 1) AS BIGINT) AS covered FROM (SELECT ref, min(s) AS s, max(e) AS e FROM (SELECT *, sum(CASE WHEN s > top + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY ref ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, max(e) OVER (PARTITION BY ref ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM feature_merged)) GROUP BY ref, island) GROUP BY ref")
def _(spark, d):
    from seqloom.operators.intervals import merge_intervals

    g = V.gtf(spark, d).withColumnRenamed("chrom", "ref")
    return merge_intervals(g, ["ref"]).groupBy("ref").agg(F.sum(F.col("end") - F.col("start") + 1).alias("covered"))


@query("d21_longest_stretch", "raw_reads", "SELECT spotid, run FROM (SELECT spotid, runs[i] AS run, row_number() OVER (PARTITION BY spotid ORDER BY length(runs[i]) DESC, i) AS r FROM (SELECT spotid, runs, unnest(range(1, len(runs)+1)) AS i FROM (SELECT spotid, regexp_extract_all(bases, '[ACGT]+') AS runs FROM raw_reads))) WHERE r = 1")
def _(spark, d):
    return V.raw_reads(spark, d).select("spotid", S.longest_run("bases").alias("run")).where("run IS NOT NULL")


@query("d24_iupac_revcomp", "raw_reads", "SELECT spotid, md5(reverse(translate(bases,'ACGTN','TGCAN'))) AS rc FROM raw_reads")
def _(spark, d):
    return V.raw_reads(spark, d).select("spotid", F.md5(S.revcomp_iupac("bases").cast("binary")).alias("rc"))


@query("d26_edit_distance", "reads", "SELECT a.spotid, CAST(levenshtein(a.bases, b.bases) AS INTEGER) AS distance FROM reads a JOIN reads b ON b.spotid = a.spotid + 1")
def _(spark, d):
    r = V.reads(spark, d).select("spotid", F.col("bases").alias("a"))
    return r.join(r.select((F.col("spotid") - 1).alias("spotid"), F.col("a").alias("b")), "spotid").select("spotid", F.levenshtein("a", "b").alias("distance"))


@query("d27_entropy", "reads", "SELECT spotid, round(0 - list_sum(list_transform(list_filter([(length(bases) - length(replace(bases,'A',''))) / length(bases), (length(bases) - length(replace(bases,'C',''))) / length(bases), (length(bases) - length(replace(bases,'G',''))) / length(bases), (length(bases) - length(replace(bases,'T',''))) / length(bases)], lambda p: p > 0), lambda p: p * log2(p))), 6) AS entropy FROM reads WHERE bases <> ''")
def _(spark, d):
    return V.reads(spark, d).where("bases <> ''").select("spotid", F.round(S.entropy("bases"), 6).alias("entropy"))


@query("d31_codons", "reads", "SELECT spotid, substr(bases,1,3) IN ('ATG','GTG','TTG','CTG','ATT','ATC','ATA') AS starts, right(bases,3) IN ('TAA','TAG','TGA') AS stops FROM reads")
def _(spark, d):
    s, e = AS.codons(F.col("bases"))
    return V.reads(spark, d).select("spotid", s.alias("starts"), e.alias("stops"))


@query("d8_clean_alleles", "raw_reads", "SELECT spotid AS locus, bases AS seq FROM (SELECT spotid, replace(bases, 'N', '') AS bases FROM raw_reads) WHERE length(bases) >= 42 AND NOT regexp_matches(bases, '[^ACGT]')")
def _(spark, d):
    r = V.raw_reads(spark, d).select(F.col("spotid").alias("locus"), F.replace("bases", F.lit("N"), F.lit("")).alias("seq"))
    return AS.clean_alleles(r)


@query("d12_diagonal_runs", "doc20 bench_db", """WITH b AS (SELECT item_id, i - 1 AS spos, substr(bases, i, 20) AS kmer FROM (SELECT item_id, bases, unnest(range(1, length(bases)-18)) AS i FROM (SELECT item_id, upper(regexp_replace(text,'[^ACGTacgt]','','g')) AS bases FROM benchmark))),
  q AS (SELECT spotid, i - 1 AS qpos, substr(bases, i, 20) AS kmer FROM (SELECT spotid, bases, unnest(range(1, length(bases)-18)) AS i FROM reads WHERE length(bases) >= 20)),
  h AS (SELECT DISTINCT spotid, item_id, qpos - spos AS diagonal, qpos FROM q JOIN b USING (kmer)), g AS (SELECT *, CASE WHEN qpos - lag(qpos) OVER (PARTITION BY spotid, item_id, diagonal ORDER BY qpos) <= 20 THEN 0 ELSE 1 END AS fresh FROM h)
  SELECT spotid AS query, item_id AS subject, diagonal, min(qpos) AS qstart, max(qpos) + 19 AS qend FROM (SELECT *, sum(fresh) OVER (PARTITION BY spotid, item_id, diagonal ORDER BY qpos ROWS UNBOUNDED PRECEDING) AS run FROM g) GROUP BY spotid, item_id, diagonal, run""")
def _(spark, d):
    at = lambda df, key, pos: df.where(F.length("bases") >= 20).select(F.col(key), F.posexplode(S.kmers("bases", 20, False)).alias(pos, "kmer")).withColumn(pos, F.col(pos).cast("long"))
    q = at(V.reads(spark, d).withColumnRenamed("spotid", "query"), "query", "qpos")
    s = at(V.table(spark, d, "benchmark").select(F.col("item_id").alias("subject"), V.bases_of("text").alias("bases")), "subject", "spos")
    return AS.diagonal_runs(q.join(s, "kmer"), 20)


@query("d41_reference_abundance", "coded nodes", "SELECT spotid, pos - 1 AS pos, n FROM coded JOIN nodes USING (kmer)")
def _(spark, d):
    k = KD.explode_positions(V.reads(spark, d), K, "spotid")
    return k.join(KD.count_kmers(V.reads(spark, d), K, 10), "kmer").select("spotid", F.col("pos").cast("long").alias("pos"), "n")


@query("d39_locus_conflicts", "gtf", """WITH p AS (SELECT chrom AS contig, start, "end", min(id) AS locus FROM gtf WHERE "end" - start > 8 GROUP BY 1, 2, 3) SELECT contig, start, "end", locus FROM p WHERE NOT EXISTS (SELECT 1 FROM p o WHERE o.contig = p.contig AND o.locus <> p.locus
  AND least(o."end", p."end") - greatest(o.start, p.start) + 1 > 5 AND (p."end" - p.start < o."end" - o.start OR (p."end" - p.start = o."end" - o.start AND p.locus > o.locus)))""")
def _(spark, d):
    p = V.gtf(spark, d).where("end - start > 8").select(F.col("id").alias("locus"), F.col("chrom").alias("contig"), "start", "end")
    return AS.resolve_overlaps(p, 5)


def _neighbours(spark, d):
    """Each read with the read of the next id."""
    r = V.reads(spark, d).select("spotid", F.col("bases").alias("query"))
    return r.join(r.select((F.col("spotid") - 1).alias("spotid"), F.col("query").alias("subject")), "spotid")


@query("d28_global_alignment")
def _(spark, d):
    return AL.align_pairs(_neighbours(spark, d)).select("spotid", "score", F.md5(F.col("cigar").cast("binary")).alias("cigar"))


@query("d28_local_alignment")
def _(spark, d):
    return AL.align_pairs(_neighbours(spark, d), "local").drop("query", "subject")


@query("d28_pinned_alignment")
def _(spark, d):
    return AL.align_pairs(_neighbours(spark, d), "left").drop("query", "subject")


@query("d28_banded_alignment")
def _(spark, d):
    return AL.align_pairs(_neighbours(spark, d), "local", band=42).drop("query", "subject")


@query("d29_alignment_details")
def _(spark, d):
    a = AL.align_pairs(_neighbours(spark, d))
    columns = F.length("query") + F.length("subject") - F.col("matches")
    return a.select("spotid", "matches", "distance", F.round(F.col("matches") / F.nullif(columns, F.lit(0)), 6).alias("identity"))


@query("e1_agp_scan", "agp_old", "SELECT object, beg, \"end\", component, cbeg, cend, strand FROM agp_old")
def _(spark, d):
    return _agp(spark, d, False)


@query("e5_top_level", "agp_old agp_new", "SELECT DISTINCT object FROM agp_new UNION SELECT DISTINCT object FROM agp_old")
def _(spark, d):
    return AG.top_level(_agp(spark, d, True).unionByName(_agp(spark, d, False)))


@query("e6_clean_agp", "agp_old", "SELECT object, beg, \"end\", component FROM (SELECT *, max(\"end\") OVER (PARTITION BY object ORDER BY beg, \"end\" DESC, component ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM (SELECT object, beg, \"end\", component FROM agp_old UNION ALL SELECT object, beg + 5, \"end\" - 5, component FROM agp_old)) WHERE top IS NULL OR \"end\" > top")
def _(spark, d):
    a = _agp(spark, d, False).select("object", "beg", "end", "component")
    return AG.clean(a.union(a.select("object", F.col("beg") + 5, F.col("end") - 5, "component")))


@query("e10_flatten", "agp_old", """WITH s AS (SELECT object, CAST(substr(object, 5) AS INTEGER) AS i, max("end") AS n FROM agp_old GROUP BY object), u AS (SELECT object, i, CAST(sum(n) OVER (PARTITION BY i % 2 ORDER BY i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS ue, n FROM s)
  SELECT 'whole' || (i % 2) AS object, CASE WHEN i % 4 = 0 THEN ue - (a."end" - 1) ELSE ue - n + a.beg END AS beg, CASE WHEN i % 4 = 0 THEN ue - (a.beg - 1) ELSE ue - n + a."end" END AS "end", component, strand * CASE WHEN i % 4 = 0 THEN -1 ELSE 1 END AS strand FROM agp_old a JOIN u USING (object)""")
def _(spark, d):
    a = _agp(spark, d, False)
    s = a.groupBy(F.col("object").alias("component")).agg(F.max("end").alias("n")).withColumn("i", F.substring("component", 5, 9).cast("int"))
    e = F.sum("n").over(Window.partitionBy(F.col("i") % 2).orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    up = s.select(F.concat(F.lit("whole"), F.col("i") % 2).alias("object"), (e - F.col("n") + 1).alias("beg"), e.alias("end"), "component", F.lit(1).cast("long").alias("cbeg"), F.col("n").alias("cend"), F.when(F.col("i") % 4 == 0, -1).otherwise(1).alias("strand"))
    return AG.flatten(a.unionByName(up)).select("object", "beg", "end", "component", "strand")


@query("e7_split_pieces", "agp_old agp_new", "SELECT component, cbeg, CAST(cend AS BIGINT) AS cend FROM agp_old UNION SELECT component, cbeg, cend FROM agp_new")
def _(spark, d):
    return AG.pieces(_agp(spark, d, False), _agp(spark, d, True))


@query("e8_remap", "agp_old agp_new", "SELECT CAST(sum(n.\"end\" - n.beg + 1) AS BIGINT) AS bases, n.object AS seqid, n.strand <> o.strand AS reversed FROM agp_new n JOIN agp_old o USING (component) GROUP BY 2, 3")
def _(spark, d):
    r = AG.remap(_agp(spark, d, False), _agp(spark, d, True))
    return r.groupBy("seqid", "reversed").agg(F.sum("length").alias("bases"))


@query("d17_histogram_shape", "coded", """WITH h AS (SELECT n, count(*) AS kmers FROM (SELECT kmer, count(*) AS n FROM coded GROUP BY kmer) GROUP BY n),
  v AS (SELECT coalesce(min(n) FILTER (up), min(n)) AS valley FROM (SELECT n, lead(kmers) OVER (ORDER BY n) > kmers AS up FROM h)), b AS (SELECT n, kmers, valley FROM h, v WHERE n >= valley),
  p AS (SELECT n AS peak FROM b ORDER BY kmers DESC, n LIMIT 1)
  SELECT CAST(min(valley) AS BIGINT) AS valley, CAST(any_value(peak) AS BIGINT) AS peak, CAST(sum(n * kmers) AS DOUBLE) / CAST(sum(kmers) AS DOUBLE) AS average, CAST(round(CAST(sum(n * kmers) AS DOUBLE) / any_value(peak)) AS BIGINT) AS genome FROM b, p""")
def _(spark, d):
    return AS.histogram_shape(AS.histogram(KD.count_kmers(V.reads(spark, d), K)))


#: Both graph_nodes of the nodes, edges between them without noise, and links: each the only way on for one node and the only way back for the other.
_TURN = "reverse(translate({0},'ACTG','TGAC'))"
_DIG = "translate({0},'ACTG','0123')"
VIEWS |= {
    "graph_nodes": ("nodes", f"SELECT kmer AS node, {_TURN.format('kmer')} AS twin, n FROM nodes UNION SELECT {_TURN.format('kmer')}, kmer, n FROM nodes"),
    "graph_edges": ("graph_nodes", f"""SELECT a, b, a_twin, b_twin, n FROM (SELECT x.node AS a, x.twin AS a_twin, y.node AS b, y.twin AS b_twin, y.n, sum(y.n) OVER (PARTITION BY x.node) AS total, row_number() OVER (PARTITION BY x.node ORDER BY y.n DESC, {_DIG.format('y.node')}) AS place
      FROM graph_nodes x JOIN graph_nodes y ON substr(x.node, 2) = substr(y.node, 1, {K - 1})) WHERE n > 0.1 * total OR place = 1"""),
    "graph_reach": ("graph_edges", """SELECT DISTINCT start FROM (WITH RECURSIVE w AS (SELECT node AS start, node, 1 AS i FROM graph_nodes UNION SELECT w.start, s.b, w.i + 1 FROM w JOIN graph_edges s ON s.a = w.node WHERE w.i < 12) SELECT start FROM w WHERE i = 12)"""),
    "graph_far_edges": ("graph_edges graph_reach", "SELECT * EXCLUDE (far, any_far) FROM (SELECT *, max(far) OVER (PARTITION BY a) AS any_far FROM (SELECT s.*, r.start IS NOT NULL AS far FROM graph_edges s LEFT JOIN graph_reach r ON r.start = s.b)) WHERE far OR NOT any_far"),
}
_CHAINS = """WITH one AS MATERIALIZED (SELECT a, any_value(a_twin) AS a_twin, any_value(b) AS b, any_value(b_twin) AS b_twin FROM {0} GROUP BY a HAVING count(*) = 1),
  link AS MATERIALIZED (SELECT a, b FROM one x WHERE a <> b AND b <> a_twin AND a <> a_twin AND b <> b_twin AND EXISTS (SELECT 1 FROM one y WHERE y.a = x.b_twin AND y.b = x.a_twin)),
  line AS MATERIALIZED (SELECT head, node, pos FROM (WITH RECURSIVE w AS (SELECT node AS head, node, 0 AS pos FROM graph_nodes WHERE node NOT IN (SELECT b FROM link) UNION ALL SELECT w.head, l.b, w.pos + 1 FROM w JOIN link l ON l.a = w.node) SELECT * FROM w)),
  ring AS MATERIALIZED (SELECT head, node, pos FROM (WITH RECURSIVE w AS (SELECT node AS head, node, 0 AS pos FROM graph_nodes WHERE node NOT IN (SELECT node FROM line) UNION ALL SELECT w.head, l.b, w.pos + 1 FROM w JOIN link l ON l.a = w.node WHERE l.b <> w.head) SELECT * FROM w)),
  rows AS (SELECT head, node, pos, false AS circle FROM line UNION ALL SELECT head, node, pos, true FROM ring WHERE head IN (SELECT arg_min(node, translate(node,'ACTG','0123')) FROM ring GROUP BY head)),
  told AS (SELECT r.*, s.n, least(translate(node,'ACTG','0123'), translate(twin,'ACTG','0123')) AS d, translate(node,'ACTG','0123') > translate(twin,'ACTG','0123') AS turned FROM rows r JOIN graph_nodes s USING (node))
  SELECT circle, count(*) AS nodes, round(avg(n), 6) AS abundance, CASE WHEN circle THEN substr(min(node) FILTER (pos = 0) || coalesce(string_agg(right(node, 1), '' ORDER BY pos) FILTER (pos > 0), ''), 1, count(*)) ELSE min(node) FILTER (pos = 0) || coalesce(string_agg(right(node, 1), '' ORDER BY pos) FILTER (pos > 0), '') END AS bases
  FROM told GROUP BY head, circle HAVING NOT arg_min(turned, d)"""


def _kept_edges(spark, d):
    return GR.kept_edges(KD.count_kmers(V.reads(spark, d), K, 10), K)


def _unitigs(spark, d, jump=0):
    return GR.unitigs(KD.count_kmers(V.reads(spark, d), K, 10), K, 0.1, jump)


def _contigs(spark, d, jump=0):
    nodes, _, on = _unitigs(spark, d, jump)
    return GR.contigs(on, nodes, K).select("circle", "nodes", F.round("abundance", 6).alias("abundance"), "bases")


@query("d33_unitigs", "graph_edges", _CHAINS.format("graph_edges"))
def _(spark, d):
    return _contigs(spark, d)


@query("d33_unitig_chains", "graph_far_edges", _CHAINS.format("graph_far_edges"))
def _(spark, d):
    """Unitigs that jump over dead ends of fewer than 12 nodes."""
    return _contigs(spark, d, 12)


#: Ends and beginnings of chains that follow one another in a read are to be connected.
_ENDS = f"""WITH w AS MATERIALIZED (SELECT spotid, i, substr(bases, i, {K}) AS node FROM (SELECT spotid, bases, unnest(range(1, length(bases) - {K - 2})) AS i FROM reads WHERE length(bases) >= {K})),
  one AS MATERIALIZED (SELECT a, any_value(a_twin) AS a_twin, any_value(b) AS b, any_value(b_twin) AS b_twin FROM graph_edges GROUP BY a HAVING count(*) = 1),
  link AS MATERIALIZED (SELECT a, b FROM one x WHERE a <> b AND b <> a_twin AND a <> a_twin AND b <> b_twin AND EXISTS (SELECT 1 FROM one y WHERE y.a = x.b_twin AND y.b = x.a_twin)),
  marked AS (SELECT spotid, i, node, node NOT IN (SELECT a FROM link) AS ends, node NOT IN (SELECT b FROM link) AS begins FROM w WHERE node IN (SELECT node FROM graph_nodes)),
  pairs AS MATERIALIZED (SELECT DISTINCT node AS first, after AS last FROM (SELECT *, lead(node) OVER v AS after, lead(begins) OVER v AS fits FROM marked WHERE ends OR begins WINDOW v AS (PARTITION BY spotid ORDER BY i)) WHERE ends AND fits),
  found AS (SELECT first, last, min(way) AS way, count(*) AS ways FROM (WITH RECURSIVE w AS (SELECT first, last, first AS node, '' AS way, 0 AS i FROM pairs UNION ALL SELECT w.first, w.last, s.b, w.way || right(s.b, 1), w.i + 1 FROM w JOIN graph_edges s ON s.a = w.node WHERE w.i < 6) SELECT * FROM w WHERE i >= 2 AND node = last) GROUP BY ALL)
  SELECT p.first AS first, p.last AS last, CASE WHEN ways IS NULL THEN 'none' WHEN ways = 1 THEN 'success' ELSE 'ambiguous' END AS status, CASE WHEN ways = 1 THEN way END AS bases FROM pairs p LEFT JOIN found USING (first, last)"""


@query("d35_connected_ends", "graph_edges reads", _ENDS)
def _(spark, d):
    nodes, found = _kept_edges(spark, d)
    linked = cut(GR.links(found, K))
    marks = nodes.select("node").join(linked.select(F.col("a").alias("node"), F.lit(False).alias("ends")), "node", "left").join(linked.select(F.col("b").alias("node"), F.lit(False).alias("begins")), "node", "left")
    marks = marks.select("node", F.coalesce("ends", F.lit(True)).alias("ends"), F.coalesce("begins", F.lit(True)).alias("begins")).where("ends OR begins")
    # reads stay in their tasks, and the marks of at most 4**11 nodes go to all of them
    reads = KD.gathered(V.reads(spark, d).select("spotid", "bases"), "spotid")
    at = reads.select("spotid", F.posexplode(S.kmers("bases", K, False)).alias("i", "node")).join(F.broadcast(marks), "node")
    w = Window.partitionBy("spotid").orderBy("i")  # a read
    met = at.select(F.col("node").alias("first"), "ends", F.lead("node").over(w).alias("last"), F.lead("begins").over(w).alias("fits")).where("ends AND fits")
    pairs = met.select("first", "last").distinct().select(F.struct("first", "last").alias("id"), "first", "last")
    told = GR.connect(pairs, found, nodes, 6, most=1 << 13, k=K)
    return told.select(S.decode("id.first", K).alias("first"), S.decode("id.last", K).alias("last"), "status", "bases")


@query("c100_greedy_contigs")
def _(spark, d):
    return GR.greedy_contigs(KD.count_kmers(V.reads(spark, d), K, 10), K, 10).select("circle", "nodes", F.round("abundance", 6).alias("abundance"), "bases")


#: Pieces of 60 bases, every 40 of a read, joined by ends of 20.
_JOINED = f"""WITH piece AS MATERIALIZED (SELECT row_number() OVER (ORDER BY p) AS id, p FROM (SELECT DISTINCT least(p, {_TURN.format('p')}) AS p FROM (SELECT substr(bases, i * 40 + 1, 60) AS p FROM (SELECT bases, unnest(range(0, (length(bases) - 60) // 40 + 1)) AS i FROM reads WHERE length(bases) >= 60)))),
  way AS MATERIALIZED (SELECT id, false AS turned, p AS t FROM piece UNION ALL SELECT id, true, {_TURN.format('p')} FROM piece),
  met AS MATERIALIZED (SELECT a.id AS a, a.turned AS at, b.id AS b, b.turned AS bt, b.t FROM (SELECT right(t, 20) AS e, min(id) AS id, min(turned) AS turned FROM way GROUP BY e HAVING count(*) = 1) a
    JOIN (SELECT left(t, 20) AS e, min(id) AS id, min(turned) AS turned, min(t) AS t FROM way GROUP BY e HAVING count(*) = 1) b USING (e) WHERE a.id <> b.id),
  line AS MATERIALIZED (SELECT * FROM (WITH RECURSIVE w AS (SELECT id AS hid, turned AS ht, id, turned, t, 1 AS n FROM way WHERE NOT EXISTS (SELECT 1 FROM met WHERE met.b = way.id AND met.bt = way.turned)
    UNION ALL SELECT hid, ht, m.b, m.bt, w.t || substr(m.t, 21), n + 1 FROM w JOIN met m ON m.a = w.id AND m.at = w.turned) SELECT * FROM w)),
  ring AS MATERIALIZED (SELECT * FROM (WITH RECURSIVE w AS (SELECT id AS hid, turned AS ht, id, turned, substr(t, 21) AS t, 1 AS n FROM way WHERE NOT EXISTS (SELECT 1 FROM line WHERE line.id = way.id AND line.turned = way.turned)
    UNION ALL SELECT hid, ht, m.b, m.bt, w.t || substr(m.t, 21), n + 1 FROM w JOIN met m ON m.a = w.id AND m.at = w.turned WHERE NOT (m.b = hid AND m.bt = ht)) SELECT * FROM w)),
  whole AS (SELECT arg_max(t, n) AS t, max(n) AS n FROM line GROUP BY hid, ht), whole_ring AS (SELECT arg_max(t, n) AS t, max(n) AS n FROM ring GROUP BY hid, ht)
  SELECT DISTINCT false AS circle, CAST(n AS BIGINT) AS pieces, least(t, {_TURN.format('t')}) AS bases FROM whole
  UNION SELECT DISTINCT true, CAST(n AS BIGINT), least(list_min(list_transform(range(1, length(t) + 1), lambda i: substr(t || t, i, length(t)))), list_min(list_transform(range(1, length(t) + 1), lambda i: substr({_TURN.format('t || t')}, i, length(t))))) FROM whole_ring"""


@query("d34_joined_pieces", "reads", _JOINED)
def _(spark, d):
    last = F.expr("(length(bases) - 60) DIV 40")
    pieces = V.reads(spark, d).where("length(bases) >= 60").select("bases", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("i"))
    return GR.join_contigs(pieces.select(F.substring("bases", (F.col("i") * 40 + 1).cast("int"), F.lit(60)).alias("bases")), 20)


def _mates(spark, d):
    """Of each read of 75 bases or more the first 40, and bases 36 to 75 the other way round."""
    r = V.reads(spark, d).where("length(bases) >= 75")
    return r.select(F.col("spotid").alias("id"), F.substring("bases", 1, 40).alias("first"), S.revcomp(F.substring("bases", 36, 40)).alias("second"))


@query("d36_connected_mates")
def _(spark, d):
    nodes, found = _kept_edges(spark, d)
    return MT.connect_mates(_mates(spark, d), found, nodes, K, 6, most=1 << 13)


@query("d36_insert_sizes")
def _(spark, d):
    contigs = V.reads(spark, d).select(F.col("spotid").alias("contig"), "bases")
    return MT.insert_sizes(_mates(spark, d), contigs, 15)


@query("d37_assembly")
def _(spark, d):
    reads = V.reads(spark, d).select(F.col("spotid").alias("id"), "bases")
    return MT.assemble(reads, [K, 15, 21], 10).select("k", "circle", "nodes", F.round("abundance", 6).alias("abundance"), "bases")


_REMAP = """WITH p AS (SELECT n.object AS seqid, n.beg AS start, n."end" - n.beg + 1 AS length, {0} AS component, o.beg AS "offset", n.strand <> o.strand AS reversed FROM agp_new n JOIN agp_old o USING (component)),
  f AS (SELECT *, CASE WHEN lag(component) OVER v = component AND lag(reversed) OVER v = reversed AND lag(start) OVER v + lag(length) OVER v = start AND CASE WHEN reversed THEN "offset" + length = lag("offset") OVER v ELSE lag("offset") OVER v + lag(length) OVER v = "offset" END THEN 0 ELSE 1 END AS fresh FROM p WINDOW v AS (PARTITION BY seqid ORDER BY start)),
  r AS (SELECT *, sum(fresh) OVER (PARTITION BY seqid ORDER BY start ROWS UNBOUNDED PRECEDING) AS run FROM f)
  SELECT seqid, min(start) AS start, CAST(sum(length) AS BIGINT) AS length, component, min("offset") AS "offset", reversed FROM r GROUP BY seqid, run, component, reversed"""


@query("e8_remap_rows", "agp_old agp_new", _REMAP.format("o.object"))
def _(spark, d):
    return AG.remap(_agp(spark, d, False), _agp(spark, d, True))


@query("e8_superseded", "agp_old agp_new", _REMAP.format("'dup' || o.object"))
def _(spark, d):
    """Each component lies in two objects of the source, of which one has been replaced by an object of the result."""
    old = _agp(spark, d, False)
    twice = old.unionByName(old.withColumn("object", F.concat(F.lit("dup"), "object")))
    nations = V.table(spark, d, "nation").select(F.concat(F.lit("dupscaf"), "n_nationkey").alias("old"), F.concat(F.lit("chrom"), F.col("n_nationkey") % 5).alias("new"))
    return AG.remap(twice, _agp(spark, d, True), nations)


@query("e2_nested_lines", "agp_old", "SELECT object, beg, \"end\", component FROM agp_old")
def _(spark, d):
    """Descriptions written as gz files, read as nested files are."""
    path = shared_folder(spark, "agp")
    lines = _agp(spark, d, False).select(F.concat_ws("\t", "object", "beg", "end", "component").alias("line"))
    lines.write.option("compression", "gzip").text(path)
    f = F.split("line", "\t")
    read = read_nested(spark, f"{path}/*.gz")
    return read.select(f[0].alias("object"), f[1].cast("long").alias("beg"), f[2].cast("long").alias("end"), f[3].alias("component"))
