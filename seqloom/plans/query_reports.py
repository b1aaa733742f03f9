"""Queries that write sequence formats and read them back, and reports on counts, contigs and remaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.functions import seq as S
from seqloom.operators import agp as AG
from seqloom.operators import assembly as AS
from seqloom.operators import features as FT
from seqloom.operators import intervals as IV
from seqloom.operators import kmerdb as KD
from seqloom.operators.numbering import numbered
from seqloom.operators.store import shared_folder
from seqloom.plans import query_assembly as QA
from seqloom.plans import query_counts as QC
from seqloom.plans import query_kmers as QK
from seqloom.plans import tables as TB
from seqloom.plans import views as V
from seqloom.plans.registry import query
from seqloom.plans.views import K, VIEWS
from seqloom.sources import formats as FM

VIEWS |= {
    "map_pairs": ("agp_old agp_new", """SELECT n.object AS seqid, n.beg AS start, n."end" - n.beg + 1 AS length, o.object AS component, o.beg AS "offset", n.strand <> o.strand AS reversed FROM agp_new n JOIN agp_old o USING (component)"""),
    "map_runs": ("map_pairs", """SELECT seqid, min(start) AS start, CAST(sum(length) AS BIGINT) AS length, component, min("offset") AS "offset", reversed FROM (SELECT *, sum(fresh) OVER (PARTITION BY seqid ORDER BY start ROWS UNBOUNDED PRECEDING) AS run FROM
      (SELECT *, CASE WHEN lag(component) OVER w = component AND lag(reversed) OVER w = reversed AND lag(start + length) OVER w = start AND (CASE WHEN reversed THEN "offset" + length = lag("offset") OVER w ELSE lag("offset" + length) OVER w = "offset" END) THEN 0 ELSE 1 END AS fresh
      FROM map_pairs WINDOW w AS (PARTITION BY seqid ORDER BY start))) GROUP BY seqid, run, component, reversed"""),
    "spans": ("alignments extents", "SELECT a.id, a.reversed, a.mapq, a.refpos AS s, a.refpos + a.length - 1 AS e, x.id AS feature, x.s AS fs, x.e AS fe, x.reverse FROM alignments a JOIN extents x ON x.ref = a.refspec AND a.refpos <= x.e AND a.refpos + a.length - 1 >= x.s"),
    "placed": ("reads", f"""SELECT spotid, contig, read_pos, contig_pos, plus FROM (SELECT q.spotid, b.item_id AS contig, q.pos AS read_pos, b.pos AS contig_pos, q.plus = b.plus AS plus, row_number() OVER (PARTITION BY q.spotid ORDER BY q.pos, b.item_id, b.pos) AS r
  FROM (SELECT spotid, pos, {QK._canon20('k')} AS c, translate(k,'ACTG','0123') = c AS plus FROM (SELECT spotid, i - 1 AS pos, substr(bases, i, 20) AS k FROM (SELECT spotid, bases, unnest(range(1, length(bases)-18)) AS i FROM reads WHERE length(bases) >= 20))) q
  JOIN (SELECT item_id, pos, {QK._canon20('k')} AS c, translate(k,'ACTG','0123') = c AS plus FROM (SELECT item_id, i - 1 AS pos, substr(bases, i, 20) AS k FROM (SELECT item_id, bases, unnest(range(1, length(bases)-18)) AS i FROM (SELECT item_id, upper(regexp_replace(text,'[^ACGTacgt]','','g')) AS bases FROM benchmark)))) b USING (c)) WHERE r = 1"""),
    "stranded": ("read_kmers", "SELECT spotid, pos - 1 AS pos, d, translate(forward,'ACTG','0123') = d AS plus FROM read_kmers"),
}


def _spans(spark, d):
    a = V.alignments(spark, d).select("id", "reversed", "mapq", F.col("refspec").alias("ref"), F.col("refpos").alias("start"), IV.end_of(F.col("refpos"), F.col("length")).alias("end"))
    f = FT.build_features(V.gtf(spark, d)).select("ref", F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.col("id").alias("feature"), "reverse")
    return IV.range_join(a, f, ["ref"])


def _pairs(spark, d):
    n = QA._agp(spark, d, True)
    o = QA._agp(spark, d, False).select("component", F.col("object").alias("from"), F.col("beg").alias("offset"), F.col("strand").alias("other"))
    return n.join(o, "component").select(F.col("object").alias("seqid"), F.col("beg").alias("start"), (F.col("end") - F.col("beg") + 1).alias("length"), F.col("from").alias("component"), "offset", (F.col("strand") != F.col("other")).alias("reversed"))


@query("b9_mapq_filter", "alignments", "SELECT mapq, count(*) AS n, count(*) FILTER (mapq < 4) AS low FROM alignments GROUP BY mapq")
def _(spark, d):
    disposed = FT.dispositions(V.alignments(spark, d), FT.build_features(V.gtf(spark, d)), "UNION", 4)
    a = V.alignments(spark, d).select("id", "mapq").join(disposed, "id")
    return a.groupBy("mapq").agg(F.count("*").alias("n"), F.count_if(F.col("disposition") == "LOW").alias("low"))


@query("b10_strand_filter", "spans", "SELECT feature, count(*) AS n, count(*) FILTER (reversed = reverse) AS same_strand FROM spans GROUP BY feature")
def _(spark, d):
    return _spans(spark, d).groupBy("feature").agg(F.count("*").alias("n"), F.count_if(F.col("reversed") == F.col("reverse")).alias("same_strand"))


@query("b36_overlap_lengths", "spans", "SELECT feature, CAST(sum(least(e, fe) - greatest(s, fs) + 1) AS BIGINT) AS bases, max(least(e, fe) - greatest(s, fs) + 1) AS longest FROM spans GROUP BY feature")
def _(spark, d):
    shared = IV.overlap_len(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end"))
    return _spans(spark, d).groupBy("feature").agg(F.sum(shared).alias("bases"), F.max(shared).alias("longest"))


@query("b4_feature_slices", "spans extents", "SELECT x.id AS feature, x.ref, min(p.s) AS first, max(p.e) AS last, count(p.id) AS n FROM extents x LEFT JOIN (SELECT s.*, a.refspec FROM spans s JOIN alignments a USING (id)) p ON p.feature = x.id AND p.refspec = x.ref GROUP BY x.id, x.ref")
def _(spark, d):
    met = _spans(spark, d).groupBy("feature", "ref").agg(F.min("start").alias("first"), F.max("end").alias("last"), F.count("*").alias("n"))
    f = FT.build_features(V.gtf(spark, d)).select(F.col("id").alias("feature"), "ref")
    return f.join(met, ["feature", "ref"], "left").select("feature", "ref", "first", "last", F.coalesce("n", F.lit(0)).alias("n"))


@query("b7_counts_report", "disposed_strict extents", """SELECT x.id || chr(9) || count(u.id) AS line FROM (SELECT DISTINCT id FROM extents) x LEFT JOIN disposed_strict u ON u.disposition = x.id GROUP BY x.id
  UNION ALL SELECT '#' || lower(k) || chr(9) || (SELECT count(*) FROM disposed_strict WHERE CASE k WHEN 'alignments' THEN true WHEN 'counted' THEN disposition NOT IN ('LOW','AMB','NOFT','NC') ELSE disposition = k END) FROM (VALUES ('alignments'), ('counted'), ('LOW'), ('AMB'), ('NOFT'), ('NC')) t(k)""")
def _(spark, d):
    f = FT.build_features(V.gtf(spark, d))
    return FT.counts_report(QC._disposed(spark, d, "STRICT"), f)


@query("b8_interval_dump", "segs", "SELECT id || chr(9) || ref || chr(9) || s || chr(9) || e || chr(9) || CASE WHEN amb THEN 'AMBIGUOUS' ELSE 'FEATURE' END AS line FROM segs")
def _(spark, d):
    f = FT.build_features(V.gtf(spark, d)).select("id", "ref", F.explode("segs").alias("s"))
    return f.select(F.concat_ws("\t", "id", "ref", F.col("s.start").cast("string"), F.col("s.end").cast("string"), F.when(F.col("s.amb"), "AMBIGUOUS").otherwise("FEATURE")).alias("line"))


@query("c1_fasta_scan", "reads", "SELECT CAST(spotid AS VARCHAR) AS spotid, length(bases) AS n, md5(bases) AS bases FROM reads WHERE bases <> ''")
def _(spark, d):
    path = shared_folder(spark, "fasta")
    FM.fasta_records(V.reads(spark, d).where("bases <> ''")).write.text(path)
    return FM.read_fasta(spark, path).select("spotid", F.length("bases").cast("long").alias("n"), F.md5(F.col("bases").cast("binary")).alias("bases"))


@query("c5_tax_of_path", "", "SELECT CAST(doc_id AS INTEGER) AS tax_id, coalesce(lang = 'en', false) AS virus, coalesce(lang <> 'en' AND source = 'src1', false) AS eukaryote FROM documents")
def _(spark, d):
    folder = F.when(F.col("lang") == "en", "/refs/Viruses/").when(F.col("source") == "src1", "/refs/Eukaryota/").otherwise("/refs/Bacteria/")
    tax, virus, eukaryote = FM.tax_of_path(F.concat(folder, F.col("doc_id").cast("string"), F.lit(".fasta")))
    return V.table(spark, d, "documents").select(tax.alias("tax_id"), virus.alias("virus"), eukaryote.alias("eukaryote"))


@query("c11_hit_file", "hit_rows", "SELECT CAST(spotid AS VARCHAR) AS spotid, count(*) AS taxa, CAST(2 * sum(n) AS BIGINT) AS n FROM hit_rows GROUP BY spotid")
def _(spark, d):
    lines = KD.format_hits(KD.collate(KD.hits(QK._db(K, d, spark), QK._index(spark, d), "spotid")))
    twice = KD.collate(KD.parse_hits(lines.union(lines)))  # rows of one spot are merged
    return twice.select("spotid", F.size("hits").cast("long").alias("taxa"), F.aggregate("hits", F.lit(0).cast("long"), lambda acc, h: acc + h["n"]).alias("n"))


@query("c14_stored_index", "kmer_db", "SELECT kmer, tax_id FROM kmer_db WHERE tax_id IN (100, 107, 111, 124)")
def _(spark, d):
    path = shared_folder(spark, "index")
    FM.write_kmer_db(QK._index(spark, d), path, by_tax=True)
    return QK._text(FM.read_kmer_db(spark, path, [100, 107, 111, 124]), "tax_id")


@query("c103_batch_classify", "coded kmer_db", """WITH s AS (SELECT DISTINCT tax_id FROM coded JOIN kmer_db USING (kmer) WHERE kmer LIKE 'A%' AND tax_id >= 100)
  SELECT spotid, tax_id, count(*) AS n FROM coded JOIN kmer_db USING (kmer) WHERE tax_id IN (SELECT tax_id FROM s) GROUP BY 1, 2""")
def _(spark, d):
    path = shared_folder(spark, "index")
    FM.write_kmer_db(QK._index(spark, d), path, by_tax=True)
    dense = FM.read_kmer_db(spark, path)
    sparse = dense.where(S.decode("kmer", K).startswith("A") & (F.col("tax_id") >= 100))
    return KD.classify_in_two_steps(QK._by_read(spark, d), QK._small(sparse), lambda taxa: QK._small(FM.read_kmer_db(spark, path, taxa)), "spotid")


@query("c94_read_checksum", "reads", "SELECT source, count(*) AS n, CAST(sum(length(bases)) AS BIGINT) AS bases, CAST(sum(CAST('0x' || substr(md5(bases), 1, 8) AS BIGINT)) AS BIGINT) AS checksum FROM reads GROUP BY source")
def _(spark, d):
    part = F.conv(F.substring(F.md5(F.col("bases").cast("binary")), 1, 8), 16, 10).cast("long")
    return V.reads(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("bases")).alias("bases"), F.sum(part).alias("checksum"))


@query("c99_index_check", "coded kmer_db lineage", """SELECT tax, count(*) AS kmers, count(*) FILTER (NOT list_contains(l.lineage, db.tax_id)) AS wrong, count(*) FILTER (db.tax_id = tax) AS own FROM (SELECT DISTINCT kmer, CAST(100 + spotid % 25 AS INTEGER) AS tax FROM coded) c
  JOIN kmer_db db USING (kmer) JOIN lineage l ON l.tax_id = c.tax GROUP BY tax""")
def _(spark, d):
    from seqloom.operators import taxonomy as TX

    return KD.check_index(QK._index(spark, d), QK._tagged(spark, d), TX.lineages(V.taxonomy(spark, d)))


@query("c100_next_letters", "edges", "SELECT kmer, side, base, next, n FROM (SELECT *, row_number() OVER (PARTITION BY kmer, side ORDER BY n DESC, base) AS r FROM edges WHERE n >= 20) WHERE r = 1")
def _(spark, d):
    return AS.next_letters(AS.successors(QA._nodes(spark, d)), 20)


@query("d1_read_input", "raw_reads", "SELECT CAST(spotid AS VARCHAR) AS spotid, md5(run) AS bases FROM (SELECT spotid, runs[i] AS run, row_number() OVER (PARTITION BY spotid ORDER BY length(runs[i]) DESC, i) AS r FROM (SELECT spotid, runs, unnest(range(1, len(runs)+1)) AS i FROM (SELECT spotid, regexp_extract_all(bases, '[ACGT]+') AS runs FROM raw_reads))) WHERE r = 1")
def _(spark, d):
    path = shared_folder(spark, "fastq")
    quals = F.repeat(F.lit("I"), F.length("bases"))
    V.raw_reads(spark, d).select(F.concat(F.lit("@"), "spotid", F.lit("\n"), "bases", F.lit("\n+\n"), quals).alias("line")).write.text(path)
    return FM.best_stretch(FM.read_fastq(spark, path)).select("spotid", F.md5(F.col("bases").cast("binary")).alias("bases"))


@query("d2_allele_table", "reads", "SELECT source AS locus, CAST(spotid AS VARCHAR) AS allele, md5(bases) AS seq FROM reads WHERE bases <> '' AND source IS NOT NULL")
def _(spark, d):
    rows = V.reads(spark, d).where("bases <> '' AND source IS NOT NULL")
    parsed = FM.parse_alleles(rows.select(F.concat_ws(" ", "source", F.col("spotid").cast("string"), F.lower("bases")).alias("line")))
    return parsed.select("locus", "allele", F.md5(F.col("seq").cast("binary")).alias("seq"))


@query("d4_tabular_hits", "alignments", """SELECT id AS query, refspec AS subject, length, CASE WHEN reversed THEN refpos ELSE refpos END AS sstart, refpos + length - 1 AS send, NOT (reversed AND length > 1) AS plus FROM alignments""")
def _(spark, d):
    a = V.alignments(spark, d)
    last = IV.end_of(F.col("refpos"), F.col("length"))
    text = lambda x: x.cast("string")
    ends = [text(F.when(F.col("reversed"), last).otherwise(F.col("refpos"))), text(F.when(F.col("reversed"), F.col("refpos")).otherwise(last))]
    line = F.concat_ws("\t", "id", "refspec", F.lit("100.0"), text(F.col("length")), F.lit("0"), F.lit("0"), F.lit("1"), text(F.col("length")), *ends, F.lit("1e-9"), text(F.col("mapq")), text(F.col("length")))
    hits = FM.parse_tabular_hits(a.select(line.alias("line")))
    return hits.select("query", "subject", F.col("length").cast("long").alias("length"), "sstart", "send", "plus")


@query("d5_contig_records", "reads", "SELECT '>Contig_' || row_number() OVER (ORDER BY bases) || '_' || CAST(CAST(n AS DOUBLE) AS VARCHAR) AS head, md5(bases) AS bases FROM (SELECT bases, count(*) AS n FROM reads WHERE bases <> '' GROUP BY bases)")
def _(spark, d):
    contigs = V.reads(spark, d).where("bases <> ''").groupBy("bases").agg(F.count("*").cast("double").alias("abundance"))
    parts = F.split("line", "\n")
    return FM.contig_records(contigs).select(parts[0].alias("head"), F.md5(parts[1].cast("binary")).alias("bases"))


@query("d11_place_reads", "placed", "SELECT spotid, contig, read_pos, contig_pos, plus FROM placed")
def _(spark, d):
    contigs = V.table(spark, d, "benchmark").select(F.col("item_id").alias("contig"), V.bases_of("text").alias("bases"))
    return AS.place_reads(V.reads(spark, d), contigs, 20)


@query("d22_contig_direction", "stranded reads", f"""SELECT r.spotid, NOT coalesce(m.plus, true) AS turned, md5(CASE WHEN coalesce(m.plus, true) THEN r.bases ELSE {V.RC.format('r.bases')} END) AS bases FROM reads r
  LEFT JOIN (SELECT spotid, plus FROM (SELECT *, row_number() OVER (PARTITION BY spotid ORDER BY d, pos) AS r FROM stranded) WHERE r = 1) m USING (spotid)""")
def _(spark, d):
    return AS.direct(V.reads(spark, d), K, "spotid").select("spotid", "turned", F.md5(F.col("bases").cast("binary")).alias("bases"))


@query("e4_remap_table", "map_runs", "SELECT seqid, start, length - 1 AS length, component, \"offset\", reversed FROM map_runs")
def _(spark, d):
    r = AG.remap(QA._agp(spark, d, False), QA._agp(spark, d, True))
    return AG.remap_table(r)


@query("e9_compact_pairs", "map_runs", "SELECT seqid, start, length, component, \"offset\", reversed FROM map_runs")
def _(spark, d):
    return AG.compact(_pairs(spark, d))


@query("e12_split_locations", "agp_old", "SELECT object, component, cbeg, cend, strand FROM (SELECT object, component, CAST(1 AS BIGINT) AS cbeg, CAST(cend // 2 AS BIGINT) AS cend, strand FROM agp_old UNION ALL SELECT object, component, cend // 2 + 1, cend, strand FROM agp_old)")
def _(spark, d):
    a = QA._agp(spark, d, False)
    return AG.split_locations(a, F.expr("cend DIV 2 + 1")).select("object", "component", "cbeg", F.col("cend").cast("long").alias("cend"), "strand")


@query("a9_range_literals", "alignments", "SELECT '@chr1' AS range, count(*) AS n FROM alignments WHERE refspec = 'chr1' UNION ALL SELECT '@chr2:1000.5000', count(*) FROM alignments WHERE refspec = 'chr2' AND refpos >= 1000 AND refpos < 6000 UNION ALL SELECT '@chr3:7.0', count(*) FROM alignments WHERE refspec = 'chr3'")
def _(spark, d):
    a = V.alignments(spark, d)
    totals = [a.where(TB.Range.parse(r).predicate("ALIG")).agg(F.count("*").alias("n")).select(F.lit(r).alias("range"), "n") for r in ("@chr1", "@chr2:1000.5000", "@chr3:7.0")]
    return totals[0].union(totals[1]).union(totals[2])


@query("a16_column_projection", "alignments", "SELECT id, mapq FROM alignments")
def _(spark, d):
    return TB.scan(TB.TableSpec.parse("t = run.ALIG {id, mapq}"), V.alignments(spark, d))


@query("a17_range_restriction", "alignments", "SELECT id, refspec, refpos FROM alignments WHERE (refspec = 'chr2' AND refpos >= 1000 AND refpos < 6000) OR refspec = 'chr4'")
def _(spark, d):
    return TB.scan(TB.TableSpec.parse("t = run.ALIG {id, refspec, refpos} #@chr2:1000.5000 #@chr4"), V.alignments(spark, d))


@query("b17_interval_pairs", "alignments extents", "SELECT x.id AS feature, x.ref, a.id FROM extents x LEFT JOIN alignments a ON x.ref = a.refspec AND a.refpos <= x.e AND a.refpos + a.length - 1 >= x.s")
def _(spark, d):
    f = FT.build_features(V.gtf(spark, d)).select(F.col("id").alias("feature"), "ref", "start", "end")
    a = V.alignments(spark, d).select("id", F.col("refspec").alias("ref"), F.col("refpos").alias("r_start"), IV.end_of(F.col("refpos"), F.col("length")).alias("r_end"))
    return IV.range_join(f, a, ["ref"], how="left").select("feature", "ref", "id")


@query("c3_file_list", "", "SELECT url AS path, CAST(sum(strlen(coalesce(html, ''))) AS BIGINT) AS size FROM pages GROUP BY url")
def _(spark, d):
    size = F.octet_length(F.coalesce("html", F.lit(""))).cast("string")
    files = FM.parse_file_list(V.table(spark, d, "pages").select(F.concat(size, F.lit("\t"), F.col("url")).alias("line")))
    return files.groupBy("path").agg(F.sum("size").alias("size"))


@query("c4_accession_list", "", "SELECT word, count(*) AS n FROM (SELECT source AS word FROM documents WHERE source IS NOT NULL UNION ALL SELECT 'ACC' || doc_id FROM documents) GROUP BY word")
def _(spark, d):
    lines = V.table(spark, d, "documents").select(F.concat(F.lit("  "), F.coalesce("source", F.lit("")), F.lit(" \tACC"), F.col("doc_id").cast("string"), F.lit(" ")).alias("line"))
    return FM.parse_words(lines).groupBy("word").agg(F.count("*").alias("n"))


@query("c12_tax_list", "kmer_db taxonomy", "SELECT tax_id, count(*) AS kmers FROM kmer_db WHERE tax_id IN (SELECT tax_id FROM taxonomy WHERE rank = 'nation' AND parent_id IN (11, 13)) GROUP BY tax_id")
def _(spark, d):
    lines = V.taxonomy(spark, d).where("rank = 'nation' AND parent_id IN (11, 13)").select(F.col("tax_id").cast("string").alias("line"))
    taxa = FM.parse_words(lines).select(F.col("word").cast("int").alias("tax_id"))
    path = shared_folder(spark, "index")
    FM.write_kmer_db(QK._index(spark, d), path, by_tax=True)
    return KD.annotation(FM.read_kmer_db(spark, path, taxa)).withColumnRenamed("n", "kmers")


@query("d7_coverage_profile", "placed reads", f"""WITH o AS MATERIALIZED (SELECT contig, CASE WHEN plus THEN contig_pos - read_pos ELSE contig_pos - (length(bases) - 20 - read_pos) END AS off, CASE WHEN plus THEN bases ELSE {V.RC.format('bases')} END AS bases FROM placed JOIN reads USING (spotid)),
  e AS MATERIALIZED (SELECT contig, off + i - 1 AS pos, substr(bases, i, 1) AS symbol FROM (SELECT contig, off, bases, unnest(range(1, length(bases)+1)) AS i FROM o)), n AS (SELECT item_id AS contig, length(regexp_replace(text,'[^ACGTacgt]','','g')) AS len FROM benchmark)
  SELECT contig, pos, string_agg(symbol, '' ORDER BY symbol) AS symbols, string_agg(CAST(n AS VARCHAR), ',' ORDER BY symbol) AS abundances FROM (SELECT contig, pos, symbol, count(*) AS n FROM e JOIN n USING (contig) WHERE pos >= 0 AND pos < len GROUP BY 1, 2, 3) GROUP BY contig, pos""")
def _(spark, d):
    contigs = V.table(spark, d, "benchmark").select(F.col("item_id").alias("contig"), V.bases_of("text").alias("bases"))
    r = V.reads(spark, d).select("spotid", "bases")
    return AS.coverage_profile(r, contigs, AS.place_reads(r, contigs, 20), 20)


@query("d13_word_seeds", "nodes bench_db", f"""WITH t AS (SELECT DISTINCT {QA._CANON.format('k')} AS kmer FROM (SELECT substr(bases, i, {K}) AS k FROM (SELECT bases, unnest(range(1, length(bases)-{K-2})) AS i FROM (SELECT upper(regexp_replace(text,'[^ACGTacgt]','','g')) AS bases FROM benchmark))))
  SELECT kmer, node, CAST({K} - miss AS INTEGER) AS score FROM (SELECT t.kmer, n.kmer AS node, hamming(t.kmer, n.kmer) AS miss, row_number() OVER (PARTITION BY t.kmer ORDER BY hamming(t.kmer, n.kmer), n.n DESC, translate(n.kmer,'ACTG','0123')) AS r FROM t JOIN nodes n ON right(n.kmer, 8) = right(t.kmer, 8)) WHERE r = 1""")
def _(spark, d):
    targets = V.table(spark, d, "benchmark").select(V.bases_of("text").alias("bases"))
    seeds = AS.word_seeds(KD.explode_kmers(targets, K).distinct(), KD.count_kmers(V.reads(spark, d), K, 10), K)
    return seeds.select(S.decode("kmer", K).alias("kmer"), S.decode("node", K).alias("node"), "score")


@query("d23_placement_orders", "gtf", """SELECT chrom AS contig, start, "end", id AS locus, row_number() OVER (ORDER BY chrom, start, "end", id, strand) AS by_place, row_number() OVER (ORDER BY id, chrom, start, "end", strand) AS by_locus FROM gtf""")
def _(spark, d):
    g = V.gtf(spark, d)
    placed = numbered(g, "chrom", "start", "end", "id", "strand").withColumn("by_place", F.col("row") + 1).drop("row")
    both = numbered(placed, "id", "chrom", "start", "end", "strand").withColumn("by_locus", F.col("row") + 1)
    return both.select(F.col("chrom").alias("contig"), "start", "end", F.col("id").alias("locus"), "by_place", "by_locus")


@query("e11_sorted_records", "agp_old", "SELECT object, beg, component, row_number() OVER (ORDER BY object, beg, \"end\", component) AS place FROM agp_old")
def _(spark, d):
    return numbered(QA._agp(spark, d, False), "object", "beg", "end", "component").select("object", "beg", "component", (F.col("row") + 1).alias("place"))
