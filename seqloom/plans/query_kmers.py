"""Queries on k-mers and their indexes."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.functions import seq as S
from seqloom.operators import kmerdb as KD
from seqloom.operators import profiles as PR
from seqloom.operators import taxonomy as TX
from seqloom.operators.store import shared_folder
from seqloom.plans import views as V
from seqloom.plans.registry import query
from seqloom.sources import formats as FM
from seqloom.plans.views import K, VIEWS

_DIGITS = "translate(kmer,'ACTG','0123')"
#: The order of k-mers by a hash that both engines have.
_MD5 = f"md5({_DIGITS})"
_FNV = """list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(0, 8), lambda i: ((code >> (8*i)::INTEGER) & 255)::UHUGEINT)), lambda h, b: xor((h * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT, b))"""
_CODE = "list_sum(list_transform(range(1, 12), lambda p: (ascii(substr({0}, CAST(p AS BIGINT), 1)) - 48) * (4 ** (11 - p))::BIGINT))::BIGINT"
MASKS = 16


def _canon20(x):
    return f"least(translate({x},'ACTG','0123'), translate(reverse(translate({x},'ACTG','TGAC')),'ACTG','0123'))"


VIEWS |= {
    "db_a": ("coded", "SELECT DISTINCT kmer FROM coded WHERE source <> 'src1'"),
    "db_b": ("coded", "SELECT DISTINCT kmer FROM coded WHERE lang = 'en'"),
    "bench_db": ("", f"SELECT DISTINCT item_id, translate(least(translate(k,'ACTG','0123'), translate(reverse(translate(k,'ACTG','TGAC')),'ACTG','0123')),'0123','ACTG') AS kmer FROM (SELECT item_id, substr(bases, i, 20) AS k FROM (SELECT item_id, bases, unnest(range(1, length(bases)-18)) AS i FROM (SELECT item_id, upper(regexp_replace(text,'[^ACGTacgt]','','g')) AS bases FROM benchmark) WHERE length(bases) >= 20))"),
    "doc20": ("reads", "SELECT spotid, source, i - 1 AS pos, translate(least(translate(k,'ACTG','0123'), translate(reverse(translate(k,'ACTG','TGAC')),'ACTG','0123')),'0123','ACTG') AS kmer FROM (SELECT spotid, source, i, substr(bases, i, 20) AS k FROM (SELECT spotid, source, bases, unnest(range(1, length(bases)-18)) AS i FROM reads WHERE length(bases) >= 20))"),
    "hit_rows": ("coded kmer_db", "SELECT spotid, tax_id, count(*) AS n FROM coded JOIN kmer_db USING (kmer) GROUP BY spotid, tax_id"),
    "wins": ("reads", "SELECT spotid, bases, w, greatest(0, w*64 - 10) AS f, least(w*64 + 64, length(bases)) AS t FROM (SELECT spotid, bases, unnest(range(0, length(bases) // 64)) AS w FROM reads WHERE length(bases) >= 64)"),
    "fnv": ("read_kmers", f"SELECT d, {_FNV} AS h FROM (SELECT d, {_CODE.format('d')} AS code FROM (SELECT DISTINCT d FROM read_kmers))"),
    "profiles": ("read_kmers fnv", "SELECT source, place, translate(d,'0123','ACTG') AS kmer FROM (" + " UNION ALL ".join(f"SELECT source, CAST({i} AS INTEGER) AS place, arg_min(d, xor(h, {m}::UHUGEINT)) AS d FROM (SELECT DISTINCT source, d FROM read_kmers) JOIN fnv USING (d) GROUP BY source" for i, m in enumerate(PR.masks(MASKS))) + ")"),
    "win_kmers": ("wins", f"SELECT spotid, w, i AS pos, least(translate(substr(bases, i+1, {K}),'ACTG','0123'), translate(reverse(translate(substr(bases, i+1, {K}),'ACTG','TGAC')),'ACTG','0123')) AS dg FROM (SELECT spotid, bases, w, unnest(range(f, t - {K-1})) AS i FROM wins)"),
}


def _db(k, d, spark):
    return KD.explode_kmers(V.reads(spark, d), k, "spotid")


def _tagged(spark, d):
    return KD.explode_kmers(V.reads(spark, d), K, "spotid").withColumn("tax_id", V.tax_of(F.col("spotid")))


def _index(spark, d):
    return KD.build_index(_tagged(spark, d), TX.lineages(V.taxonomy(spark, d)))


def _by_read(spark, d):
    """K-mers whose reads each lie in one task."""
    return KD.explode_kmers(KD.gathered(V.reads(spark, d).select("spotid", "bases"), "spotid"), K, "spotid")


def _small(db):
    """A table of different k-mers of 11 bases, at most 4**11 / 2 rows of two numbers, for all tasks."""
    return F.broadcast(db)


def _text(df, *cols):
    return df.select(*cols, S.decode("kmer", K).alias("kmer"))


def _md5(code):
    return F.md5(F.lpad(F.conv(code.cast("string"), 10, 4), K, "0").cast("binary"))


def _a(spark, d):
    return KD.explode_kmers(V.reads(spark, d).where("source <> 'src1'"), K).distinct()


def _b(spark, d):
    return KD.explode_kmers(V.reads(spark, d).where("lang = 'en'"), K).distinct()


@query("c42_kmer_count", "coded", "SELECT kmer, count(*) AS n FROM coded GROUP BY kmer")
def _(spark, d):
    return _text(KD.count_kmers(V.reads(spark, d), K), "n")


@query("c29_coverage_filter", "coded", "SELECT kmer, count(*) AS n FROM coded GROUP BY kmer HAVING count(*) >= 5")
def _(spark, d):
    return _text(KD.count_kmers(V.reads(spark, d), K, 5), "n")


@query("c43_stranded_count", "read_kmers", "SELECT translate(d,'0123','ACTG') AS kmer, count(*) AS n, count(*) FILTER (translate(forward,'ACTG','0123') = d) AS plus FROM read_kmers GROUP BY d HAVING count(*) >= 2")
def _(spark, d):
    return _text(KD.count_stranded(V.reads(spark, d), K, 2), "n", "plus")


@query("c63_kmer_window", "reads", f"SELECT spotid, i - 1 AS pos, substr(bases, i, {K}) AS kmer FROM (SELECT spotid, bases, unnest(range(1, length(bases)-{K-2})) AS i FROM reads WHERE length(bases) >= {K})")
def _(spark, d):
    r = V.reads(spark, d).where(F.length("bases") >= K)
    return _text(r.select("spotid", F.posexplode(S.kmers("bases", K, False)).alias("pos", "kmer")), "spotid", F.col("pos").cast("long").alias("pos"))


@query("c81_kmer_codes", "coded", "SELECT kmer, list_sum(list_transform(range(1, 12), lambda p: (instr('ACTG', substr(kmer, CAST(p AS BIGINT), 1)) - 1) * (4 ** (11 - p))::BIGINT))::BIGINT AS code FROM (SELECT DISTINCT kmer FROM coded)")
def _(spark, d):
    return KD.explode_kmers(V.reads(spark, d), K).distinct().select(S.decode("kmer", K).alias("kmer"), F.col("kmer").alias("code"))


@query("c84_hash_halves", "coded", "SELECT substr(kmer, 1, 5) AS head, count(*) AS n FROM (SELECT DISTINCT kmer FROM coded) GROUP BY 1")
def _(spark, d):
    h = KD.explode_kmers(V.reads(spark, d), K).distinct().groupBy(S.left_half("kmer", K).alias("code")).agg(F.count("*").alias("n"))
    return h.select(S.decode("code", 5).alias("head"), "n")


@query("c85_reverse_complement", "reads", "SELECT spotid, md5(reverse(translate(bases,'ACTG','TGAC'))) AS rc FROM reads")
def _(spark, d):
    return V.reads(spark, d).select("spotid", F.md5(S.revcomp("bases").cast("binary")).alias("rc"))


@query("c86_canonical", "coded", "SELECT count(DISTINCT kmer) AS kmers, count(*) AS n, count(*) FILTER (kmer < reverse(translate(kmer,'ACTG','TGAC'))) AS alphabetical FROM coded")
def _(spark, d):
    k = _text(KD.explode_kmers(V.reads(spark, d), K))
    return k.agg(F.count_distinct("kmer").alias("kmers"), F.count("*").alias("n"), F.count_if(F.col("kmer") < S.revcomp("kmer")).alias("alphabetical"))


@query("c87_transformations", "coded", "SELECT kmer, reverse(kmer) AS reversed, translate(kmer,'ACTG','TGAC') AS complemented, reverse(translate(kmer,'ACTG','TGAC')) AS both FROM (SELECT DISTINCT kmer FROM coded)")
def _(spark, d):
    k = KD.explode_kmers(V.reads(spark, d), K).distinct()
    t = lambda r, c: S.decode(S.transform_code("kmer", K, r, c), K)
    return k.select(S.decode("kmer", K).alias("kmer"), t(True, False).alias("reversed"), t(False, True).alias("complemented"), t(True, True).alias("both"))


@query("c88_masking", "raw_reads", "SELECT spotid, length(bases) AS n, md5(translate(bases,'ACTG','TGAC')) AS complemented, md5(repeat('N', length(bases))) AS masked FROM raw_reads")
def _(spark, d):
    r = V.raw_reads(spark, d)
    return r.select("spotid", F.length("bases").cast("long").alias("n"), F.md5(S.complement("bases").cast("binary")).alias("complemented"), F.md5(F.repeat(F.lit("N"), F.length("bases")).cast("binary")).alias("masked"))


@query("c82_kmer_text", "coded", "SELECT DISTINCT kmer, kmer AS again FROM coded")
def _(spark, d):
    k = KD.explode_kmers(V.reads(spark, d), K).distinct().select(S.decode("kmer", K).alias("kmer"))
    return k.select("kmer", S.decode(S.encode("kmer"), K).alias("again"))


@query("c93_spot_names", "", "SELECT doc_id AS spotid, md5(translate(text, chr(9) || chr(10), '  ')) AS name FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    return V.table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("spotid"), F.md5(S.clean_spot("text").cast("binary")).alias("name"))


@query("c89_fnv_hash", "coded", """SELECT kmer, CAST(h AS DECIMAL(20,0)) AS fnv FROM (SELECT kmer, list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(0, 8), lambda i: ((code >> (8*i)::INTEGER) & 255)::UHUGEINT)), lambda h, b: xor((h * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT, b)) AS h
  FROM (SELECT kmer, list_sum(list_transform(range(1, 12), lambda p: (instr('ACTG', substr(kmer, CAST(p AS BIGINT), 1)) - 1) * (4 ** (11 - p))::BIGINT))::BIGINT AS code FROM (SELECT DISTINCT kmer FROM coded)))""")
def _(spark, d):
    k = KD.explode_kmers(V.reads(spark, d), K).distinct()
    return k.select(F.col("kmer").alias("code"), S.fnv1("kmer").alias("fnv")).select(S.decode("code", K).alias("kmer"), "fnv")


@query("c21_split_runs", "raw_reads", "SELECT spotid, run, count(*) AS n FROM (SELECT spotid, unnest(regexp_extract_all(bases, '[ACGT]+')) AS run FROM raw_reads) GROUP BY spotid, run")
def _(spark, d):
    return KD.clean_runs(V.raw_reads(spark, d), "spotid").groupBy("spotid", F.col("bases").alias("run")).agg(F.count("*").alias("n"))


@query("c22_cut_reads", "raw_reads", "SELECT spotid, regexp_extract(bases, '^[ACGT]*') AS head FROM raw_reads WHERE regexp_extract(bases, '^[ACGT]*') <> ''")
def _(spark, d):
    return V.raw_reads(spark, d).select("spotid", S.acgt_cut("bases").alias("head")).where("head <> ''")


@query("c24_clean_substrings", "raw_reads", "SELECT length(run) AS len, count(*) AS n FROM (SELECT unnest(regexp_extract_all(bases, '[ACGT]+')) AS run FROM raw_reads) GROUP BY 1")
def _(spark, d):
    return KD.clean_runs(V.raw_reads(spark, d)).groupBy(F.length("bases").cast("long").alias("len")).agg(F.count("*").alias("n"))


@query("c20_spot_filter", "reads", "SELECT spotid, length(bases) AS n FROM reads WHERE spotid IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) AND spotid NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)")
def _(spark, d):
    r, l = V.reads(spark, d), V.table(spark, d, "lineitem")  # noqa: E741
    keep, drop = l.where("l_quantity > 45").select(F.col("l_orderkey").alias("spotid")), l.where("l_quantity > 48").select(F.col("l_partkey").alias("spotid"))
    return r.join(keep, "spotid", "left_semi").join(drop, "spotid", "left_anti").select("spotid", F.length("bases").cast("long").alias("n"))


@query("c23_skip_sampling", "reads", "SELECT spotid, bases FROM (SELECT spotid, bases, row_number() OVER (ORDER BY spotid) AS place FROM reads) WHERE place % 8 = 0")
def _(spark, d):
    from seqloom.operators.numbering import numbered

    return numbered(V.reads(spark, d), "spotid").where("(row + 1) % 8 = 0").select("spotid", "bases")


_AT = "substr(kmer, CAST(i - {0} AS BIGINT), 1)"
_SAME = lambda p: " AND ".join(f"{_AT.format(0)} = {_AT.format(j * p)}" for j in range(1, 5))
_PREDICTED = f"len(list_filter(range(5, {K + 1}), lambda i: ({_SAME(1)}) OR (i > 8 AND {_SAME(2)})))"


@query("c25_low_complexity", "coded", f"SELECT kmer, CAST({_PREDICTED} AS INTEGER) AS predicted FROM (SELECT DISTINCT kmer FROM coded)")
def _(spark, d):
    k = _text(KD.explode_kmers(V.reads(spark, d), K).distinct())
    return k.select("kmer", S.predicted("kmer").alias("predicted"))


@query("c45_kmer_sets", "coded", "SELECT kmer, string_agg(DISTINCT CAST(100 + spotid % 25 AS VARCHAR), ',' ORDER BY CAST(100 + spotid % 25 AS VARCHAR)) AS taxa FROM coded GROUP BY kmer")
def _(spark, d):
    m = KD.build_multi(_tagged(spark, d))
    return _text(m, F.array_join(F.col("tax_ids").cast("array<string>"), ",").alias("taxa"))


@query("c46_merge_dbs", "db_a db_b", "SELECT kmer FROM db_a UNION SELECT kmer FROM db_b")
def _(spark, d):
    return _text(KD.merge_dbs(_a(spark, d), _b(spark, d)))


@query("c76_and_db", "db_a db_b", "SELECT kmer FROM db_a INTERSECT SELECT kmer FROM db_b")
def _(spark, d):
    return _text(_a(spark, d).intersect(_b(spark, d)))


@query("c77_or_db", "db_a db_b", "SELECT count(*) AS n FROM (SELECT kmer FROM db_a UNION SELECT kmer FROM db_b)")
def _(spark, d):
    return _a(spark, d).union(_b(spark, d)).distinct().agg(F.count("*").alias("n"))


@query("c78_subtract_db", "db_a db_b", "SELECT kmer FROM db_a EXCEPT SELECT kmer FROM db_b")
def _(spark, d):
    return _text(_a(spark, d).subtract(_b(spark, d)))


@query("c79_subtract_dbs", "kmer_db db_b", "SELECT kmer, tax_id FROM kmer_db WHERE kmer NOT IN (SELECT kmer FROM db_b)")
def _(spark, d):
    return _text(_index(spark, d).join(_b(spark, d), "kmer", "left_anti"), "tax_id")


@query("c97_build_index", "kmer_db", "SELECT kmer, tax_id FROM kmer_db")
def _(spark, d):
    return _text(_index(spark, d), "tax_id")


@query("c98_identify_tax_ids", "kmer_db db_b", "SELECT kmer, tax_id FROM kmer_db WHERE kmer IN (SELECT kmer FROM db_b)")
def _(spark, d):
    return _text(KD.identify(_b(spark, d), _tagged(spark, d), TX.lineages(V.taxonomy(spark, d))), "tax_id")


@query("c37_index_recheck", "coded db_b", "SELECT kmer, count(DISTINCT spotid) AS seqs FROM coded WHERE kmer IN (SELECT kmer FROM db_b) GROUP BY kmer")
def _(spark, d):
    counts = _by_read(spark, d).distinct().groupBy("kmer").agg(F.count("*").alias("seqs"))
    return _text(counts.join(_b(spark, d), "kmer", "left_semi"), "seqs")


@query("c39_merge_kingdoms", "coded lineage", """WITH hi AS (SELECT DISTINCT kmer, CAST(100 + min(spotid % 25) AS INTEGER) AS a FROM coded WHERE lang = 'en' GROUP BY kmer), lo AS (SELECT kmer, CAST(1000 + 1 + min(spotid % 50) AS INTEGER) AS b FROM coded WHERE lang <> 'en' GROUP BY kmer),
  m AS (SELECT kmer, a, b, la.lineage AS x, lb.lineage AS y FROM hi FULL JOIN lo USING (kmer) LEFT JOIN lineage la ON la.tax_id = a LEFT JOIN lineage lb ON lb.tax_id = b)
  SELECT kmer, CAST(CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a WHEN len(x) > 3 THEN a ELSE x[len(list_filter(range(1, least(len(x), len(y)) + 1), lambda i: x[1:i] = y[1:i]))] END AS INTEGER) AS tax_id FROM m""")
def _(spark, d):
    k = KD.explode_kmers(V.reads(spark, d), K, "spotid", "lang")
    high = k.where("lang = 'en'").groupBy("kmer").agg((F.min(F.col("spotid") % 25) + 100).cast("int").alias("tax_id"))
    low = k.where("lang <> 'en'").groupBy("kmer").agg((F.min(F.col("spotid") % 50) + 1001).cast("int").alias("tax_id"))
    return _text(KD.merge_kingdoms(high, low, TX.lineages(V.taxonomy(spark, d)), 3), "tax_id")


@query("c40_merge_tax_ids", "coded lineage", """SELECT kmer, CAST(x[len(x)] AS INTEGER) AS tax_id FROM (SELECT kmer, list_filter(list_transform(range(1, least(len(lo), len(hi))+1), lambda i: CASE WHEN lo[1:i] = hi[1:i] THEN lo[i] END), lambda v: v IS NOT NULL) AS x
  FROM (SELECT kmer, min(lineage) AS lo, max(lineage) AS hi FROM (SELECT kmer, lang, CAST(100 + min(spotid % 25) AS INTEGER) AS t FROM coded GROUP BY kmer, lang) JOIN lineage ON tax_id = t GROUP BY kmer))""")
def _(spark, d):
    k = KD.explode_kmers(V.reads(spark, d), K, "spotid", "lang").groupBy("kmer", "lang").agg((F.min(F.col("spotid") % 25) + 100).cast("int").alias("tax_id"))
    return _text(TX.consensus(k.where("tax_id <> 0"), ["kmer"], TX.lineages(V.taxonomy(spark, d))), "tax_id")


@query("c53_annotation", "kmer_db", "SELECT tax_id, count(*) AS n FROM kmer_db GROUP BY tax_id")
def _(spark, d):
    return KD.annotation(_index(spark, d))


@query("c26_filter_db", "kmer_db", f"SELECT kmer, tax_id FROM kmer_db WHERE tax_id = 110 AND NOT {_PREDICTED} >= {13 * K // 32}")
def _(spark, d):
    return _text(KD.filter_db(_index(spark, d), K, 110), "tax_id")


@query("c27_filter_root", "kmer_db", "SELECT kmer, tax_id FROM kmer_db WHERE tax_id NOT IN (0, 1)")
def _(spark, d):
    return _text(_index(spark, d).where(~F.col("tax_id").isin(0, 1)), "tax_id")


@query("c28_pair_tax_ids", "db_b kmer_db", "SELECT kmer, tax_id FROM db_b JOIN kmer_db USING (kmer) WHERE tax_id <> 0")
def _(spark, d):
    return _text(_b(spark, d).join(_index(spark, d), "kmer").where("tax_id <> 0"), "tax_id")


@query("c30_constant_tax", "db_b", "SELECT kmer, 10239 AS tax_id FROM db_b")
def _(spark, d):
    return _text(_b(spark, d).withColumn("tax_id", F.lit(10239)), "tax_id")


@query("c15_text_dump", "kmer_db", "SELECT kmer || chr(9) || tax_id AS line FROM kmer_db WHERE tax_id <> 1")
def _(spark, d):
    return KD.dump_text(_index(spark, d), K)


@query("c31_existence", "coded", "SELECT DISTINCT spotid FROM coded WHERE kmer IN (SELECT kmer FROM coded GROUP BY kmer HAVING count(DISTINCT spotid) >= 40)")
def _(spark, d):
    k = _db(K, d, spark)
    return k.join(k.groupBy("kmer").agg(F.count_distinct("spotid").alias("c")).where("c >= 40").select("kmer"), "kmer", "left_semi").select("spotid").distinct()


@query("c32_all_matches", "coded db_b", "SELECT spotid, count(*) AS n FROM coded JOIN db_b USING (kmer) GROUP BY spotid")
def _(spark, d):
    return _db(K, d, spark).join(_b(spark, d), "kmer").groupBy("spotid").agg(F.count("*").alias("n"))


@query("c33_classify", "hit_rows", "SELECT spotid, tax_id, n FROM hit_rows")
def _(spark, d):
    return KD.hits(_db(K, d, spark), _index(spark, d), "spotid")


@query("c34_classify_multi", "coded", "SELECT c.spotid, m.t AS tax_id, count(*) AS n FROM coded c JOIN (SELECT DISTINCT kmer, CAST(100 + spotid % 25 AS INTEGER) AS t FROM coded WHERE lang = 'es') m USING (kmer) GROUP BY 1, 2")
def _(spark, d):
    m = KD.build_multi(KD.explode_kmers(V.reads(spark, d).where("lang = 'es'"), K, "spotid").select("kmer", V.tax_of(F.col("spotid")).alias("tax_id")))
    return KD.multi_hits(_by_read(spark, d), m, "spotid", small=True)  # of k-mers of 11 bases there are 4**11 / 2


@query("c35_two_step_classify", "coded kmer_db", """WITH s AS (SELECT DISTINCT tax_id FROM coded JOIN kmer_db USING (kmer) WHERE tax_id >= 100) SELECT spotid, tax_id, count(*) AS n FROM coded JOIN kmer_db USING (kmer) WHERE tax_id IN (SELECT tax_id FROM s) GROUP BY 1, 2""")
def _(spark, d):
    db = _index(spark, d)
    taxa = KD.hits(_db(K, d, spark), db, "spotid").where("tax_id >= 100").select("tax_id").distinct()
    return KD.hits(_db(K, d, spark), db.join(taxa, "tax_id", "left_semi"), "spotid")


@query("c36_many_databases", "coded db_a db_b", "SELECT db, spotid, count(*) AS n FROM (SELECT 'a' AS db, spotid FROM coded JOIN db_a USING (kmer) UNION ALL SELECT 'b', spotid FROM coded JOIN db_b USING (kmer)) GROUP BY 1, 2")
def _(spark, d):
    dbs = _a(spark, d).withColumn("db", F.lit("a")).union(_b(spark, d).withColumn("db", F.lit("b")))
    return _db(K, d, spark).join(dbs, "kmer").groupBy("db", "spotid").agg(F.count("*").alias("n"))


@query("c47_fragment_hits", "hit_rows", "SELECT tax_id, count(*) AS spots, CAST(sum(n) AS BIGINT) AS n FROM hit_rows WHERE tax_id <> 0 GROUP BY tax_id")
def _(spark, d):
    return KD.hits(_db(K, d, spark), _index(spark, d), "spotid").groupBy("tax_id").agg(F.count("*").alias("spots"), F.sum("n").alias("n"))


@query("c48_unique_hits", "coded kmer_db", "SELECT spotid, tax_id, count(DISTINCT kmer) AS n FROM coded JOIN kmer_db USING (kmer) GROUP BY 1, 2")
def _(spark, d):
    return KD.unique_hits(_by_read(spark, d), _small(_index(spark, d)), "spotid")


@query("c50_collate", "hit_rows", "SELECT spotid, string_agg(tax_id || 'x' || n, ' ' ORDER BY tax_id) AS hits FROM hit_rows GROUP BY spotid")
def _(spark, d):
    c = KD.collate(KD.hits(_db(K, d, spark), _index(spark, d), "spotid"))
    return c.select("spotid", F.array_join(F.transform("hits", lambda h: F.concat(h["tax_id"], F.lit("x"), h["n"])), " ").alias("hits"))


@query("c17_hit_vectors", "hit_rows", "SELECT spotid, string_agg(tax_id || 'x' || n, ' ' ORDER BY tax_id) AS hits FROM hit_rows GROUP BY spotid")
def _(spark, d):
    """Collated hits, written as vectors and read again."""
    path = shared_folder(spark, "vectors")
    KD.write_hit_vectors(KD.collate(KD.hits(_db(K, d, spark), _index(spark, d), "spotid")), path)
    return KD.read_hit_vectors(spark, path).select("spotid", F.array_join(F.transform("hits", lambda h: F.concat(h["tax_id"], F.lit("x"), h["n"])), " ").alias("hits"))


@query("c49_tax_sets", "hit_rows", "SELECT spotid, string_agg(tax_id, ',' ORDER BY tax_id) AS taxa FROM hit_rows GROUP BY spotid")
def _(spark, d):
    return KD.tax_sets(KD.hits(_db(K, d, spark), _index(spark, d), "spotid")).select("spotid", F.array_join(F.col("taxa").cast("array<string>"), ",").alias("taxa"))


@query("c51_compact_group", "hit_rows", "SELECT taxa, count(*) AS n FROM (SELECT string_agg(tax_id, ',' ORDER BY tax_id) AS taxa FROM hit_rows GROUP BY spotid) GROUP BY taxa")
def _(spark, d):
    return KD.compact(KD.hits(_db(K, d, spark), _index(spark, d), "spotid")).select(F.array_join(F.col("taxa").cast("array<string>"), ",").alias("taxa"), "n")


@query("c16_hit_lines", "hit_rows", "SELECT spotid || chr(9) || string_agg(tax_id || CASE WHEN n > 1 THEN 'x' || n ELSE '' END, chr(9) ORDER BY tax_id) AS line FROM hit_rows GROUP BY spotid")
def _(spark, d):
    return KD.format_hits(KD.collate(KD.hits(_db(K, d, spark), _index(spark, d), "spotid")))


@query("c92_parse_hits", "hit_rows", "SELECT CAST(spotid AS VARCHAR) AS spotid, tax_id, n FROM hit_rows")
def _(spark, d):
    return KD.parse_hits(KD.format_hits(KD.collate(KD.hits(_db(K, d, spark), _index(spark, d), "spotid"))))


@query("c38_contamination", "doc20 bench_db", "SELECT spotid, pos, kmer, item_id AS tax_id FROM doc20 JOIN bench_db USING (kmer)")
def _(spark, d):
    b = KD.explode_kmers(V.table(spark, d, "benchmark").select("item_id", V.bases_of("text").alias("bases")), 20, "item_id").distinct().withColumnRenamed("item_id", "tax_id")
    return KD.contamination(V.reads(spark, d), b, 20, "spotid").select("spotid", F.col("pos").cast("long").alias("pos"), S.decode("kmer", 20).alias("kmer"), "tax_id")


@query("c58_contamination_totals", "doc20 bench_db", "SELECT source, count(*) AS hits, count(DISTINCT spotid) AS seqs FROM doc20 JOIN (SELECT DISTINCT kmer FROM bench_db) USING (kmer) GROUP BY source HAVING count(*) > 0")
def _(spark, d):
    b = KD.explode_kmers(V.table(spark, d, "benchmark").select("item_id", V.bases_of("text").alias("bases")), 20).distinct()
    return KD.explode_kmers(V.reads(spark, d), 20, "spotid", "source").join(b, "kmer", "left_semi").groupBy("source").agg(F.count("*").alias("hits"), F.count_distinct("spotid").alias("seqs"))


@query("c52_centroid", "coded", "SELECT lang, kmer, count(DISTINCT spotid) AS n_seq FROM coded GROUP BY lang, kmer HAVING count(DISTINCT spotid) >= 2")
def _(spark, d):
    return _text(PR.centroids(KD.explode_kmers(V.reads(spark, d), K, "lang", "spotid"), "lang", "spotid").where("n_seq >= 2"), "lang", "n_seq")


@query("c59_read_statistics", "fragments", "SELECT readgroup, count(*) AS reads, count(DISTINCT spotid) AS spots, CAST(sum(length(bases)) AS BIGINT) AS bases FROM fragments GROUP BY readgroup")
def _(spark, d):
    return V.fragments(spark, d).groupBy("readgroup").agg(F.count("*").alias("reads"), F.count_distinct("spotid").alias("spots"), F.sum(F.length("bases")).alias("bases"))


@query("c64_minimizers", "win_kmers", "SELECT spotid, w AS win, translate(dg,'0123','ACTG') AS kmer FROM (SELECT *, row_number() OVER (PARTITION BY spotid, w ORDER BY md5(dg), pos) AS r FROM win_kmers) WHERE r = 1")
def _(spark, d):
    return _text(KD.minimizers(V.reads(spark, d), K, 64, "spotid", hashed=_md5), "spotid", F.col("win").cast("long").alias("win"))


@query("c64_minimizers_fnv", "win_kmers", """WITH h AS (SELECT dg, list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(0, 8), lambda i: ((code >> (8*i)::INTEGER) & 255)::UHUGEINT)), lambda h, b: xor((h * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT, b)) AS h
  FROM (SELECT dg, list_sum(list_transform(range(1, 12), lambda p: (ascii(substr(dg, CAST(p AS BIGINT), 1)) - 48) * (4 ** (11 - p))::BIGINT))::BIGINT AS code FROM (SELECT DISTINCT dg FROM win_kmers)))
  SELECT spotid, w AS win, translate(dg,'0123','ACTG') AS kmer FROM (SELECT *, row_number() OVER (PARTITION BY spotid, w ORDER BY h, pos) AS r FROM win_kmers JOIN h USING (dg)) WHERE r = 1""")
def _(spark, d):
    return _text(KD.minimizers(V.reads(spark, d), K, 64, "spotid"), "spotid", F.col("win").cast("long").alias("win"))


@query("c65_variable_window", "reads", "SELECT spotid, CAST(CASE WHEN length(bases) // 64 < 3 THEN greatest(12, length(bases) // 3) ELSE 64 END AS INTEGER) AS win FROM reads")
def _(spark, d):
    return V.reads(spark, d).select("spotid", KD.window_size(F.length("bases"), 64, 12, 3).cast("int").alias("win"))


@query("c66_window_policy", "", "SELECT source, CAST(greatest(CASE WHEN source LIKE '%1' THEN 64 WHEN source LIKE '%2' THEN 8000 ELSE 2000 END // 4, 20) AS INTEGER) AS win FROM (SELECT DISTINCT source FROM documents)")
def _(spark, d):
    s = V.table(spark, d, "documents").select("source").distinct()
    return s.select("source", KD.window_policy(F.col("source").endswith("1"), F.col("source").endswith("2"), 4, 20).alias("win"))


@query("c67_sampled_lookups", "coded reads", "SELECT spotid, kmer FROM (SELECT spotid, kmer, row_number() OVER (PARTITION BY spotid, (pos-1) // w ORDER BY md5(translate(kmer,'ACTG','0123')), pos) AS r FROM (SELECT c.spotid, c.pos, c.kmer, CAST(greatest(1, ceil((length(r.bases) - 10) / 20.0)) AS BIGINT) AS w FROM coded c JOIN reads r USING (spotid))) WHERE r = 1")
def _(spark, d):
    return _text(KD.sampled_lookups(V.reads(spark, d), K, 20, "spotid", hashed=_md5), "spotid")


@query("c68_encoded_position", "reads", "SELECT spotid, CAST(8 * (100 + spotid % 25) + 40 * 8 // length(bases) AS BIGINT) AS code FROM reads WHERE length(bases) >= 50")
def _(spark, d):
    r = V.reads(spark, d).where(F.length("bases") >= 50)
    return r.select("spotid", PR.encode_position(V.tax_of(F.col("spotid")), F.lit(40), F.length("bases"), 8).alias("code"))


@query("c71_sorted_kmers", "kmer_db", f"SELECT tax_id, kmer, CAST(row_number() OVER (PARTITION BY tax_id ORDER BY {_DIGITS}) AS INTEGER) AS place FROM kmer_db")
def _(spark, d):
    from pyspark.sql import Window

    db = _index(spark, d).withColumn("place", F.row_number().over(Window.partitionBy("tax_id").orderBy("kmer")))
    return _text(db, "tax_id", "place")


@query("c73_begin_order", "coded", f"SELECT kmer, n, row_number() OVER (ORDER BY n DESC, {_DIGITS} DESC) AS place FROM (SELECT kmer, count(*) AS n FROM coded GROUP BY kmer)")
def _(spark, d):
    return _text(KD.begins(KD.count_kmers(V.reads(spark, d), K)), "n", "place")


@query("c80_split_by_tax", "kmer_db", "SELECT tax_id, count(*) AS n, min(kmer) AS first FROM kmer_db WHERE tax_id IN (SELECT 100 + n_nationkey FROM nation WHERE n_regionkey = 2) GROUP BY tax_id")
def _(spark, d):
    keep = V.table(spark, d, "nation").where("n_regionkey = 2").select((F.col("n_nationkey") + 100).alias("tax_id"))
    return _text(_index(spark, d).join(keep, "tax_id", "left_semi"), "tax_id").groupBy("tax_id").agg(F.count("*").alias("n"), F.min("kmer").alias("first"))


@query("c96_raw_kmers", "coded", "SELECT spotid, kmer, count(*) AS n FROM coded GROUP BY 1, 2")
def _(spark, d):
    return _text(_by_read(spark, d).groupBy("spotid", "kmer").agg(F.count("*").alias("n")), "spotid", "n")


@query("c72_minhash_profile", "profiles", "SELECT source, place, kmer FROM profiles")
def _(spark, d):
    p = PR.profiles(KD.explode_kmers(V.reads(spark, d), K, "source"), "source", MASKS)
    return _text(p.select("source", F.posexplode("profile").alias("place", "kmer")), "source", "place")


@query("c95_profile_similarity", "profiles", f"""SELECT source, other, similarity FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY similarity DESC, other) AS r FROM
  (SELECT a.source, b.source AS other, count(*) / CAST({MASKS} AS DOUBLE) AS similarity FROM profiles a JOIN profiles b ON a.place = b.place AND a.kmer = b.kmer AND a.source <> b.source GROUP BY 1, 2)) WHERE r <= 5""")
def _(spark, d):
    p = PR.profiles(KD.explode_kmers(V.reads(spark, d), K, "source"), "source", MASKS)
    return PR.closest(p, "source", 5)


@query("c74_nearest_profiles", "", """SELECT vec_id, other, CAST(same AS DOUBLE) / 64 AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY same DESC, other) AS r FROM
  (SELECT a.vec_id, b.vec_id AS other, len(list_filter(range(1, 65), lambda i: (a.embedding[i] > 0) = (b.embedding[i] > 0))) AS same FROM embeddings a JOIN embeddings b ON b.vec_id <> a.vec_id WHERE a.vec_id % 50 = 0)) WHERE r <= 3""")
def _(spark, d):
    e = V.table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x > 0).alias("profile"))
    return PR.nearest(e.where("vec_id % 50 = 0"), e, "vec_id", 3)


@query("c69_reach", "", "SELECT contig, pos, CAST(greatest(max(pos + len) OVER (PARTITION BY contig ORDER BY pos ROWS UNBOUNDED PRECEDING) - pos, 0) AS BIGINT) AS reach FROM (SELECT user_id AS contig, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS pos, max(CAST(trunc(value) AS BIGINT)) AS len FROM events GROUP BY 1, 2)")
def _(spark, d):
    e = V.table(spark, d, "events").select(F.col("user_id").alias("contig"), F.unix_timestamp("ts").alias("pos"), F.col("value").cast("long").alias("len"))
    return KD.coverage_reach(e)


@query("c41_connectivity", "reads", f"""WITH b AS (SELECT item_id, upper(regexp_replace(text,'[^ACGTacgt]','','g')) AS bases FROM benchmark),
  c AS (SELECT item_id, i - 1 AS pos, {_canon20('substr(bases, i, 20)')} AS kmer FROM (SELECT item_id, bases, unnest(range(1, length(bases)-18)) AS i FROM b)),
  r AS (SELECT spotid, length(bases) - 20 AS apart, {_canon20('substr(bases, 1, 20)')} AS a, {_canon20('right(bases, 20)')} AS z FROM (SELECT spotid, bases FROM reads UNION ALL SELECT item_id, bases FROM b WHERE length(bases) >= 60) WHERE length(bases) > 20)
  SELECT DISTINCT x.item_id AS contig, r.spotid, CAST(x.pos AS INTEGER) AS first, CAST(y.pos AS INTEGER) AS last FROM r JOIN c x ON x.kmer = r.a JOIN c y ON y.kmer = r.z AND y.item_id = x.item_id WHERE abs(abs(y.pos - x.pos) - r.apart) <= 2""")
def _(spark, d):
    b = V.table(spark, d, "benchmark").select(F.col("item_id").alias("contig"), V.bases_of("text").alias("bases"))
    parts = b.where(F.length("bases") >= 60).select(F.col("contig").alias("spotid"), "bases")
    return KD.connectivity(b, parts.union(V.reads(spark, d).select("spotid", "bases")), 20)


@query("c62_longest_connections", "reads", f"""WITH b AS (SELECT item_id, upper(regexp_replace(text,'[^ACGTacgt]','','g')) AS bases FROM benchmark),
  c AS MATERIALIZED (SELECT item_id, i - 1 AS pos, {_canon20('substr(bases, i, 20)')} AS kmer FROM (SELECT item_id, bases, unnest(range(1, length(bases)-18)) AS i FROM b)),
  r AS MATERIALIZED (SELECT spot, mate, length(bases) - 20 AS apart, {_canon20('substr(bases, 1, 20)')} AS a, {_canon20('right(bases, 20)')} AS z FROM (SELECT item_id AS spot, 1 AS mate, left(bases, 24) AS bases FROM b UNION ALL SELECT item_id, 2, right(bases, 25) FROM b) WHERE length(bases) > 20),
  x AS (SELECT DISTINCT p.item_id AS contig, r.spot, r.mate, least(p.pos, q.pos) AS pos, abs(q.pos - p.pos) + 20 AS len FROM r JOIN c p ON p.kmer = r.a JOIN c q ON q.kmer = r.z AND q.item_id = p.item_id WHERE abs(abs(q.pos - p.pos) - r.apart) <= 2),
  o AS (SELECT contig, spot, mate, min(pos) AS pos, arg_min(len, (pos, len)) AS len FROM x GROUP BY ALL),
  m AS (SELECT l.contig, l.pos, h.pos - l.pos + h.len AS len FROM o l JOIN o h ON h.contig = l.contig AND h.spot = l.spot AND h.mate <> l.mate AND (h.pos > l.pos OR (h.pos = l.pos AND (h.len > l.len OR (h.len = l.len AND h.mate > l.mate)))) WHERE h.pos - l.pos < 1000)
  SELECT contig, CAST(pos AS INTEGER) AS pos, CAST(max(len) AS INTEGER) AS len FROM (SELECT contig, pos, len FROM x UNION ALL SELECT * FROM m) GROUP BY ALL""")
def _(spark, d):
    """Both ends of each benchmark item as mates, sought in all items."""
    b = V.table(spark, d, "benchmark").select(F.col("item_id").alias("contig"), V.bases_of("text").alias("bases"))
    mate = lambda n, text: F.struct(F.lit(n).alias("mate"), text.alias("bases"))
    ends = b.select(F.col("contig").alias("spot"), F.inline(F.array(mate(1, F.expr("left(bases, 24)")), mate(2, F.expr("right(bases, 25)")))))
    met = KD.connectivity(b, ends.select(F.struct("spot", "mate").alias("spotid"), "bases"), 20)
    return KD.longest_connections(met.select("contig", "spotid.spot", "spotid.mate", "first", "last"), 20)


@query("c70_effective_window", "coded db_b reads", """WITH w AS (SELECT unnest([16, 32, 64, 128, 256, 512, 1024]) AS size), hit AS (SELECT DISTINCT spotid, pos - 1 AS pos FROM coded JOIN db_b USING (kmer)),
  found AS (SELECT size, count(*) AS identified FROM (SELECT DISTINCT size, spotid, pos // size AS win FROM hit, w WHERE pos % size <= size - 11) x JOIN reads r USING (spotid) WHERE (win + 1) * size <= length(bases) GROUP BY size),
  every AS (SELECT size, CAST(sum(length(bases) // size) AS BIGINT) AS windows FROM reads, w GROUP BY size), t AS (SELECT size, windows, coalesce(identified, 0) AS identified FROM every LEFT JOIN found USING (size))
  SELECT CAST(size AS INTEGER) AS size, windows, identified, coalesce(size = (SELECT min(size) FROM t WHERE identified >= 0.9 * windows AND windows > 0), false) AS effective FROM t""")
def _(spark, d):
    return KD.effective_window(V.reads(spark, d), _small(_b(spark, d)), K, [16 << i for i in range(7)], 0.9)


@query("c61_contig_statistics", "coded", "SELECT source, CAST(sum(n) AS BIGINT) AS coverage, round(avg(n), 6) AS average, round(100.0 * sum(n) / (SELECT count(*) FROM coded), 6) AS percent FROM (SELECT source, kmer, count(*) AS n FROM coded GROUP BY 1, 2) GROUP BY source")
def _(spark, d):
    k = KD.explode_kmers(V.reads(spark, d), K, "source")
    whole = k.agg(F.count("*").alias("whole"))
    s = k.groupBy("source", "kmer").agg(F.count("*").alias("n")).groupBy("source").agg(F.sum("n").alias("coverage"), F.round(F.avg("n"), 6).alias("average"))
    return s.crossJoin(F.broadcast(whole)).select("source", "coverage", "average", F.round(100 * F.col("coverage") / F.col("whole"), 6).alias("percent"))  # one row: the total


@query("c9_kmer_text", "kmer_db", "SELECT kmer, tax_id FROM kmer_db")
def _(spark, d):
    line = F.concat(S.decode("kmer", K), F.lit("\t"), F.col("tax_id").cast("string")).alias("line")
    rows = FM.parse_kmer_text(_index(spark, d).select(line))
    return _text(rows.select("kmer", F.explode("tax_ids").alias("tax_id")), "tax_id")


@query("c101_sam_filter", "coded db_b reads", "SELECT spotid, spotid IN (SELECT spotid FROM coded JOIN db_b USING (kmer)) AS rejected FROM reads")
def _(spark, d):
    fields = [F.col("spotid").cast("string"), *map(F.lit, ["4", "*", "0", "0", "*", "*", "0", "0"]), F.col("bases"), F.lit("*")]
    lines = V.reads(spark, d).select(F.concat_ws("\t", *fields).alias("line"))
    marked = FM.filter_sam(lines, _small(_b(spark, d)), K)
    return marked.select(F.split("line", "\t")[0].cast("long").alias("spotid"), "rejected")


@query("c19_sam_mask", "coded db_b reads", """SELECT spotid, md5(CASE WHEN spotid IN (SELECT spotid FROM coded JOIN db_b USING (kmer)) THEN repeat('N', length(bases)) ELSE bases END) AS bases FROM reads""")
def _(spark, d):
    fields = [F.col("spotid").cast("string"), *map(F.lit, ["4", "*", "0", "0", "*", "*", "0", "0"]), F.col("bases"), F.lit("*")]
    lines = V.reads(spark, d).select(F.concat_ws("\t", *fields).alias("line"))
    f = F.split("line", "\t")
    return FM.mask_sam(FM.filter_sam(lines, _small(_b(spark, d)), K)).select(f[0].cast("long").alias("spotid"), F.md5(f[9].cast("binary")).alias("bases"))
