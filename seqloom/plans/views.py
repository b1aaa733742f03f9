"""Sequencing tables as projections of the given tables: as DataFrames, and as SQL views for another engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

K = 11


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def bases_of(text: str) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[^ACGTacgt]+", ""))


def reads(spark: SparkSession, d: str) -> DataFrame:
    """``spotid, bases, source, lang``: a read a document, of its letters A, C, G and T."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("spotid"), bases_of("text").alias("bases"), "source", "lang")


def raw_reads(spark: SparkSession, d: str) -> DataFrame:
    """``spotid, bases``: all letters other than A, C, G and T are N."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return table(spark, d, "documents").select(F.col("doc_id").alias("spotid"), F.upper(F.regexp_replace(text, "[^ACGTacgt]", "N")).alias("bases"))


def fragments(spark: SparkSession, d: str) -> DataFrame:
    """``spotid, frag, readgroup, bases, quals``: a spot a conversation, a fragment a turn."""
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("spotid"), F.col("turn").alias("frag"), F.col("role").alias("readgroup"), bases_of("text").alias("bases"))
    return rows.withColumn("quals", F.translate("bases", "ACGT", "I5#!"))


def alignments(spark: SparkSession, d: str) -> DataFrame:
    """Alignments, one a line item; positions count from 1."""
    l = table(spark, d, "lineitem")  # noqa: E741
    n = F.col("l_quantity").cast("int")
    half = F.greatest(F.lit(1), F.floor(n / 2).cast("int"))
    rest = F.greatest(F.lit(1), n - half)
    form = F.col("l_linenumber") % 4
    cigar = F.when(form == 0, F.concat(n, F.lit("M"))).when(form == 1, F.concat(half, F.lit("M2D"), rest, F.lit("M"))).when(form == 2, F.concat(F.lit("3S"), n, F.lit("M"))).otherwise(F.concat(half, F.lit("M10N"), rest, F.lit("M")))
    ident = F.concat_ws(".", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyyMMdd"), F.round(F.col("l_extendedprice") * 100).cast("long"))
    return l.select(
        ident.alias("id"), F.concat(F.lit("chr"), F.col("l_suppkey") % 5).alias("refspec"), (F.col("l_partkey") * 10).alias("refpos"), n.cast("long").alias("length"), cigar.alias("cigar"),
        F.round(F.col("l_discount") * 100).cast("int").alias("mapq"), (F.col("l_returnflag") == "R").alias("reversed"), F.col("l_orderkey").cast("string").alias("readid"), F.col("l_linestatus").alias("readgroup"),
        F.when(F.col("l_linenumber") > 1, 2).otherwise(1).alias("category"), (F.col("l_tax") * 100).cast("int").alias("softclipleft"),
    )


def gtf(spark: SparkSession, d: str) -> DataFrame:
    """Annotation lines ``chrom, start, end, strand, id``: one a part, brands as feature ids."""
    p = table(spark, d, "part")
    return p.select(F.concat(F.lit("chr"), F.col("p_partkey") % 5).alias("chrom"), (F.col("p_partkey") * 10).alias("start"), (F.col("p_partkey") * 10 + F.col("p_size")).alias("end"), F.when(F.col("p_partkey") % 2 == 0, "+").otherwise("-").alias("strand"), F.concat(F.col("p_brand"), F.lit("-"), F.expr("p_partkey DIV 25")).alias("id"))


def taxonomy(spark: SparkSession, d: str) -> DataFrame:
    """``tax_id, parent_id, rank, name``: root, regions, nations, customers."""
    root = spark.sql("SELECT 1 AS tax_id, 1 AS parent_id, 'root' AS rank, 'root' AS name")
    region = table(spark, d, "region").select((F.col("r_regionkey") + 10).alias("tax_id"), F.lit(1).alias("parent_id"), F.lit("region").alias("rank"), F.col("r_name").alias("name"))
    nation = table(spark, d, "nation").select((F.col("n_nationkey") + 100).alias("tax_id"), (F.col("n_regionkey") + 10).alias("parent_id"), F.lit("nation").alias("rank"), F.col("n_name").alias("name"))
    cust = table(spark, d, "customer").select((F.col("c_custkey") + 1000).cast("int").alias("tax_id"), (F.col("c_nationkey") + 100).alias("parent_id"), F.lit("customer").alias("rank"), F.col("c_name").alias("name"))
    return root.union(region).union(nation).union(cust)


def tax_of(doc_id: Column) -> Column:
    """A label for a document: one of 25 nations."""
    return (F.lit(100) + doc_id % 25).cast("int")


#: Views that a query may name several times and that are to be worked out once.
ONCE = {"nodes", "edges", "graph_nodes", "graph_edges", "graph_reach", "graph_far_edges"}
RC = "reverse(translate({0},'ACTG','TGAC'))"
VIEWS = {
    "reads": ("", "SELECT doc_id AS spotid, upper(regexp_replace(coalesce(text,''),'[^ACGTacgt]','','g')) AS bases, source, lang FROM documents"),
    "raw_reads": ("", "SELECT doc_id AS spotid, upper(regexp_replace(coalesce(text,''),'[^ACGTacgt]','N','g')) AS bases FROM documents"),
    "fragments": ("", "SELECT spotid, frag, readgroup, bases, translate(bases,'ACGT','I5#!') AS quals FROM (SELECT conv_id AS spotid, turn AS frag, role AS readgroup, upper(regexp_replace(coalesce(text,''),'[^ACGTacgt]','','g')) AS bases FROM conversations)"),
    "alignments": ("", """SELECT concat_ws('.', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate,'%Y%m%d'), CAST(round(l_extendedprice*100) AS BIGINT)) AS id,
      'chr' || (l_suppkey % 5) AS refspec, l_partkey*10 AS refpos, CAST(l_quantity AS BIGINT) AS length,
      CASE l_linenumber % 4 WHEN 0 THEN n || 'M' WHEN 1 THEN h || 'M2D' || greatest(1, n-h) || 'M' WHEN 2 THEN '3S' || n || 'M' ELSE h || 'M10N' || greatest(1, n-h) || 'M' END AS cigar,
      CAST(round(l_discount*100) AS INTEGER) AS mapq, l_returnflag = 'R' AS reversed, CAST(l_orderkey AS VARCHAR) AS readid, l_linestatus AS readgroup,
      CAST(CASE WHEN l_linenumber > 1 THEN 2 ELSE 1 END AS INTEGER) AS category, CAST(trunc(l_tax*100) AS INTEGER) AS softclipleft
      FROM (SELECT *, CAST(l_quantity AS INTEGER) AS n, greatest(1, CAST(l_quantity AS INTEGER) // 2) AS h FROM lineitem)"""),
    "gtf": ("", "SELECT 'chr' || (p_partkey % 5) AS chrom, p_partkey*10 AS start, p_partkey*10 + p_size AS \"end\", CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand, p_brand || '-' || (p_partkey // 25) AS id FROM part"),
    "taxonomy": ("", "SELECT 1 AS tax_id, 1 AS parent_id, 'root' AS rank, 'root' AS name UNION ALL SELECT r_regionkey+10, 1, 'region', r_name FROM region UNION ALL SELECT n_nationkey+100, n_regionkey+10, 'nation', n_name FROM nation UNION ALL SELECT CAST(c_custkey+1000 AS INTEGER), c_nationkey+100, 'customer', c_name FROM customer"),
    "lineage": ("taxonomy", """SELECT tax_id, lineage FROM (WITH RECURSIVE walk AS (SELECT tax_id, [tax_id] AS lineage FROM taxonomy WHERE tax_id = 1
      UNION ALL SELECT t.tax_id, list_append(w.lineage, t.tax_id) FROM taxonomy t JOIN walk w ON t.parent_id = w.tax_id WHERE t.tax_id <> 1) SELECT * FROM walk)"""),
    "read_kmers": ("reads", f"SELECT spotid, source, lang, i AS pos, k AS forward, least(translate(k,'ACTG','0123'), translate({RC.format('k')},'ACTG','0123')) AS d FROM (SELECT spotid, source, lang, i, substr(bases, i, {K}) AS k FROM (SELECT spotid, source, lang, bases, unnest(range(1, length(bases)-{K-2})) AS i FROM reads WHERE length(bases) >= {K}))"),
    "coded": ("read_kmers", "SELECT spotid, source, lang, pos, translate(d,'0123','ACTG') AS kmer FROM read_kmers"),
    "kmer_db": ("coded lineage", """SELECT kmer, CAST(coalesce(x[len(x)], 1) AS INTEGER) AS tax_id FROM (SELECT kmer, list_filter(list_transform(range(1, least(len(lo), len(hi))+1), lambda i: CASE WHEN lo[1:i] = hi[1:i] THEN lo[i] END), lambda v: v IS NOT NULL) AS x
      FROM (SELECT kmer, min(lineage) AS lo, max(lineage) AS hi FROM coded JOIN lineage ON lineage.tax_id = 100 + spotid % 25 GROUP BY kmer))"""),
}


def with_views(needs: str, sql: str) -> str:
    """``sql`` under a WITH clause that defines the views named in ``needs`` and those they need."""
    order: list[str] = []

    def visit(name: str) -> None:
        for x in VIEWS[name][0].split():
            visit(x)
        if name not in order:
            order.append(name)

    for name in needs.split():
        visit(name)
    if not order:
        return sql
    head = ", ".join(f"{name} AS {'MATERIALIZED ' if name in ONCE else ''}({VIEWS[name][1]})" for name in order)
    body = sql.lstrip()
    if body.upper().startswith("WITH "):
        return f"WITH {head}, {body[5:]}"
    return f"WITH {head} {body}"
