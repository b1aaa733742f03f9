"""Text formats of sequencing data as DataFrames.  Parsers take a column ``line`` or ``record``, readers take paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import seq as S
from seqloom.operators.kmerdb import gathered
from seqloom.sources.files import read_binary_index, read_fastq, read_nested, read_pairs  # noqa: F401


def parse_fasta(rows: DataFrame) -> DataFrame:
    """``spotid, description, bases`` and the other columns, of records ``value`` that begin behind a ``>`` at a line's start or, a file's first one, with it.

    The id ends at the first space or slash.  Lines may end either way.  A record without bases is an error.
    """
    rows = rows.withColumn("value", F.regexp_replace("value", "^>", "")).where("trim(value) <> ''")
    lines = F.split(F.replace("value", F.lit("\r"), F.lit("")), "\n")
    rest = [c for c in rows.columns if c != "value"]
    parsed = rows.select(F.get(lines, F.lit(0)).alias("description"), F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), "").alias("bases"), *rest)
    checked = F.when(F.col("bases") == "", F.raise_error(F.concat(F.lit("empty read "), F.col("description")))).otherwise(F.col("bases"))
    return parsed.select(F.regexp_extract("description", "^[^ /]*", 0).alias("spotid"), "description", checked.alias("bases"), *rest)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``spotid, description, bases, path`` of FASTA files, wrapped or not; a ``>`` begins a record only at the start of a line."""
    return parse_fasta(spark.read.option("lineSep", "\n>").text(path).select("value", F.input_file_name().alias("path")))


def parse_sam(lines: DataFrame) -> DataFrame:
    """``id, flag, refspec, refpos, mapq, cigar, bases, quals`` of alignment lines; bases in upper case."""
    f = F.split("line", "\t")
    rows = lines.where(~F.col("line").startswith("@"))
    return rows.select(F.get(f, F.lit(0)).alias("id"), F.get(f, F.lit(1)).cast("int").alias("flag"), F.get(f, F.lit(2)).alias("refspec"), F.get(f, F.lit(3)).cast("long").alias("refpos"), F.get(f, F.lit(4)).cast("int").alias("mapq"), F.get(f, F.lit(5)).alias("cigar"), F.upper(F.get(f, F.lit(9))).alias("bases"), F.get(f, F.lit(10)).alias("quals"))


def filter_sam(lines: DataFrame, db: DataFrame, k: int) -> DataFrame:
    """``line, rejected``: whether a line's sequence holds a k-mer of ``db``; header lines are kept."""
    rows = gathered(lines.withColumn("_id", F.monotonically_increasing_id()), "_id", "line")
    seqs = rows.where(~F.col("line").startswith("@")).select("_id", F.explode(S.acgt_runs(F.upper(F.split("line", "\t")[9]))).alias("bases")).where(F.length("bases") >= k)
    bad = seqs.select("_id", F.explode(S.kmers("bases", k)).alias("kmer")).join(db.select("kmer"), "kmer", "left_semi").select("_id").distinct().withColumn("_bad", F.lit(True))
    return rows.join(bad, "_id", "left").select("line", F.coalesce("_bad", F.lit(False)).alias("rejected"))


def mask_sam(filtered: DataFrame) -> DataFrame:
    """Rejected lines with their bases replaced by N."""
    f = F.split("line", "\t")
    masked = F.array_join(F.concat(F.slice(f, 1, 9), F.array(F.repeat(F.lit("N"), F.length(F.get(f, F.lit(9))))), F.slice(f, F.lit(11), F.greatest(F.size(f) - 10, F.lit(0)))), "\t")
    return filtered.select(F.when(F.col("rejected"), masked).otherwise(F.col("line")).alias("line"))


def parse_gtf(lines: DataFrame, feature: str = "exon", key: str = "gene_id") -> DataFrame:
    """``chrom, start, end, strand, id`` of annotation lines of one type; comments and short lines are left out."""
    f = F.split("line", "\t")
    rows = lines.where(~F.col("line").startswith("#") & (F.size(f) >= 9) & (F.get(f, F.lit(2)) == feature))
    ident = F.regexp_extract(F.get(f, F.lit(8)), rf'(?:^|[; ]){key} "?([^";]*)"?', 1)
    return rows.select(F.get(f, F.lit(0)).alias("chrom"), F.get(f, F.lit(3)).cast("long").alias("start"), F.get(f, F.lit(4)).cast("long").alias("end"), F.get(f, F.lit(6)).alias("strand"), ident.alias("id")).where("id <> ''")


def format_features(features: DataFrame) -> DataFrame:
    """Lines ``id TAB strand TAB ref TAB [A|N]start.len;...`` of built features."""
    seg = lambda s: F.concat(F.when(s["amb"], "A").otherwise("N"), s["start"], F.lit("."), s["end"] - s["start"] + 1)
    return features.select(F.concat_ws("\t", "id", F.when(F.col("reverse"), "-").otherwise("+"), "ref", F.array_join(F.transform("segs", seg), ";")).alias("line"))


def parse_features(lines: DataFrame) -> DataFrame:
    """Built features from such lines."""
    f = F.split("line", "\t")

    def seg(t):
        start, n = F.split(F.substr(t, F.lit(2)), r"\.")[0].cast("long"), F.split(F.substr(t, F.lit(2)), r"\.")[1].cast("long")
        return F.struct(start.alias("start"), (start + n - 1).alias("end"), t.startswith("A").alias("amb"))

    rows = lines.where(~F.col("line").startswith("#")).select(F.get(f, F.lit(0)).alias("id"), F.get(f, F.lit(2)).alias("ref"), (F.get(f, F.lit(1)) == "-").alias("reverse"), F.transform(F.filter(F.split(F.get(f, F.lit(3)), ";"), lambda t: t != ""), seg).alias("segs"))
    return rows.withColumn("start", F.array_min(F.transform("segs", lambda s: s["start"]))).withColumn("end", F.array_max(F.transform("segs", lambda s: s["end"])))


def parse_pairs(lines: DataFrame, sep: str = "=") -> DataFrame:
    """``key, value`` lines; ``#`` begins a comment."""
    f = F.split("line", sep, 2)
    return lines.where(~F.col("line").startswith("#") & F.col("line").contains(sep)).select(F.trim(F.get(f, F.lit(0))).alias("key"), F.trim(F.get(f, F.lit(1))).alias("value"))


def parse_agp(lines: DataFrame) -> DataFrame:
    """``object, beg, end, part, type, component, cbeg, cend, strand``; gaps and comments are left out, and lengths must agree."""
    f = F.split("line", "\t")
    rows = lines.where(~F.col("line").startswith("#") & (F.size(f) == 9) & ~F.get(f, F.lit(4)).isin("N", "U"))
    n = lambda i: f[i].cast("int")
    end = F.when(n(2) - n(1) != n(7) - n(6), F.raise_error(F.concat(F.lit("lengths differ: "), F.col("line"))).cast("int")).otherwise(n(2))
    return rows.select(F.get(f, F.lit(0)).alias("object"), n(1).alias("beg"), end.alias("end"), n(3).alias("part"), F.get(f, F.lit(4)).alias("type"), F.get(f, F.lit(5)).alias("component"), n(6).alias("cbeg"), n(7).alias("cend"), F.when(F.get(f, F.lit(8)) == "-", -1).otherwise(1).alias("strand"))


def parse_taxonomy(lines: DataFrame) -> DataFrame:
    """``tax_id, parent_id``; a zero is an error."""
    f = F.split(F.trim("line"), r"\s+")
    rows = lines.where("trim(line) <> ''").select(F.get(f, F.lit(0)).cast("int").alias("tax_id"), F.get(f, F.lit(1)).cast("int").alias("parent_id"))
    bad = F.raise_error(F.lit("a taxon or parent is 0")).cast("int")
    return rows.select(F.when((F.col("tax_id") == 0) | (F.col("parent_id") == 0), bad).otherwise(F.col("tax_id")).alias("tax_id"), "parent_id")


def parse_taxdump(lines: DataFrame, names: list[str]) -> DataFrame:
    """Columns of dump lines whose values stand between ``TAB | TAB``."""
    f = F.split(F.regexp_replace("line", r"\t\|$", ""), r"\t\|\t")
    return lines.select(*(F.try_element_at(f, F.lit(i + 1)).alias(n) for i, n in enumerate(names)))


def parse_kmer_text(lines: DataFrame) -> DataFrame:
    """``kmer, tax_ids`` of lines with a k-mer and none, one or several taxa."""
    f = F.split(F.trim("line"), r"\s+")
    return lines.where("trim(line) <> ''").select(S.encode(F.upper(F.get(f, F.lit(0)))).alias("kmer"), F.slice(f, F.lit(2), F.size(f) - 1).cast("array<int>").alias("tax_ids"))


def tax_of_path(path):
    """A taxon from a file's name, and whether its folders say virus or eukaryote."""
    return F.regexp_extract(path, r"/(\d+)\.[^/]*$", 1).cast("int"), F.contains(path, F.lit("/Viruses/")), F.contains(path, F.lit("/Eukaryota/"))


def best_stretch(reads: DataFrame) -> DataFrame:
    """Reads cut to their leftmost longest ACGT stretch; reads without one are left out."""
    return reads.withColumn("bases", S.longest_run("bases")).where("bases IS NOT NULL")


def write_kmer_db(db: DataFrame, path: str, by_tax: bool = False) -> None:
    """An index as Parquet, sorted by k-mer inside files; with ``by_tax`` in a folder for each taxon, so a list of taxa prunes."""
    out = db.repartition("tax_id").sortWithinPartitions("tax_id", "kmer").write.partitionBy("tax_id") if by_tax else db.repartitionByRange("kmer").sortWithinPartitions("kmer").write
    out.mode("overwrite").parquet(path)


def read_kmer_db(spark: SparkSession, path: str, taxa: list[int] | DataFrame | None = None) -> DataFrame:
    """``kmer, tax_id`` of an index that ``write_kmer_db`` stored; of an index by taxon only the folders of ``taxa`` are read.

    A list prunes folders at planning, a table ``tax_id`` when it runs.
    """
    db = spark.read.parquet(path).select("kmer", F.col("tax_id").cast("int").alias("tax_id"))
    if taxa is None:
        return db
    return db.where(F.col("tax_id").isin(taxa)) if isinstance(taxa, list) else db.join(taxa.select("tax_id").distinct(), "tax_id", "left_semi").select("kmer", "tax_id")


def contig_records(contigs: DataFrame) -> DataFrame:
    """FASTA records ``>Contig_n_abundance`` of contigs ``bases, abundance``, numbered from 1 in the order of their bases."""
    from seqloom.operators.numbering import numbered

    return numbered(contigs, "bases").select(F.concat(F.lit(">Contig_"), F.col("row") + 1, F.lit("_"), F.round("abundance", 2), F.lit("\n"), F.col("bases")).alias("line"))


def write_contigs(contigs: DataFrame, path: str) -> None:
    contig_records(contigs).write.mode("overwrite").text(path)


def fasta_records(rows: DataFrame, width: int = 60) -> DataFrame:
    """Records ``>spotid`` with their bases in lines of ``width``."""
    wrapped = F.regexp_replace("bases", f"(.{{{width}}})(?=.)", "$1\n")
    return rows.select(F.concat(F.lit(">"), F.col("spotid").cast("string"), F.lit("\n"), wrapped).alias("line"))


def parse_alleles(lines: DataFrame) -> DataFrame:
    """``locus, allele, seq`` of lines with these three words; other lines are an error."""
    f = F.split(F.trim("line"), r"\s+")
    bad = F.raise_error(F.concat(F.lit("no allele line: "), F.col("line")))
    rows = lines.where("trim(line) <> ''")
    return rows.select(F.when(F.size(f) == 3, F.get(f, F.lit(0))).otherwise(bad).alias("locus"), F.get(f, F.lit(1)).alias("allele"), F.upper(F.get(f, F.lit(2))).alias("seq"))


# The columns of tabular alignment hits, in order.
HIT_COLUMNS = "query string, subject string, identity double, length int, mismatches int, gaps int, qstart long, qend long, sstart long, send long, evalue double, bits double, btop string"


def parse_tabular_hits(lines: DataFrame) -> DataFrame:
    """Tabular alignment hits of 13 columns, with ``plus``: whether the subject runs forward, and its ends in order."""
    f = F.split("line", "\t")
    kinds = [c.split() for c in HIT_COLUMNS.split(", ")]
    rows = lines.where(~F.col("line").startswith("#") & (F.size(f) == len(kinds))).select(*(F.get(f, F.lit(i)).cast(t).alias(n) for i, (n, t) in enumerate(kinds)))
    return rows.withColumn("plus", F.col("sstart") <= F.col("send")).withColumns({"sstart": F.least("sstart", "send"), "send": F.greatest("sstart", "send")})


def parse_words(lines: DataFrame) -> DataFrame:
    """``word``: all words of list files, which any white space divides."""
    return lines.select(F.explode(F.regexp_extract_all("line", F.lit(r"(\S+)"), 1)).alias("word"))


def parse_file_list(lines: DataFrame) -> DataFrame:
    """``path, size`` of lines ``size TAB path``; the path is the rest of the line."""
    f = F.split("line", "\t", 2)
    return lines.where("trim(line) <> ''").select(F.get(f, F.lit(1)).alias("path"), F.get(f, F.lit(0)).cast("long").alias("size"))
