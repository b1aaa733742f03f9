"""K-mer indexes ``kmer, tax_id``: building, set algebra, classification, collation, contamination."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.functions import seq as S
from seqloom.operators.numbering import numbered
from seqloom.operators.store import cut
from seqloom.operators.taxonomy import ROOT, consensus


def clean_runs(reads: DataFrame, *keep: str) -> DataFrame:
    """A row for each ACGT run of a read."""
    return reads.select(*keep, F.explode(S.acgt_runs("bases")).alias("bases"))


#: Letters of texts in one task of ``gathered``.
LETTERS = 1 << 22


def gathered(rows: DataFrame, key: str, text: str = "bases") -> DataFrame:
    """Rows with all of one ``key`` in one task and some ``LETTERS`` of ``text`` to a task, however large the table.

    What is grouped by ``key`` and more after that needs no further shuffle: texts travel instead of their k-mers.
    """
    letters = rows.agg(F.sum(F.length(text).cast("long"))).first()[0] or 0
    return rows.repartition(max(letters // LETTERS + 1, rows.sparkSession.sparkContext.defaultParallelism), key)


def explode_kmers(reads: DataFrame, k: int, *keep: str) -> DataFrame:
    """A row for each canonical k-mer of each read; reads hold A, C, G and T only."""
    return reads.where(F.length("bases") >= k).select(*keep, F.explode(S.kmers("bases", k)).alias("kmer"))


def explode_positions(reads: DataFrame, k: int, *keep: str) -> DataFrame:
    """As ``explode_kmers`` with the place ``pos``, counted from 0."""
    return reads.where(F.length("bases") >= k).select(*keep, F.posexplode(S.kmers("bases", k)).alias("pos", "kmer"))


def count_kmers(reads: DataFrame, k: int, min_count: int = 1) -> DataFrame:
    return explode_kmers(reads, k).groupBy("kmer").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


#: Letters whose k-mers a task of ``task_counts`` adds up at once.
PIECE = 1 << 21
#: Codes of letters; 4 ends a stretch of bases.
_CODES = np.full(256, 4, np.uint8)
_CODES[list(S.BASES.encode())] = range(4)


def _canonical_codes(codes: np.ndarray, k: int) -> np.ndarray:
    """The canonical codes of all k-mers in ``codes`` that hold bases only; blocks stay in a core's cache."""
    n = len(codes) - k + 1
    out = np.empty(n, np.int64)
    for at in range(0, n, 1 << 14):
        size = min(1 << 14, n - at)
        bases = codes[at : at + size + k - 1].astype(np.int64)
        there, back = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for j in range(k):
            base = bases[j : j + size]
            there = there << 2 | base
            back |= (base ^ 2) << 2 * j
        out[at : at + size] = np.minimum(there, back)
    others = np.concatenate([[0], np.cumsum(codes == 4)])
    return out[others[k:] == others[:n]]


def task_counts(reads: DataFrame, k: int) -> DataFrame:
    """``kmer, n``: canonical k-mers of ``bases``, added up in each task for ``PIECE`` letters at a time, for k up to 31.

    A k-mer may have several rows, whose sum is that of ``count_kmers``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = _CODES[np.frombuffer("N".join(batch["bases"].to_pylist()).encode(), np.uint8)]
            for at in range(0, len(codes) - k + 1, PIECE):
                kmers, n = np.unique(_canonical_codes(codes[at : at + PIECE + k - 1], k), return_counts=True)
                for i in range(0, len(kmers), 1 << 18):
                    yield pa.RecordBatch.from_arrays([pa.array(kmers[i : i + (1 << 18)]), pa.array(n[i : i + (1 << 18)])], names=["kmer", "n"])

    return reads.where(F.length("bases") >= k).select("bases").mapInArrow(run, "kmer long, n long")


def count_stranded(reads: DataFrame, k: int, min_count: int = 1, most: int = (1 << 29) - 1) -> DataFrame:
    """``kmer, n, plus``: saturating count and the number of sightings in the canonical direction."""
    seen = reads.where(F.length("bases") >= k).select(F.explode(S.stranded_kmers("bases", k)).alias("x")).select("x.*")
    return seen.groupBy("kmer").agg(F.least(F.count("*"), F.lit(most)).alias("n"), F.count_if("plus").alias("plus")).where(F.col("n") >= min_count)


def window_size(length: Column, suggested: int, least: int = 0, min_kmers: int = 0) -> Column:
    """Window length for a sequence: smaller for short sequences, if they must give ``min_kmers``."""
    if min_kmers <= 0:
        return F.lit(suggested)
    return F.when(F.floor(length / suggested) < min_kmers, F.greatest(F.lit(least), F.floor(length / min_kmers).cast("int"))).otherwise(F.lit(suggested))


def window_policy(virus: Column, eukaryote: Column, divider: int = 1, least: int = 1) -> Column:
    size = F.when(virus, 64).when(eukaryote, 8000).otherwise(2000)
    return F.greatest(F.floor(size / divider), F.lit(least)).cast("int")


def minimizers(seqs: DataFrame, k: int, window: int, *keep: str, hashed=None) -> DataFrame:
    """``keep, win, kmer, pos``: from each whole window the k-mer with the smallest hash, the first if several.

    Windows start every ``window`` bases and reach back k - 1 bases; what is left at the end of a sequence, and sequences
    shorter than a window, give nothing.  ``hashed`` maps the k-mer column to what is compared, FNV-1 by default.
    """
    h = hashed or S.fnv1_rank
    seqs = seqs.withColumn("_id", F.monotonically_increasing_id()).withColumn("_n", F.length("bases"))
    at = explode_positions(seqs.where(F.col("_n") >= window), k, *keep, "_id", "_n")
    first = F.floor(F.col("pos") / window)
    # a k-mer that begins p bases in belongs to the window of its last base
    last = F.floor((F.col("pos") + k - 1) / window)
    wins = at.withColumn("win", F.explode(F.array_distinct(F.array(first, last)) if window < k else F.array(last))).where((F.col("win") + 1) * window <= F.col("_n"))
    return wins.groupBy(*keep, "_id", "win").agg(F.min(F.struct(h(F.col("kmer")).alias("h"), "pos", "kmer")).alias("m")).select(*keep, "win", "m.kmer", "m.pos")


def sampled_lookups(reads: DataFrame, k: int, most: int, *keep: str, hashed=None) -> DataFrame:
    """At most ``most`` k-mers of a read: from each of as many windows the one with the smallest hash."""
    h = hashed or S.fnv1_rank
    reads = reads.withColumn("_id", F.monotonically_increasing_id()).withColumn("_w", F.greatest(F.ceil((F.length("bases") - k + 1) / most), F.lit(1)))
    at = explode_positions(reads, k, *keep, "_id", "_w").withColumn("win", F.floor(F.col("pos") / F.col("_w")))
    return at.groupBy(*keep, "_id", "win").agg(F.min(F.struct(h(F.col("kmer")).alias("h"), "pos", "kmer")).alias("m")).select(*keep, "win", "m.kmer", "m.pos")


def build_index(tagged: DataFrame, lineage: DataFrame) -> DataFrame:
    """``kmer, tax_id``: k-mers with the common ancestor of the taxa that hold them."""
    return consensus(tagged.select("kmer", "tax_id").distinct(), ["kmer"], lineage)


def build_multi(tagged: DataFrame) -> DataFrame:
    """``kmer, tax_ids``: k-mers with all taxa that hold them."""
    return tagged.groupBy("kmer").agg(F.array_sort(F.collect_set("tax_id")).alias("tax_ids"))


def identify(db: DataFrame, tagged: DataFrame, lineage: DataFrame) -> DataFrame:
    """Taxa of the k-mers of ``db`` alone, from all k-mers of all sequences."""
    return build_index(tagged.join(db.select("kmer").distinct(), "kmer", "left_semi"), lineage)


def merge_dbs(*dbs: DataFrame) -> DataFrame:
    out = dbs[0].select("kmer")
    for x in dbs[1:]:
        out = out.union(x.select("kmer"))
    return out.distinct()


def merge_kingdoms(high: DataFrame, low: DataFrame, lineage: DataFrame, min_level: int) -> DataFrame:
    """Two indexes as one; where both have a k-mer, the first counts alone if its taxon lies deep enough, else the common ancestor."""
    both = high.withColumnRenamed("tax_id", "a").join(low.withColumnRenamed("tax_id", "b"), "kmer", "full")
    deep = lineage.select(F.col("tax_id").alias("a"), F.size("lineage").alias("depth"))
    both = both.join(deep, "a", "left")
    clear = both.where("a IS NULL OR b IS NULL OR depth > %d" % min_level).select("kmer", F.coalesce("a", "b").alias("tax_id"))
    mixed = both.where("a IS NOT NULL AND b IS NOT NULL AND coalesce(depth, 0) <= %d" % min_level).select("kmer", F.explode(F.array("a", "b")).alias("tax_id"))
    return clear.union(consensus(mixed, ["kmer"], lineage))


def multi_hits(reads_kmers: DataFrame, db: DataFrame, *keys: str, small: bool = False) -> DataFrame:
    """``keys, tax_id, n`` by an index ``kmer, tax_ids``: a k-mer counts for each of its taxa.

    K-mers with the same taxa are counted under the smallest of them, and only these counts are multiplied by taxa.
    ``small``: the number of k-mers of ``db`` is bounded, so that pairs of numbers may be broadcast.
    """
    sets = db.groupBy("tax_ids").agg(F.min("kmer").alias("_set"))
    named = db.join(sets, "tax_ids").select("kmer", "_set")
    counts = reads_kmers.join(F.broadcast(named) if small else named, "kmer").groupBy(*keys, "_set").agg(F.count("*").alias("n"))
    return counts.join(sets, "_set").select(*keys, F.explode("tax_ids").alias("tax_id"), "n").groupBy(*keys, "tax_id").agg(F.sum("n").alias("n"))


def hits(reads_kmers: DataFrame, db: DataFrame, *keys: str) -> DataFrame:
    """``keys, tax_id, n``: how many of a read's k-mers each taxon has; taxon 0 does not count."""
    return reads_kmers.join(db.where("tax_id <> 0"), "kmer").groupBy(*keys, "tax_id").agg(F.count("*").alias("n"))


def unique_hits(reads_kmers: DataFrame, db: DataFrame, *keys: str) -> DataFrame:
    return reads_kmers.join(db.where("tax_id <> 0"), "kmer").groupBy(*keys, "tax_id").agg(F.count_distinct("kmer").alias("n"))


def collate(hit_rows: DataFrame) -> DataFrame:
    """``spotid, hits``: rows of one spot merged, counts added, taxa in order."""
    return hit_rows.groupBy("spotid", "tax_id").agg(F.sum("n").alias("n")).groupBy("spotid").agg(F.array_sort(F.collect_list(F.struct("tax_id", "n"))).alias("hits"))


def write_hit_vectors(collated: DataFrame, path: str) -> None:
    """Store ``spotid, hits`` as three tables below ``path``: ``names`` (row, spotid), ``taxa`` (row, place, tax_id) and ``counts`` (row, place, n).

    Rows are numbered by spot, so a column can be read alone, and equal neighbours compress.
    """
    rows = cut(numbered(collated, "spotid"))
    each = rows.select("row", F.posexplode("hits").alias("place", "h"))
    for name, table in (("names", rows.select("row", "spotid")), ("taxa", each.select("row", "place", "h.tax_id")), ("counts", each.select("row", "place", "h.n"))):
        table.write.parquet(f"{path}/{name}")


def read_hit_vectors(spark: SparkSession, path: str) -> DataFrame:
    """``spotid, hits`` from the tables of ``write_hit_vectors``."""
    names, taxa, counts = (spark.read.parquet(f"{path}/{name}") for name in ("names", "taxa", "counts"))
    hits = taxa.join(counts, ["row", "place"]).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("tax_id", "n"))).alias("hits"))
    return names.join(hits, "row").select("spotid", "hits")


def tax_sets(hit_rows: DataFrame) -> DataFrame:
    return hit_rows.groupBy("spotid").agg(F.array_sort(F.collect_set("tax_id")).alias("taxa"))


def compact(hit_rows: DataFrame) -> DataFrame:
    """``taxa, n``: how many spots have each set of taxa."""
    return tax_sets(hit_rows).groupBy("taxa").agg(F.count("*").alias("n"))


def format_hits(collated: DataFrame, hide_counts: bool = False) -> DataFrame:
    """Lines ``spot TAB tax[xN] TAB ...``; a count of 1 is not written."""
    token = lambda h: F.when(F.lit(hide_counts) | (h["n"] == 1), h["tax_id"].cast("string")).otherwise(F.concat(h["tax_id"], F.lit("x"), h["n"]))
    return collated.select(F.concat_ws("\t", S.clean_spot(F.col("spotid").cast("string")), F.array_join(F.transform("hits", token), "\t")).alias("line"))


def format_compact(grouped: DataFrame) -> DataFrame:
    """Lines ``N TAB tax TAB ...``."""
    return grouped.select(F.concat_ws("\t", F.col("n").cast("string"), F.array_join(F.col("taxa").cast("array<string>"), "\t")).alias("line"))


def parse_hits(lines: DataFrame) -> DataFrame:
    """``spotid, tax_id, n`` of hit lines."""
    parts = F.split("line", "\t")
    tax, n = S.parse_count("token")
    rows = lines.where("line <> ''").select(parts[0].alias("spotid"), F.explode(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))).alias("token"))
    return rows.select("spotid", tax.alias("tax_id"), n.alias("n"))


def filter_db(db: DataFrame, k: int, only_tax: int | None = None, drop_taxa: tuple[int, ...] = (131567,)) -> DataFrame:
    """Leave out given taxa, other taxa than ``only_tax``, and k-mers of low complexity.

    Complexity is looked at behind the taxon.  A condition on the k-mer alone would be moved to where an index that is being built has a row for each sighting of a k-mer.
    """
    taxon = ~F.col("tax_id").isin(list(drop_taxa))
    taxon = taxon if only_tax is None else taxon & (F.col("tax_id") == only_tax)
    return db.where(F.when(taxon, ~S.low_complexity(S.decode("kmer", k), k)).otherwise(False))


def contamination(reads: DataFrame, db: DataFrame, k: int, *keys: str) -> DataFrame:
    """``keys, pos, kmer, tax_id``: where the k-mers of ``db`` lie in sequences."""
    return explode_positions(reads, k, *keys).join(db, "kmer").select(*keys, "pos", "kmer", "tax_id")


def begins(counted: DataFrame) -> DataFrame:
    """Order in which contigs are begun, from 1: by falling count, then falling code."""
    rows = counted.withColumn("_n", -F.col("n")).withColumn("_kmer", F.bitwise_not("kmer"))
    return numbered(rows, "_n", "_kmer").withColumn("place", F.col("row") + 1).drop("_n", "_kmer", "row")


def annotation(db: DataFrame) -> DataFrame:
    return db.groupBy("tax_id").agg(F.count("*").alias("n"))


def dump_text(db: DataFrame, k: int) -> DataFrame:
    """Lines ``kmer TAB tax``; those of the root are not written."""
    return db.where(F.col("tax_id") != ROOT).select(F.concat_ws("\t", S.decode("kmer", k), F.col("tax_id").cast("string")).alias("line"))


def connectivity(contigs: DataFrame, reads: DataFrame, k: int, slack: int = 2) -> DataFrame:
    """``contig, spotid, first, last``: reads whose first k-mer and last k-mer lie in one contig as far apart as in the read."""
    c = explode_positions(contigs, k, "contig")
    ends = reads.where(F.length("bases") > k).select("spotid", (F.length("bases") - k).alias("apart"), S.kmers(F.substring("bases", 1, k), k)[0].alias("kmer"), S.kmers(F.expr(f"right(bases, {k})"), k)[0].alias("last_kmer"))
    one = ends.join(c.withColumnRenamed("pos", "first"), "kmer").select("spotid", "apart", "contig", "first", F.col("last_kmer").alias("kmer"))
    both = one.join(c.withColumnRenamed("pos", "last"), ["contig", "kmer"])
    return both.where(F.abs(F.abs(F.col("last") - F.col("first")) - F.col("apart")) <= slack).select("contig", "spotid", "first", "last").distinct()


def longest_connections(connected: DataFrame, k: int, near: int = 1000) -> DataFrame:
    """``contig, pos, len``: the longest connection that begins at a place, of single reads and of mates.

    ``connected``: rows of ``connectivity`` with ``spot, mate``.  A read connects from its left k-mer to the end of its right one; the first place of several
    counts for mates.  Two mates of a spot in one contig, less than ``near`` apart, connect from the left one's begin to the right one's end.
    """
    reads = connected.select("contig", "spot", "mate", F.least("first", "last").alias("pos"), (F.abs(F.col("last") - F.col("first")) + k).alias("len"))
    one = reads.groupBy("contig", "spot", "mate").agg(F.min(F.struct("pos", "len")).alias("m"))
    ends = one.groupBy("contig", "spot").agg(F.min("m").alias("a"), F.max("m").alias("b"), F.count("*").alias("n")).where(F.col("n") == 2)
    mates = ends.where(F.col("b.pos") - F.col("a.pos") < near).select("contig", F.col("a.pos").alias("pos"), (F.col("b.pos") - F.col("a.pos") + F.col("b.len")).alias("len"))
    return reads.select("contig", "pos", "len").unionByName(mates).groupBy("contig", "pos").agg(F.max("len").alias("len"))


def coverage_reach(rows: DataFrame) -> DataFrame:
    """``contig, pos, reach``: how far beyond each place the links that begin at or before it reach."""
    w = Window.partitionBy("contig").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    own = rows.groupBy("contig", "pos").agg(F.max("len").alias("len"))
    return own.select("contig", "pos", F.greatest(F.max(F.col("pos") + F.col("len")).over(w) - F.col("pos"), F.lit(0)).alias("reach"))


def effective_window(reads: DataFrame, db: DataFrame, k: int, sizes: list[int], enough: float) -> DataFrame:
    """``size, windows, identified, effective``: of all whole windows of each size, those with a k-mer of ``db`` inside.

    The effective size is the smallest at which the part of identified windows reaches ``enough``.  Reads are cut into k-mers
    once; a hit counts for its window of every size.  A read stays in one task if ``db`` is broadcast.
    """
    hits_at = explode_positions(gathered(reads.select("spotid", "bases"), "spotid").withColumn("_n", F.length("bases")), k, "spotid", "_n").join(db.select("kmer"), "kmer", "left_semi")
    size = F.explode(F.array(*map(F.lit, sizes))).alias("size")
    inside = hits_at.select("spotid", "_n", "pos", size).where(F.col("pos") % F.col("size") <= F.col("size") - k).withColumn("win", F.floor(F.col("pos") / F.col("size")))
    found = inside.where((F.col("win") + 1) * F.col("size") <= F.col("_n")).select("spotid", "size", "win").distinct().groupBy("size").agg(F.count("*").alias("identified"))
    every = reads.select(F.length("bases").alias("_n"), size).groupBy("size").agg(F.sum(F.floor(F.col("_n") / F.col("size"))).alias("windows"))
    table = every.join(found, "size", "left").select("size", "windows", F.coalesce("identified", F.lit(0)).alias("identified"))
    reached = F.when((F.col("identified") >= enough * F.col("windows")) & (F.col("windows") > 0), F.col("size"))
    return table.withColumn("effective", F.coalesce(F.col("size") == F.min(reached).over(Window.partitionBy()), F.lit(False)))  # a row a size


def classify_in_two_steps(reads_kmers: DataFrame, sparse: DataFrame, dense: Callable[[DataFrame], DataFrame], *keys: str) -> DataFrame:
    """``keys, tax_id, n`` by the part of a large index that the reads need: a small index tells which taxa there are.

    ``dense`` takes these taxa and gives their k-mers; an index stored by taxon is then read only there.
    """
    taxa = reads_kmers.join(sparse.where("tax_id <> 0"), "kmer", "inner").select("tax_id").distinct()
    return hits(reads_kmers, dense(taxa), *keys)


def check_index(db: DataFrame, tagged: DataFrame, lineage: DataFrame) -> DataFrame:
    """``tax, kmers, wrong, own``: of the k-mers of each taxon's sequences that an index holds, those whose entry is no ancestor
    of the taxon nor itself, and those whose entry is the taxon itself."""
    seen = tagged.select("kmer", F.col("tax_id").alias("tax")).distinct().join(db, "kmer")
    counted = seen.groupBy("tax", "tax_id").agg(F.count("*").alias("n"))  # pairs of taxa, before lineages come in
    judged = counted.join(lineage.select(F.col("tax_id").alias("tax"), "lineage"), "tax")
    at_odds = ~F.array_contains("lineage", F.col("tax_id"))
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return judged.groupBy("tax").agg(F.sum("n").alias("kmers"), total(at_odds).alias("wrong"), total(F.col("tax_id") == F.col("tax")).alias("own"))
