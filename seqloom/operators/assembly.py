"""K-mer graphs, contigs and allele matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions import seq as S
from seqloom.operators.store import cut

# The bacterial start codons and the stop codons.
STARTS = ["ATG", "GTG", "TTG", "CTG", "ATT", "ATC", "ATA"]
STOPS = ["TAA", "TAG", "TGA"]


def canonical_text(text: Column) -> Column:
    return F.translate(F.least(S.digits(text), S.digits(S.revcomp(text))), "0123", S.BASES)


def successors(nodes: DataFrame) -> DataFrame:
    """``kmer, side, base, next, n``: the neighbours of each k-mer text that are nodes themselves, on its right and its left.

    Eight candidates a node meet the nodes by equality; a node is not its own neighbour.
    """
    b = F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.lit(x).alias("base")) for s in ("R", "L") for x in "ACGT")))
    tries = nodes.select("kmer", b.alias("e")).select("kmer", "e.*")
    right = F.concat(F.expr("substr(kmer, 2)"), F.col("base"))
    left = F.concat(F.col("base"), F.expr("left(kmer, length(kmer) - 1)"))
    tries = tries.withColumn("next", canonical_text(F.when(F.col("side") == "R", right).otherwise(left)))
    return tries.join(nodes.select(F.col("kmer").alias("next"), "n"), "next").where("next <> kmer").select("kmer", "side", "base", "next", "n")


def filter_forks(edges: DataFrame, fraction: float) -> DataFrame:
    """Leave out neighbours that have at most ``fraction`` of their side's abundance."""
    w = Window.partitionBy("kmer", "side")
    return edges.withColumn("_all", F.sum("n").over(w)).where(F.col("n") > fraction * F.col("_all")).drop("_all")


def histogram(counts: DataFrame) -> DataFrame:
    return counts.groupBy("n").agg(F.count("*").alias("kmers"))


def histogram_shape(hist: DataFrame) -> DataFrame:
    """``valley, peak, average, genome`` of a histogram ``n, kmers``, in one row; zeros for an empty one.

    The valley is the first count that fewer k-mers have than the next count; without one, the smallest count.  The peak is
    the count from there on that most k-mers have, the smaller of two.  The window runs over distinct counts, of which n
    k-mer places give at most the root of 2n.
    """
    rising = hist.withColumn("_up", F.lead("kmers").over(Window.orderBy("n")) > F.col("kmers"))
    valley = rising.agg(F.coalesce(F.min(F.when(F.col("_up"), F.col("n"))), F.min("n")).alias("valley"))
    beyond = hist.crossJoin(F.broadcast(valley)).where("n >= valley")  # one row
    shape = beyond.agg(F.min("valley").alias("valley"), F.max_by("n", F.struct("kmers", -F.col("n"))).alias("peak"), F.sum("kmers").alias("k"), F.sum(F.col("n") * F.col("kmers")).alias("all"))
    whole = lambda x: F.coalesce(x, F.lit(0)).cast("long")
    return shape.select(whole(F.col("valley")).alias("valley"), whole(F.col("peak")).alias("peak"), F.coalesce(F.col("all") / F.col("k"), F.lit(0.0)).alias("average"), whole(F.round(F.col("all") / F.col("peak"))).alias("genome"))


def length_statistic(contigs: DataFrame, length: str = "len", part: float = 0.5) -> DataFrame:
    """``nxx, lxx``: the length at which contigs, longest first, reach a part of all bases, and how many that takes.

    Lengths are counted first, so the running sum goes over distinct lengths and not over contigs.
    """
    by = contigs.groupBy(F.col(length).alias("len")).agg(F.count("*").alias("n"), F.sum(length).alias("bases"))
    w = Window.orderBy(F.desc("len"))
    run = by.withColumn("before", F.coalesce(F.sum("bases").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("count", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    half = by.agg((F.sum("bases") * part).alias("half"))
    hit = run.crossJoin(F.broadcast(half)).where("before < half AND before + bases >= half")  # one row: the total
    return hit.select(F.col("len").cast("long").alias("nxx"), (F.col("count") + F.ceil((F.col("half") - F.col("before")) / F.col("len"))).cast("long").alias("lxx"))


def diagonal_runs(hits: DataFrame, k: int) -> DataFrame:
    """``query, subject, diagonal, qstart, qend``: k-mer hits ``query, subject, qpos, spos`` that overlap or touch on a diagonal, merged."""
    rows = hits.select("query", "subject", (F.col("qpos") - F.col("spos")).alias("diagonal"), "qpos").distinct()
    w = Window.partitionBy("query", "subject", "diagonal").orderBy("qpos")
    runs = rows.withColumn("_new", F.when(F.col("qpos") - F.lag("qpos").over(w) <= k, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("query", "subject", "diagonal", "_run").agg(F.min("qpos").alias("qstart"), (F.max("qpos") + k - 1).alias("qend")).drop("_run")


def clean_alleles(alleles: DataFrame, least: int = 42) -> DataFrame:
    return alleles.where((F.length("seq") >= least) & ~F.col("seq").rlike("[^ACGT]"))


def codons(seq: Column) -> tuple[Column, Column]:
    """Whether a sequence begins with a start codon and ends with a stop codon."""
    return F.substring(seq, 1, 3).isin(STARTS), F.right(seq, F.lit(3)).isin(STOPS)


def resolve_overlaps(placed: DataFrame, most: int = 115) -> DataFrame:
    """Loci ``locus, contig, start, end`` that no longer one overlaps by more than ``most`` bases; equal places keep the first locus."""
    from seqloom.operators.intervals import range_join

    p = placed.groupBy("contig", "start", "end").agg(F.min("locus").alias("locus"))
    other = p.select("contig", F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.col("locus").alias("r_locus"))
    pairs = range_join(p, other, ["contig"]).where("locus <> r_locus")
    shared = F.least("end", "r_end") - F.greatest("start", "r_start") + 1
    own, others = F.col("end") - F.col("start"), F.col("r_end") - F.col("r_start")
    loses = (own < others) | ((own == others) & (F.col("locus") > F.col("r_locus")))
    return p.join(pairs.where((shared > most) & loses).select("contig", "start", "end", "locus").distinct(), ["contig", "start", "end", "locus"], "left_anti")


def place_reads(reads: DataFrame, contigs: DataFrame, k: int) -> DataFrame:
    """``spotid, contig, read_pos, contig_pos, plus``: where the first k-mer of a read that some contig holds lies in it.

    Of several places the first of the smallest contig counts; ``plus`` tells whether read and contig run the same way.  A k-mer
    meets one contig, the smallest that holds it, and the place is looked up in that contig alone, so places never multiply.
    """
    own = reads.select("spotid", F.posexplode(S.stranded_kmers("bases", k)).alias("read_pos", "x")).select("spotid", F.col("read_pos").cast("long").alias("read_pos"), "x.kmer", F.col("x.plus").alias("way"))
    held = contigs.where(F.length("bases") >= k).select("contig", F.explode(S.kmers("bases", k)).alias("kmer")).groupBy("kmer").agg(F.min("contig").alias("contig"))
    first = own.join(held, "kmer").groupBy("spotid").agg(F.min(F.struct("read_pos", "contig", "kmer", "way")).alias("m")).select("spotid", "m.*")
    there = first.select("contig", "kmer").distinct().join(contigs.select("contig", "bases"), "contig")
    ahead, back = (F.nullif(F.instr(F.col("bases"), f(S.decode("kmer", k))), F.lit(0)) for f in (lambda x: x, S.revcomp))
    places = there.select("contig", "kmer", ahead.alias("_a"), back.alias("_b")).select("contig", "kmer", (F.least("_a", "_b") - 1).cast("long").alias("contig_pos"), F.coalesce(F.col("_a") <= F.col("_b"), F.col("_b").isNull()).alias("other")).where("contig_pos IS NOT NULL")
    met = first.join(places, ["contig", "kmer"])
    return met.groupBy("spotid", "contig", "read_pos").agg(F.min(F.struct("contig_pos", (F.col("way") == F.col("other")).alias("plus"))).alias("m")).select("spotid", "contig", "read_pos", "m.contig_pos", "m.plus")


def direct(contigs: DataFrame, k: int, key: str) -> DataFrame:
    """Contigs turned so that their smallest canonical k-mer, the first of equal ones, runs forward; shorter ones stay."""
    smallest = F.array_min(F.transform(S.stranded_kmers("bases", k), lambda x, i: F.struct(x["kmer"].alias("kmer"), i.alias("at"), x["plus"].alias("plus"))))["plus"]
    turned = contigs.withColumn("_plus", F.coalesce(smallest, F.lit(True)))
    return turned.withColumn("bases", F.when(F.col("_plus"), F.col("bases")).otherwise(S.revcomp("bases"))).withColumn("turned", ~F.col("_plus")).drop("_plus")


def next_letters(edges: DataFrame, least: int) -> DataFrame:
    """``kmer, side, base, next, n``: the neighbour by which a contig is extended: the most frequent, the first base of equal ones,
    if it was seen ``least`` times."""
    best = edges.where(F.col("n") >= least).groupBy("kmer", "side").agg(F.min(F.struct((-F.col("n")).alias("less"), "base", "next")).alias("m"))
    return best.select("kmer", "side", "m.base", "m.next", (-F.col("m.less")).alias("n"))


def coverage_profile(reads: DataFrame, contigs: DataFrame, placed: DataFrame, k: int) -> DataFrame:
    """``contig, pos, symbols, abundances``: the bases that placed reads have at each place of a contig, in order, and how often.

    A read lies without gaps where its first common k-mer puts it, turned if it runs the other way; what hangs over is left out.
    Bases are counted before they are gathered, so a place takes four rows at most.
    """
    n = F.length("bases")
    turned = placed.join(reads.select("spotid", "bases"), "spotid").select(
        "contig", F.when(F.col("plus"), F.col("contig_pos") - F.col("read_pos")).otherwise(F.col("contig_pos") - (n - k - F.col("read_pos"))).alias("off"),
        F.when(F.col("plus"), F.col("bases")).otherwise(S.revcomp("bases")).alias("bases"))
    each = turned.select("contig", "off", F.posexplode(F.split("bases", "")).alias("i", "symbol")).select("contig", (F.col("off") + F.col("i")).alias("pos"), "symbol")
    counted = each.where("pos >= 0 AND symbol <> ''").groupBy("contig", "pos", "symbol").agg(F.count("*").alias("n"))
    inside = counted.join(contigs.select("contig", F.length("bases").alias("_len")), "contig").where("pos < _len")
    rows = inside.groupBy("contig", "pos").agg(F.array_sort(F.collect_list(F.struct("symbol", "n"))).alias("s"))
    return rows.select("contig", "pos", F.array_join(F.transform("s", lambda x: x["symbol"]), "").alias("symbols"), F.array_join(F.transform("s", lambda x: x["n"].cast("string")), ",").alias("abundances"))


def word_seeds(targets: DataFrame, nodes: DataFrame, k: int, word: int = 8) -> DataFrame:
    """``kmer, node, score``: for each target k-mer the graph node with the same last ``word`` bases that agrees in most places.

    Equal scores go to the more frequent node, then to the smaller code.  A word has at most 4**(k - word) nodes.
    """
    low = F.lit((1 << 2 * word) - 1)
    met = targets.select("kmer", F.col("kmer").bitwiseAND(low).alias("w")).join(nodes.select(F.col("kmer").alias("node"), "n", F.col("kmer").bitwiseAND(low).alias("w")), "w")
    apart = F.col("kmer").bitwiseXOR(F.col("node"))
    places = F.bit_count(apart.bitwiseOR(F.shiftright(apart, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    best = met.groupBy("kmer").agg(F.min(F.struct(places.alias("miss"), (-F.col("n")).alias("less"), "node")).alias("m"))
    return best.select("kmer", "m.node", (F.lit(k) - F.col("m.miss")).cast("int").alias("score"))
