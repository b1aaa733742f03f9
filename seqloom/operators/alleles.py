"""Allele calling: seeds, diagonals, chains of diagonals, alignment in a chain's corridor, tests of the reading frame, conflicts.

A locus is sought by one of its alleles on both strands: the turned query meets the contigs as they are, so all places are
those of the contig.  Only the chaining of an island and the alignment of one pair are Python; a contig is
never sent along with a candidate, but the stretch of it that the candidate needs, cut from overlapping chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from seqloom.functions import seq as S
from seqloom.operators.alignment import align_many
from seqloom.operators.assembly import STARTS, STOPS, diagonal_runs
from seqloom.operators.intervals import range_join
from seqloom.operators.store import cut


def both_strands(queries: DataFrame) -> DataFrame:
    """``locus, plus, seq, qlen`` of queries ``locus, seq``, as they are and turned."""
    ways = F.array(F.struct(F.lit(True).alias("plus"), F.col("seq")), F.struct(F.lit(False).alias("plus"), S.revcomp("seq").alias("seq")))
    return queries.select("locus", F.inline(ways)).withColumn("qlen", F.length("seq"))


def stretches(rows: DataFrame, contigs: DataFrame, longest: int) -> DataFrame:
    """``rows`` with ``text``: the bases from ``left`` to ``right`` (from 0, inclusive) of ``contig``; no stretch is longer than ``longest``.

    Contigs are cut into chunks that overlap by ``longest``, so a stretch lies in the chunk where it begins.
    """
    step = max(longest, 1024)
    starts = F.sequence(F.lit(0), F.greatest(F.length("bases") - 1, F.lit(0)), F.lit(step))
    chunks = contigs.select("contig", F.explode(starts).alias("_at"), "bases").select("contig", F.expr(f"_at DIV {step}").alias("_chunk"), F.substring("bases", F.col("_at") + 1, F.lit(step + longest)).alias("_bases"))
    met = rows.withColumn("_chunk", F.expr(f"left DIV {step}")).join(chunks, ["contig", "_chunk"])
    return met.withColumn("text", F.substring("_bases", (F.col("left") - F.col("_chunk") * step + 1).cast("int"), (F.col("right") - F.col("left") + 1).cast("int"))).drop("_chunk", "_bases")


def equal_places(a: Column, b: Column) -> Column:
    """In how many places two texts of ASCII letters agree."""
    both = F.struct(a.cast("binary").alias("a"), b.cast("binary").alias("b"))
    one = lambda x, i: F.substring(x, i + 1, F.lit(1))
    n = F.least(F.length(a), F.length(b))
    return S.let(both, lambda x: F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), F.lit(0), lambda acc, i: acc + F.when((i < n) & (one(x["a"], i) == one(x["b"], i)), 1).otherwise(0)))


def diagonals(queries: DataFrame, contigs: DataFrame, k: int = 15, least: int = 15, identity: float = 0.5) -> DataFrame:
    """``locus, plus, contig, qfrom, qto, sfrom, sto, score, qlen, clen``: one candidate a diagonal, from its first common k-mer to its last.

    A candidate has ``least`` bases in common k-mers and equal bases in more than ``identity`` of its places, which are its score.
    ``queries``: ``locus, plus, seq, qlen``; ``contigs``: ``contig, bases``.
    """
    q = queries.where(f"qlen >= {k}").select(F.struct("locus", "plus").alias("query"), F.posexplode(S.kmers("seq", k, False)).alias("qpos", "kmer"))
    s = contigs.where(F.length("bases") >= k).select(F.col("contig").alias("subject"), F.posexplode(S.kmers("bases", k, False)).alias("spos", "kmer"))
    runs = diagonal_runs(q.join(s, "kmer"), k)
    by = runs.groupBy("query", "subject", "diagonal").agg(F.min("qstart").alias("qfrom"), F.max("qend").alias("qto"), F.sum(F.col("qend") - F.col("qstart") + 1).alias("exact")).where(F.col("exact") >= least)
    rows = by.select("query.locus", "query.plus", F.col("subject").alias("contig"), "qfrom", "qto", (F.col("qfrom") - F.col("diagonal")).alias("sfrom"), (F.col("qto") - F.col("diagonal")).alias("sto"))
    longest = queries.agg(F.max("qlen")).first()[0] or 1
    lengths = contigs.select("contig", F.length("bases").alias("clen"))
    there = stretches(rows.withColumns({"left": F.col("sfrom"), "right": F.col("sto")}), contigs, longest).join(queries, ["locus", "plus"])
    own = F.substring("seq", (F.col("qfrom") + 1).cast("int"), (F.col("qto") - F.col("qfrom") + 1).cast("int"))
    scored = there.withColumn("score", equal_places(own, F.col("text"))).where(F.col("score") > identity * (F.col("qto") - F.col("qfrom") + 1))
    return scored.join(lengths, "contig").select("locus", "plus", "contig", "qfrom", "qto", "sfrom", "sto", "score", "qlen", "clen")


def best_chains(rows: list[tuple], apart: int, least: float) -> list[tuple]:
    """Chains of candidates ``qfrom, qto, sfrom, sto, score``, of which no two lie on one diagonal: ``qfrom, qto, sfrom, sto, score, low, high``.

    A candidate goes on from one that begins and ends before it on the contig and whose diagonal is at most ``apart`` away; what both
    cover counts once.  A candidate has one place for each near diagonal to look at, so work is linear.  Chains of
    ``least`` are taken from the right end; a candidate in a chain begins none of its own.
    """
    rows = sorted(rows, key=lambda r: (r[2], r[0]))
    best, left, at = [r[4] for r in rows], [-1] * len(rows), {}
    for i, (qf, _, sf, st, score) in enumerate(rows):
        diagonal = sf - qf
        near = sorted((at[d] for d in range(diagonal - apart, diagonal + apart + 1) if d in at), reverse=True)
        for j in near:
            if rows[j][2] < sf and rows[j][3] < st:
                new = best[j] + score - max(0, rows[j][3] - sf + 1)
                if new > best[i]:
                    best[i], left[i] = new, j
        at[diagonal] = i
    out, inside = [], set()
    for i in reversed(range(len(rows))):
        if i in inside or best[i] < least:
            continue
        j, low = i, high = i, rows[i][2] - rows[i][0]
        while left[j] >= 0:
            j = left[j]
            inside.add(j)
            low, high = min(low, rows[j][2] - rows[j][0]), max(high, rows[j][2] - rows[j][0])
        out.append((rows[j][0], rows[i][1], rows[j][2], rows[i][3], best[i], low, high))
    return out


_KEYS = ["locus", "plus", "contig", "qlen", "clen"]


def chains(found: DataFrame, apart: int = 15, fraction: float = 0.1) -> DataFrame:
    """``locus, plus, contig, qlen, clen, qfrom, qto, sfrom, sto, score, low, high``: chains of candidates that cover ``fraction`` of the query.

    Candidates further apart than a query and the way between diagonals cannot be in one chain, so a contig falls into islands,
    and islands are chained one after another, many to a task.  ``low`` and ``high`` bound the chain's diagonals (place in the contig less place in the query).
    """
    w = Window.partitionBy("locus", "plus", "contig").orderBy("sfrom", "qfrom")
    reach = F.max("sto").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("sfrom") - reach > F.col("qlen") + apart, 1).otherwise(0)
    rows = found.withColumn("_new", fresh).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    names = ["qfrom", "qto", "sfrom", "sto", "score", "low", "high"]
    wide = [*_KEYS, "_island", *names[:5]]

    def islands(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        """The rows of one island after another; they lie together, but not always in one batch."""
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in wide), strict=True):
                if held and row[:6] != held[-1][:6]:
                    yield held
                    held = []
                held.append(row)
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], [*_KEYS, *names])
        for own in islands(batches):
            out += [(*own[0][:5], *x) for x in best_chains([r[6:] for r in own], apart, fraction * own[0][3])]
            if len(out) >= 10_000:
                yield pack()
                out = []
        if out:
            yield pack()

    kinds = dict(found.dtypes)
    types = [*to_arrow_schema(found.select(*_KEYS).schema).types, *[pa.int64()] * len(names)]
    # the window has brought the rows of a contig into one task
    sorted_rows = rows.select(*wide).sortWithinPartitions("locus", "plus", "contig", "sfrom", "qfrom")
    return sorted_rows.mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in _KEYS), *(f"{c} long" for c in names)]))


def _aligned(rows: DataFrame, match: int, mismatch: int, opening: int, extension: int, margin: int) -> DataFrame:
    """Local alignments of ``query`` to ``text`` in the band around diagonals ``low`` to ``high``."""
    kinds = "qf int, qt int, sf int, st int, same int"

    @F.pandas_udf(kinds)
    def run(q: pd.Series, s: pd.Series, low: pd.Series, high: pd.Series) -> pd.DataFrame:
        bands = [(int(hi - lo + 1) // 2 + margin + len(x) // 10, int(lo + hi) // 2) for x, lo, hi in zip(q, low, high, strict=True)]
        found = align_many(list(zip(q, s, strict=True)), "local", match, mismatch, opening, extension, bands)
        out = [(x["query_start"], x["query_end"], x["subject_start"], x["subject_end"], x["matches"]) for x in found]
        return pd.DataFrame(out, columns=[k.split()[0] for k in kinds.split(", ")]).astype("Int32")

    # not deterministic, so that no condition on its result is worked out twice, before and after a shuffle
    return rows.withColumn("_a", run.asNondeterministic()("query", "text", "low", "high")).select("*", "_a.*").drop("_a")


def call_alleles(
    alleles: DataFrame, contigs: DataFrame, k: int = 15, least: int = 15, fraction: float = 0.1, apart: int = 15, match: int = 1, mismatch: int = -1, opening: int = 8, extension: int = 2,
    flank: int = 42, high: float = 0.75, high_partial: float = 0.1, margin: int = 20,
) -> DataFrame:
    """Where loci lie on contigs: ``locus, allele, contig, from, to, plus, seq, matches, identity, qlen, not_aligned_5, not_aligned_3, has_start, has_stop, consistent``.

    ``alleles``: ``locus, allele, seq``; the smallest allele of a locus that has ``flank`` bases is its query, and the allele that is equal to what
    was found names it (null: none).  ``contigs``: ``contig, bases``.  An alignment counts if it covers more than ``high`` of the query, or, where
    the contig's end cuts the query off, ``high_partial`` of it and most of what the contig can hold.  What is not aligned is
    added without gaps as far as the contig goes.  Places count from 1, ends inclusive.  ``consistent``: whole codons with no
    stop before the last.  Null sequences are left out.
    """
    alleles, contigs = alleles.where("seq IS NOT NULL AND locus IS NOT NULL"), contigs.where("bases IS NOT NULL AND contig IS NOT NULL")
    first = alleles.groupBy("locus").agg(F.min(F.struct("allele", "seq")).alias("m")).select("locus", "m.seq").where(F.length("seq") >= flank)
    queries = cut(both_strands(first))
    longest = queries.agg(F.max("qlen")).first()[0] or 1
    found = chains(diagonals(queries, contigs, k, least), apart, fraction)
    half = F.expr("qlen DIV 2")
    placed = found.withColumns({"left": F.greatest(F.col("sfrom") - F.col("qfrom") - half, F.lit(0)), "right": F.least(F.col("sto") + F.col("qlen") - F.col("qto") - 1 + half, F.col("clen").cast("long") - 1)})
    rows = stretches(placed, contigs, 4 * longest + apart).join(queries.select("locus", "plus", "seq"), ["locus", "plus"])
    # everything in the direction of the query from here on
    n, plus = F.col("right") - F.col("left") + 1, F.col("plus")
    over = lambda d: n - F.col("qlen") + F.col("left") - F.col(d)
    rows = rows.select(
        *_KEYS, "left", "right", n.alias("n"), F.when(plus, F.col("seq")).otherwise(S.revcomp("seq")).alias("query"), F.when(plus, F.col("text")).otherwise(S.revcomp("text")).alias("text"),
        F.when(plus, F.col("low") - F.col("left")).otherwise(over("high")).alias("low"), F.when(plus, F.col("high") - F.col("left")).otherwise(over("low")).alias("high"),
        F.when(plus, F.col("left") == 0).otherwise(F.col("right") == F.col("clen") - 1).alias("at_left"), F.when(plus, F.col("right") == F.col("clen") - 1).otherwise(F.col("left") == 0).alias("at_right"))
    a = _aligned(rows.repartition("locus", "contig", "left"), match, mismatch, opening, extension, margin).where("qt > qf")
    size, behind = F.col("qt") - F.col("qf"), F.col("n") - F.col("st")
    left_cut = F.col("at_left") & (F.col("qf") > F.col("sf")) & (F.col("sf") < (1 - high) * size)
    right_cut = F.col("at_right") & (F.col("qlen") - F.col("qt") + 1 > behind) & (behind < (1 - high) * size)
    partial = (left_cut & right_cut) | (left_cut & (size > high * (F.col("qlen") - F.col("qf")))) | (right_cut & (size > high * (F.col("qt") - 1)))
    a = a.where((size > high * F.col("qlen")) | (partial & (size > high_partial * F.col("qlen"))))
    a = a.withColumns({"_a": F.col("sf") - F.col("qf"), "_b": F.col("st") - 1 + F.col("qlen") - F.col("qt")})
    a = a.where((F.col("at_left") | (F.col("_a") >= 0)) & (F.col("at_right") | (F.col("_b") < F.col("n"))))
    a = a.withColumns({"lost5": F.greatest(-F.col("_a"), F.lit(0)), "lost3": F.greatest(F.col("_b") - F.col("n") + 1, F.lit(0)), "_a": F.greatest("_a", F.lit(0)), "_b": F.least(F.col("_b"), F.col("n") - 1)})
    part = lambda text, at, count: F.substring(text, at.cast("int") + 1, F.greatest(count, F.lit(0)).cast("int"))
    more5, more3 = F.col("qf") - F.col("lost5"), F.col("qlen") - F.col("qt") - F.col("lost3")
    extra = F.when(more5 > 0, equal_places(part("query", F.col("lost5"), more5), part("text", F.col("_a"), more5))).otherwise(0) + F.when(more3 > 0, equal_places(part("query", F.col("qt"), more3), part("text", F.col("st"), more3))).otherwise(0)
    text = part("text", F.col("_a"), F.col("_b") - F.col("_a") + 1)
    start = F.when(plus, F.col("left") + F.col("_a")).otherwise(F.col("right") - F.col("_b"))
    called = a.select("locus", "contig", "plus", "qlen", (start + 1).alias("from"), (start + F.col("_b") - F.col("_a") + 1).alias("to"), text.alias("seq"), (F.col("same") + extra).alias("matches"), F.col("lost5").alias("not_aligned_5"), F.col("lost3").alias("not_aligned_3"))
    once = called.groupBy("locus", "contig", "plus", "from", "to").agg(F.max(F.struct("matches", "seq", "qlen", "not_aligned_5", "not_aligned_3")).alias("m")).select("locus", "contig", "plus", "from", "to", "m.*")
    inner = F.exists(F.sequence(F.lit(0), F.greatest(F.length("seq") - 6, F.lit(0)), F.lit(3)), lambda i: (i <= F.length("seq") - 6) & F.substring("seq", i + 1, F.lit(3)).isin(STOPS))
    tested = once.withColumns({
        "has_start": (F.col("not_aligned_5") == 0) & F.substring("seq", 1, 3).isin(STARTS), "has_stop": (F.col("not_aligned_3") == 0) & F.right("seq", F.lit(3)).isin(STOPS),
        "consistent": (F.length("seq") % 3 == 0) & ~inner, "identity": 100.0 * F.col("matches") / F.greatest("qlen", F.length("seq")),
    })
    names = alleles.groupBy("locus", "seq").agg(F.min("allele").alias("allele"))
    return tested.join(names, ["locus", "seq"], "left").select("locus", "allele", "contig", "from", "to", "plus", "seq", "matches", "identity", "qlen", "not_aligned_5", "not_aligned_3", "has_start", "has_stop", "consistent")


def format_mappings(called: DataFrame) -> DataFrame:
    """``locus, line``: the eleven tab-separated columns of a mapping."""
    cut_off = (F.col("not_aligned_5") > 0) | (F.col("not_aligned_3") > 0)
    state = F.when(cut_off, "Partial").when(F.col("consistent"), "Consistent").otherwise("Notconsistent")
    end = lambda has, name, lost: F.when(F.col(has), name).otherwise(F.col(lost).cast("string"))
    columns = [F.col("locus").cast("string"), F.coalesce(F.col("allele").cast("string"), F.lit("-")), state, end("has_start", "Start", "not_aligned_5"), end("has_stop", "Stop", "not_aligned_3"), F.col("contig").cast("string"), F.col("from").cast("string"), F.col("to").cast("string"), F.when(F.col("plus"), "+").otherwise("-"), F.col("seq"), F.col("matches").cast("string")]
    return called.select("locus", F.concat_ws("\t", *columns).alias("line"))


def resolve_loci(called: DataFrame, shared: int = 115, contained: float = 0.75, identity: float = 85.0) -> DataFrame:
    """Complete placements without conflicts: ``locus, seq, contig, from, to, identity, length, allele, kept``.

    Complete: consistent, with start and stop, and ``identity`` percent.  Placements cut off by a contig's end go, and so do those that
    overlap the part of the contig up to the inner end of one by ``shared`` bases or ``contained`` of their own; where such parts of both ends meet, all of the
    contig's go.  Of two that share more than ``shared`` bases the shorter goes.  One place of a locus stays once, the most alike.  ``kept``
    is false for what still shares more with another, and for loci in several places.  ``called`` is the table of ``call_alleles``.
    """
    cut_left = F.when(F.col("plus"), F.col("not_aligned_5") > 0).otherwise(F.col("not_aligned_3") > 0)
    cut_right = F.when(F.col("plus"), F.col("not_aligned_3") > 0).otherwise(F.col("not_aligned_5") > 0)
    margins = called.where(cut_left | cut_right).groupBy("contig").agg(F.max(F.when(cut_left, F.col("to"))).alias("_l"), F.min(F.when(cut_right, F.col("from"))).alias("_r"))
    whole = called.where((F.col("not_aligned_5") == 0) & (F.col("not_aligned_3") == 0) & F.col("consistent") & F.col("has_start") & F.col("has_stop") & (F.col("identity") >= identity))
    rows = whole.join(margins, "contig", "left").withColumn("length", F.col("to") - F.col("from") + 1)
    much = F.least(F.lit(float(shared)), contained * F.col("length"))
    bad = (F.col("_l") >= F.col("_r")) | (F.col("_l") - F.col("from") + 1 >= much) | (F.col("to") - F.col("_r") + 1 >= much)
    rows = cut(rows.where(~F.coalesce(bad, F.lit(False))).drop("_l", "_r"))

    def conflicts(of: DataFrame) -> DataFrame:
        """Pairs that share more than ``shared`` bases, both ways."""
        one = of.select("contig", F.col("from").alias("start"), F.col("to").alias("end"), "locus", "plus", "length")
        other = of.select("contig", F.col("from").alias("r_start"), F.col("to").alias("r_end"), F.col("locus").alias("r_locus"), F.col("plus").alias("r_plus"), F.col("length").alias("r_length"))
        share = F.least("end", "r_end") - F.greatest("start", "r_start") + 1
        return range_join(one, other, ["contig"]).where((share > shared) & ~((F.col("start") == F.col("r_start")) & (F.col("end") == F.col("r_end")) & (F.col("locus") == F.col("r_locus")) & (F.col("plus") == F.col("r_plus"))))

    key = ["contig", "from", "to", "locus", "plus"]
    told = lambda pairs: pairs.select("contig", F.col("start").alias("from"), F.col("end").alias("to"), "locus", "plus").distinct()
    rows = cut(rows.join(told(conflicts(rows).where("length < r_length")), key, "left_anti"))
    best = F.max(F.struct("identity", "plus", "seq", "length", "allele")).alias("m")
    rows = cut(rows.groupBy("locus", "contig", "from", "to").agg(best).select("locus", "contig", "from", "to", "m.*"))
    many = rows.groupBy("locus").count().where("count > 1").select("locus", F.lit(True).alias("_many"))
    out = rows.join(told(conflicts(rows)).withColumn("_clash", F.lit(True)), key, "left").join(many, "locus", "left")
    return out.select("locus", "seq", "contig", "from", "to", F.round("identity", 2).alias("identity"), "length", "allele", (F.col("_clash").isNull() & F.col("_many").isNull()).alias("kept"))
