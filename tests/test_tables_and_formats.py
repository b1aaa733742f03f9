import pytest
from pyspark.sql import functions as F

from seqloom.operators import agp as AG
from seqloom.operators import assembly as AS
from seqloom.operators import taxonomy as TX
from seqloom.plans import tables as TB
from seqloom.sources import formats as SF


def test_declarations():
    t = TB.TableSpec.parse("t = RUN1.ALIG {mapq, id} #@chr1:5.10 #7.3 %20")
    assert (t.name, t.source, t.kind, t.fields, t.chunk) == ("t", "RUN1", "ALIG", ["id", "mapq"], 20)
    assert t.ranges == [TB.Range("chr1", 5, 10), TB.Range(None, 7, 3)]
    assert TB.TableSpec.parse("s = RUN1").kind == "SPOT"
    with pytest.raises(ValueError):
        TB.TableSpec.parse("t = R.ALIG {nope}")


def test_options():
    o = TB.JobOptions.parse("# c\nOUT=o\nSQL=SELECT a=1\nt = R.REF\n")
    assert o.values == {"OUT": "o", "SQL": "SELECT a=1"} and o.tables[0].kind == "REF" and o.missing() == ["TEMP"]


def test_fasta_and_fastq(spark, tmp_path):
    (tmp_path / "a.fasta").write_bytes(b">s1/1 first\r\nACGT\r\nTT\r\n>s2 x\r\nGG\r\n")
    assert [(r.spotid, r.bases) for r in SF.read_fasta(spark, str(tmp_path / "a.fasta")).collect()] == [("s1", "ACGTTT"), ("s2", "GG")]
    (tmp_path / "a.fastq").write_text("@r1 x\nACG\n+\n@II\n@r2\nT\n+\nI\n")
    assert [tuple(r) for r in SF.read_fastq(spark, str(tmp_path / "a.fastq")).collect()] == [("r1", "ACG", "@II"), ("r2", "T", "I")]


def test_taxa(spark):
    t = spark.createDataFrame([(1, 1), (2, 1), (5, 2), (7, 2), (9, 7)], "tax_id int, parent_id int")
    hits = spark.createDataFrame([("a", 5), ("a", 9), ("a", 2), ("b", 2), ("b", 5), ("c", 1), ("c", 5), ("d", -3), ("d", 5)], "k string, tax_id int")
    lin = TX.lineages(t)
    assert dict(map(tuple, TX.consensus(hits, ["k"], lin).collect())) == {"a": 2, "b": 2, "c": 1, "d": -3}
    assert dict(map(tuple, TX.deepest_unambiguous(hits.where("k in ('a', 'b')"), ["k"], lin).collect())) == {"a": 2, "b": 5}


def test_lineages_of_more_than_a_million_taxa(spark):
    n = 1_000_100
    leaves = spark.range(10, n).select(F.col("id").cast("int").alias("tax_id"), (F.col("id") % 3 + 2).cast("int").alias("parent_id"))
    top = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 1)], "tax_id int, parent_id int")
    got = TX.lineages(top.union(leaves)).agg(F.count("*").alias("n"), F.count_distinct("tax_id").alias("taxa"), F.sum(F.element_at("lineage", -1).cast("long")).alias("ids"), F.sum(F.size("lineage")).alias("steps")).first()
    assert tuple(got) == (n - 6, n - 6, sum(range(10, n)) + 10, 3 * (n - 10) + 7)


def test_lineages_bound_depth_and_leave_out_what_the_root_does_not_reach(spark):
    rows = [(1, 1), (2, 1), (3, 2), (4, 3), (8, 9), (9, 8), (6, 5)]  # a circle beside the tree, and a child of no one
    tree = spark.createDataFrame(rows, "tax_id int, parent_id int")
    assert {r.tax_id: r.lineage for r in TX.lineages(tree, 4).collect()} == {1: [1], 2: [1, 2], 3: [1, 2, 3], 4: [1, 2, 3, 4]}
    with pytest.raises(ValueError):
        TX.lineages(tree, 3)
    with pytest.raises(ValueError):
        TX.lineages(tree.union(spark.createDataFrame([(2, 4)], tree.schema)), 10)
    assert [tuple(r) for r in TX.lineages(tree.limit(0)).collect()] == [(1, [1])]


def test_agp_flatten_and_remap(spark):
    cols = "object string, beg long, end long, component string, cbeg long, cend long, strand int"
    agp = spark.createDataFrame([("chr", 1, 10, "s1", 1, 10, 1), ("chr", 11, 20, "s2", 1, 10, -1), ("s1", 1, 10, "c1", 5, 14, 1), ("s2", 1, 4, "c2", 1, 4, 1), ("s2", 5, 10, "c3", 1, 6, -1)], cols)
    flat = sorted(map(tuple, AG.flatten(agp).collect()))
    assert flat == [("chr", 1, 10, "c1", 5, 14, 1), ("chr", 11, 16, "c3", 1, 6, 1), ("chr", 17, 20, "c2", 1, 4, -1)]
    old, new = spark.createDataFrame([("o", 1, 10, "c", 1, 10, 1)], cols), spark.createDataFrame([("n", 101, 110, "c", 1, 10, -1)], cols)
    assert [tuple(r) for r in AG.remap(old, new).collect()] == [("n", 101, 10, "o", 1, True)]


def test_histogram_shape(spark):
    rows = spark.createDataFrame([(1, 100), (2, 10), (3, 20), (4, 50), (5, 20)], "n long, kmers long")
    got = AS.histogram_shape(rows).first()
    assert (got.valley, got.peak, got.genome) == (2, 4, 95) and abs(got.average - 3.8) < 1e-12
    assert tuple(AS.histogram_shape(rows.limit(0)).first()) == (0, 0, 0.0, 0)


def test_fasta_with_marks_inside_descriptions(spark, tmp_path):
    from seqloom.sources.formats import read_fasta

    (tmp_path / "a.fa").write_bytes(b">one a>b c\r\nACG\r\nT\r\n>two/1 x\nGG\n")
    got = {(r.spotid, r.description, r.bases) for r in read_fasta(spark, str(tmp_path / "a.fa")).collect()}
    assert got == {("one", "one a>b c", "ACGT"), ("two", "two/1 x", "GG")}


def test_allele_lines_and_lists(spark):
    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "line string")
    assert [tuple(r) for r in SF.parse_alleles(lines("abc 1 acgt", "")).collect()] == [("abc", "1", "ACGT")]
    with pytest.raises(Exception, match="no allele line"):
        SF.parse_alleles(lines("abc 1")).collect()
    assert sorted(r.word for r in SF.parse_words(lines(" a\tb ", "", None, "c")).collect()) == ["a", "b", "c"]
    assert [tuple(r) for r in SF.parse_file_list(lines("12\t/a b/c", " ")).collect()] == [("/a b/c", 12)]
    hit = SF.parse_tabular_hits(lines("# x", "q\ts\t99.5\t10\t0\t0\t1\t10\t30\t21\t1e-9\t20\t10")).first()
    assert (hit.sstart, hit["send"], hit.plus) == (21, 30, False)


def test_placed_and_turned_contigs(spark):
    bases = "ACGGTTACAGGCATTC"
    turned = bases[::-1].translate(str.maketrans("ACGT", "TGCA"))
    contigs = spark.createDataFrame([(7, bases)], "contig int, bases string")
    reads = spark.createDataFrame([(1, bases[3:12]), (2, turned[2:14]), (3, "AAAAAAAA"), (4, None), (5, "AC")], "spotid int, bases string")
    placed = AS.place_reads(reads, contigs, 6)
    assert sorted(tuple(r) for r in placed.collect()) == [(1, 7, 0, 3, True), (2, 7, 0, len(bases) - 2 - 6, False)]
    profile = {r.pos: (r.symbols, r.abundances) for r in AS.coverage_profile(reads, contigs, placed, 6).collect()}
    assert profile == {p: (bases[p], str((3 <= p < 12) + (2 <= p < 14))) for p in range(2, 14)}
    both = AS.direct(spark.createDataFrame([(1, bases), (2, turned), (3, "AC")], "spotid int, bases string"), 6, "spotid")
    got = {r.spotid: (r.bases, r.turned) for r in both.collect()}
    assert got[1][0] == got[2][0] and got[1][1] != got[2][1] and got[3] == ("AC", False)


def test_split_locations(spark):
    rows = spark.createDataFrame([("o", 11, 20, "c", 1, 10, 1), ("o", 31, 40, "d", 1, 10, -1)], "object string, beg long, end long, component string, cbeg long, cend long, strand int")
    got = sorted(tuple(r) for r in AG.split_locations(rows, F.lit(4)).collect())
    assert got == [("o", 11, 13, "c", 1, 3, 1), ("o", 14, 20, "c", 4, 10, 1), ("o", 31, 37, "d", 4, 10, -1), ("o", 38, 40, "d", 1, 3, -1)]
    assert AG.split_locations(rows, F.lit(1)).count() == 2


def test_stored_index_and_two_steps(spark, tmp_path):
    from seqloom.operators import kmerdb as KD

    db = spark.createDataFrame([(1, 5), (2, 5), (3, 6), (4, 0)], "kmer long, tax_id int")
    SF.write_kmer_db(db, str(tmp_path / "db"), by_tax=True)
    assert sorted(r.kmer for r in SF.read_kmer_db(spark, str(tmp_path / "db"), [6, 9]).collect()) == [3]
    seen = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 4), (3, 3)], "spotid int, kmer long")
    got = KD.classify_in_two_steps(seen, db.where("kmer = 1"), lambda t: SF.read_kmer_db(spark, str(tmp_path / "db"), t), "spotid")
    assert [tuple(r) for r in got.collect()] == [(1, 5, 2)]


def test_tree_lines_are_a_document(spark):
    import xml.etree.ElementTree as ET

    from seqloom.operators import taxonomy as TX

    rows = [(1, 1, "", "root", 0, 9), (5, 1, "genus", 'A & "B" <c>', 2, 6), (7, 5, "", None, 4, 4), (6, 1, "genus", "x", 3, 3)]
    rolled = spark.createDataFrame(rows, "tax_id int, parent_id int, rank string, name string, self_count long, total_count long")
    lineage = spark.createDataFrame([(1, [1]), (5, [1, 5]), (7, [1, 5, 7]), (6, [1, 6])], "tax_id int, lineage array<int>")
    lines = [r.line for r in TX.tree_lines(rolled, lineage).orderBy("path").collect()]
    root = ET.fromstring("\n".join(lines))
    assert [c.get("tax_id") for c in root] == ["5", "6"] and root[0].get("name") == 'A & "B" <c>' and root[0][0].get("name") == "unknown" and "rank" not in root[0][0].attrib
    assert [x.get("total_count") for x in root.iter()] == ["9", "6", "4", "3"]


def _alignments(spark):
    rows = [("a", "chr1", 254, 4, 7), ("b", "chr1", 256, 1, 8), ("c", "chr1", 300, 0, 9), ("d", None, 5, 1, 1), ("e", "chr1", 256, 600, 3)]
    return spark.createDataFrame(rows, "id string, refspec string, refpos long, length long, mapq int")


def test_pileup_over_bins(spark):
    """Without bases of an empty alignment, with those of one without a reference."""
    rows = {(r.id, r.refspec, r.refpos): (r.mapq, r.depth) for r in TB.pileup(_alignments(spark)).collect()}
    assert len(rows) == 4 + 1 + 1 + 600
    assert [rows["a", "chr1", p] for p in range(254, 258)] == [(7, 1), (7, 1), (7, 3), (7, 2)]
    assert rows["b", "chr1", 256] == (8, 3) and rows["d", None, 5] == (1, 1) and rows["e", "chr1", 855] == (3, 1)


def test_depth_from_ends(spark):
    """An empty alignment covers nothing."""
    rows = {(r.refspec, r.refpos): r.depth for r in TB.depth(_alignments(spark)).collect()}
    assert len(rows) == 603 and (("chr1", 299) in rows) and rows["chr1", 300] == 1 and rows["chr1", 256] == 3 and rows[None, 5] == 1


def test_depth_is_added_up_before_one_shuffle(spark, monkeypatch):
    """Against plain Python: several rounds of a task, places below 0, ends on the edges of bins and stretches; steps travel once."""
    import random
    from collections import Counter

    rng = random.Random(7)
    places = [-70000, -256, -1, 0, 255, 256, TB.STRETCH - 3, TB.STRETCH, 3 * TB.STRETCH - 256, 10**12]
    rows = [(rng.choice(["a", "b", None]), rng.choice(places) + rng.randrange(-2, 3), rng.choice([0, 1, 2, 3, 255, 256, 257, 300])) for _ in range(300)]
    rows += [("c", 100, 3 * TB.STRETCH), ("c", TB.STRETCH, TB.STRETCH), ("c", None, 4), ("c", 4, None), ("d", 0, TB.STRETCH)]
    want = Counter((r, p) for r, first, n in rows if first is not None for p in range(first, first + (n or 0)))
    monkeypatch.setattr(TB, "TOGETHER", 40)
    frame = spark.createDataFrame(rows, "refspec string, refpos long, length long").coalesce(1)
    depth = TB.depth(frame)
    assert {(r.refspec, r.refpos): r.depth for r in depth.collect()} == want
    assert depth._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("hashpartitioning") == 1
    assert TB.depth(frame.where("length < 0")).collect() == []
    covered = {(r.refspec, r.refpos, r.depth) for r in TB.pileup(frame.selectExpr("'i' AS id", "1 AS mapq", "*")).collect()}
    assert covered == {(*at, n) for at, n in want.items()}
