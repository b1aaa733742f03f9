from pyspark.sql import functions as F

from seqloom.functions import seq as S
from seqloom.operators import kmerdb as KD


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


def test_codes(spark):
    assert one(spark, S.encode("s"), s="TCTCCGAGCCCACGAGAC") == 41191556913
    assert [one(spark, S.encode("s"), s=s) for s in ("ACTG", "TGAC", "CAGT")] == [27, 177, 78]
    assert one(spark, S.encode32("s"), s="AAACTCTCGAGCACCTGCCGCTCGGGGAGGCC") == 115348763461549301
    assert one(spark, S.encode32(S.revcomp("s")), s="AAACTCTCGAGCACCTGCCGCTCGGGGAGGCC") == 17696177292584799466 - 2**64
    assert one(spark, S.decode("c", 4), c=27) == "ACTG"


def test_transforms(spark):
    assert [one(spark, S.canonical("c", 4), c=c) for c in (27, 177, 78)] == [27, 177, 27]
    assert one(spark, S.bit_reverse("c", 3), c=44) == 14
    assert one(spark, S.rev_complement_code("c", 2), c=1) == 14


def test_runs(spark):
    rows = {"ATGC": (["ATGC"], "ATGC"), "ATNGC": (["AT", "GC"], "AT"), "NATGCN": (["ATGC"], ""), "NANTNGNCN": (["A", "T", "G", "C"], ""), "NNNN": ([], "")}
    for text, (runs, head) in rows.items():
        assert one(spark, S.acgt_runs("s"), s=text) == runs
        assert one(spark, S.acgt_cut("s"), s=text) == head
    assert one(spark, S.longest_run("s"), s="ACNGTTNCAGN") == "GTT"


def test_kmers_match_plain_python(spark):
    text, k = "ACGTTGCAACGGTTTACG", 5
    comp = str.maketrans("ACGT", "TGCA")
    code = lambda s: int("".join("ACTG".index(c).__str__() for c in s), 4)
    expect = [min(code(text[i : i + k]), code(text[i : i + k][::-1].translate(comp))) for i in range(len(text) - k + 1)]
    assert one(spark, S.kmers("s", k), s=text) == expect
    assert one(spark, S.kmers("s", k), s="ACG") == []


def test_fnv(spark):
    h = 14695981039346656037
    for b in (123456789).to_bytes(8, "little"):
        h = (h * 1099511628211 % 2**64) ^ b
    assert int(one(spark, S.fnv1("c"), c=123456789)) == h


def test_low_complexity(spark):
    assert one(spark, S.predicted("s"), s="AAAAAAAA") == 4
    assert one(spark, S.predicted("s"), s="ACACACACACAC") == 4
    assert one(spark, S.predicted("s"), s="ACGTTGCAACGG") == 0


def test_filter_db_looks_at_complexity_behind_the_taxon(spark):
    kmers = {"AAAAAAAAAAA": 5, "ACGTTGCAACG": 5, "ACGTTGCAACC": 7, "ACGTTGCAACT": 131567, "ACGTTGCAATT": None}
    db = spark.createDataFrame(list(kmers.items()), "bases string, tax_id int").select(S.encode("bases").alias("kmer"), "tax_id")
    names = lambda rows: {r.bases for r in rows.select(S.decode("kmer", 11).alias("bases")).collect()}
    assert names(KD.filter_db(db, 11)) == {"ACGTTGCAACG", "ACGTTGCAACC"}
    assert names(KD.filter_db(db, 11, 5)) == {"ACGTTGCAACG"}
    built = db.groupBy("kmer").agg(F.max("tax_id").alias("tax_id"))
    plan = KD.filter_db(built, 11, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "octet_length" in plan[: plan.index("Aggregate")] and "octet_length" not in plan[plan.index("Aggregate") :]


def test_minimizer_windows(spark):
    reads = spark.createDataFrame([(1, "ACGTTGCAAC"), (2, "ACG")], "spotid int, bases string")
    rows = KD.minimizers(reads, 3, 4, "spotid").collect()
    assert sorted((r.spotid, r.win) for r in rows) == [(1, 0), (1, 1)]
    assert all(r.pos <= 1 if r.win == 0 else 2 <= r.pos <= 5 for r in rows)


def test_hit_lines_round_trip(spark):
    hits = spark.createDataFrame([(1, 5, 2), (1, 7, 1), (2, 5, 1)], "spotid int, tax_id int, n long")
    lines = KD.format_hits(KD.collate(hits))
    assert sorted(r.line for r in lines.collect()) == ["1\t5x2\t7", "2\t5"]
    assert sorted(tuple(r) for r in KD.parse_hits(lines).collect()) == [("1", 5, 2), ("1", 7, 1), ("2", 5, 1)]


def test_quality_mask(spark):
    assert one(spark, S.quality_mask("b", "q"), b="ACGT", q="I#$!") == "ANGN"


def test_quality_mask_of_an_empty_text(spark):
    assert one(spark, S.quality_mask("b", "q"), b="", q="") == ""
    assert one(spark, S.quality_mask("b", "q"), b="AC", q="#I!!") == "NC"


def test_nearest_in_blocks(spark, monkeypatch):
    """Blocks of a few profiles give what all pairs give, with nulls, two sizes and pairs that agree nowhere."""
    import random

    from seqloom.operators import profiles as PR

    monkeypatch.setattr(PR, "BLOCK", 7)
    monkeypatch.setattr(PR, "STEP", 2)
    draw = random.Random(3)
    rows = [(i, [draw.choice([True, False, None]) for _ in range(6 if i % 5 else 4)]) for i in range(60)] + [(60, None)]
    e = spark.createDataFrame(rows, "id long, profile array<boolean>")
    got = sorted(tuple(r) for r in PR.nearest(e.where("id % 3 = 0"), e, "id", 4, least=0).collect())
    want = []
    for i, a in rows[:60:3]:
        near = sorted((-sum(x == y and x is not None for x, y in zip(a, b)) / len(a), j) for j, b in rows[:60] if j != i and len(b) == len(a))[:4]
        want += [(i, j, -s) for s, j in near]
    assert got == sorted(want)


def _exchanges(df):
    """Shuffles that a plan asks for."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_kmers_of_gathered_reads_are_not_shuffled(spark):
    reads = spark.createDataFrame([(1, "ACGTACGTAC"), (2, "TTTTTT"), (1, "ACGTA"), (3, None)], "spotid int, bases string")
    counted = KD.explode_kmers(KD.gathered(reads, "spotid"), 4, "spotid").groupBy("spotid", "kmer").agg(F.count("*").alias("n"))
    plain = KD.explode_kmers(reads, 4, "spotid").groupBy("spotid", "kmer").agg(F.count("*").alias("n"))
    assert _exchanges(counted) == 1
    assert sorted(counted.collect()) == sorted(plain.collect())


def test_effective_window_shuffles_reads_only(spark):
    reads = spark.createDataFrame([(1, "ACGTACGTACGTACGT"), (2, "TTTTTTTTGGGGGGGG")], "spotid int, bases string")
    db = F.broadcast(spark.createDataFrame([("ACGT",)], "s string").select(S.canonical(S.encode("s"), 4).alias("kmer")))
    rows = KD.effective_window(reads, db, 4, [8, 16], 0.5)
    assert sorted(tuple(r) for r in rows.collect()) == [(8, 4, 2, True), (16, 2, 1, False)]
    assert "spotid#" in rows._jdf.queryExecution().executedPlan().toString() and "hashpartitioning(spotid" in rows._jdf.queryExecution().executedPlan().toString()
    assert "win" not in "".join(x for x in rows._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x)


def test_hits_of_kmers_with_several_taxa(spark):
    db = spark.createDataFrame([(1, [5, 7]), (2, [5, 7]), (3, [7]), (4, [9])], "kmer long, tax_ids array<int>")
    own = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("a", 3), ("b", 4), ("b", 8)], "spotid string, kmer long")
    for small in (False, True):
        assert sorted(tuple(r) for r in KD.multi_hits(own, db, "spotid", small=small).collect()) == [("a", 5, 3), ("a", 7, 4), ("b", 9, 1)]
