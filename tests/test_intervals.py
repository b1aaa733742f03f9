import pytest
from pyspark.sql import functions as F

from seqloom.operators import features as FT
from seqloom.operators import intervals as IV
from seqloom.sources import formats as SF

# alignment, gene (A marks an ambiguous segment), results of UNION, STRICT, NONEMPTY
COMPARISONS = """50,25|100,100|NNN
300,100|100,100|NNN
50,100|100,100|FNF
50,200|100,100|FNF
120,20|100,100|FFF
150,100|100,100|FNF
50,100|A100,100|ANA
50,200|A100,100|ANA
150,20|A100,100|AAA
150,100|A100,100|ANA
50,100|100,50;A150,50|FNF
50,120|100,50;A150,50|ANF
120,50|100,50;A150,50|AFF
100,100|90,20;190,20|FNF
100,20;150,20|90,30;150,50|FFF
100,50|A100,100|AAA
180,20|A100,100|AAA
180,21|A100,100|ANA
100,50|A100,50|AAA"""
# another feature's intervals, a feature's, and the feature with ambiguous parts marked
AMBIGUITIES = """50,25|100,100|100,100
300,100|100,100|100,100
50,200|100,100|A100,100
50,100|100,100|A100,50;150,50
150,100|100,100|100,50;A150,50
125,50|100,100|100,25;A125,50;175,25
150,200|100,100;300,100|100,50;A150,50;A300,50;350,50
50,75;175,50|100,100|A100,25;125,50;A175,25
50,75;150,10;190,60|100,100;220,70;300,50|A100,25;125,25;A150,10;160,30;A190,10;A220,30;250,40;300,50"""


def segments(text):
    out = []
    for part in text.split(";"):
        start, n = map(int, part.lstrip("A").split(","))
        out.append((start, start + n - 1, part.startswith("A")))
    return out


def test_comparisons(spark):
    rows = [(i, [s[:2] for s in segments(a)], segments(g), r) for i, (a, g, r) in enumerate(x.split("|") for x in COMPARISONS.splitlines())]
    df = spark.createDataFrame(rows, "i int, a array<struct<start:long,end:long>>, g array<struct<start:long,end:long,amb:boolean>>, want string")
    got = df.select("want", *(F.substring(IV.compare_segments(F.col("a"), F.col("g"), m), 1, 1).alias(m) for m in ("UNION", "STRICT", "NONEMPTY"))).collect()
    assert [r.UNION + r.STRICT + r.NONEMPTY for r in got] == [r.want for r in got] and len(got) == 19


def test_ambiguities(spark):
    rows, want = [], {}
    for i, line in enumerate(AMBIGUITIES.splitlines()):
        other, own, marked = line.split("|")
        rows += [(f"c{i}", "other", s, e) for s, e, _ in segments(other)] + [(f"c{i}", "own", s, e) for s, e, _ in segments(own)]
        want[f"c{i}"] = segments(marked)
    df = spark.createDataFrame(rows, "ref string, id string, start long, end long")
    got = {}
    for r in IV.mark_ambiguous(df).where("id = 'own'").orderBy("ref", "start").collect():
        got.setdefault(r.ref, []).append((r.start, r.end, r.amb))
    assert got == want


@pytest.mark.parametrize("given,want", [("100,20;200,20", "100,20;200,20"), ("100,100;150,100", "100,150"), ("100,100;50,200", "50,200"), ("100,100;150,20", "100,100"), ("100,10;110,5", "100,15")])
def test_merges(spark, given, want):
    df = spark.createDataFrame([("k", s, e) for s, e, _ in segments(given)], "k string, start long, end long")
    assert sorted((r.start, r.end) for r in IV.merge_intervals(df, ["k"]).collect()) == [s[:2] for s in segments(want)]


def test_cigar(spark):
    df = spark.createDataFrame([("5M2I3M1D4M2N3M",), ("M",), ("3S",), (None,)], "c string")
    got = [[tuple(s) for s in r[0]] for r in df.select(IV.cigar_segments(F.col("c"), F.lit(10))).collect()]
    assert got == [[(10, 17), (19, 22), (25, 27)], [(10, 10)], [], []]


def test_features_keep_the_last_one(spark):
    gtf = ["#c", "chr1\ts\texon\t10\t20\t.\t+\t.\tgene_id \"a\";", "chr2\ts\texon\t5\t9\t.\t-\t.\tx \"1\"; gene_id \"b\";", "chr2\ts\tCDS\t5\t9\t.\t-\t.\tgene_id \"c\";"]
    f = FT.build_features(SF.parse_gtf(spark.createDataFrame([(x,) for x in gtf], "line string")))
    assert {r.id for r in f.collect()} == {"a", "b"}
    again = SF.parse_features(SF.format_features(f))
    assert sorted(map(str, again.select("id", "ref", "reverse", "segs", "start", "end").collect())) == sorted(map(str, f.select("id", "ref", "reverse", "segs", "start", "end").collect()))


def test_range_join_does_not_depend_on_bins(spark):
    left = spark.createDataFrame([("r", i * 7, i * 7 + 12) for i in range(40)], "ref string, start long, end long")
    right = spark.createDataFrame([("r", i * 11, i * 11 + 3) for i in range(30)], "ref string, r_start long, r_end long")
    sizes = [sorted(map(tuple, IV.range_join(left, right, ["ref"], b).collect())) for b in (1, 10, 1000)]
    assert sizes[0] == sizes[1] == sizes[2]
    assert len(sizes[0]) == sum(a * 7 <= b * 11 + 3 and a * 7 + 12 >= b * 11 for a in range(40) for b in range(30))


def test_range_join_of_short_and_long_intervals(spark):
    import random

    rng = random.Random(1)
    make = lambda n: [(rng.choice("ab"), s, s + rng.choice([0, 1, 3, 40, 300, 5_000, 90_000])) for s in (rng.randrange(100_000) for _ in range(n))]
    one, two = make(120), make(150)
    one.append(("a", None, 5))
    left = spark.createDataFrame(one, "ref string, start long, end long")
    right = spark.createDataFrame(two, "ref string, r_start long, r_end long")
    want = sorted((r, s, e, s2, e2) for r, s, e in one if s is not None for r2, s2, e2 in two if r == r2 and s <= e2 and e >= s2)
    assert sorted(map(tuple, IV.range_join(left, right, ["ref"]).select("ref", "start", "end", "r_start", "r_end").collect())) == want
    assert IV.range_join(left.where("false"), right, ["ref"]).count() == 0
    assert IV.range_join(left, right, ["ref"], how="left").where("r_start IS NULL").count() == len({x for x in one} - {w[:3] for w in want})


def test_equal_cigars_are_parsed_once_and_strands_meet_alone(spark, monkeypatch):
    lines = [("f1", "c", 10, 50, "+"), ("f2", "c", 30, 80, "-")]
    gtf = spark.createDataFrame(lines, "id string, chrom string, start long, end long, strand string")
    features = FT.build_features(gtf)
    rows = [("a", 10, "8M", False), ("b", 11, "8M", False), ("c", 60, "8M", True), ("d", 60, "8M", False), ("e", 90, "8M", True), ("f", 12, "2S3M", False), ("g", 12, None, False), ("h", None, "8M", False), ("i", 12, "", False), ("j", 12, "8M", None)]
    a = spark.createDataFrame([(i, "c", p, 9, s, x) for i, p, x, s in rows], "id string, refspec string, refpos long, mapq int, reversed boolean, cigar string")
    parsed, keys, cut, join = [], [], FT.cut, FT.range_join

    def kept(df):
        out = cut(df)
        if "cigar" in out.columns:
            parsed.extend(sorted(r["cigar"] for r in out.collect()))
        return out

    monkeypatch.setattr(FT, "cut", kept)
    monkeypatch.setattr(FT, "range_join", lambda left, right, on: keys.append(on) or join(left, right, on))
    got = {r["id"]: r["disposition"] for r in FT.dispositions(a, features, "STRICT").collect()}
    assert got == {"a": "f1", "b": "f1", "c": "f2", "d": "NOFT", "e": "NOFT", "f": "f1", "g": "NOFT", "h": "NOFT", "i": "NOFT", "j": "NOFT"}
    assert parsed == ["", "2S3M", "8M"] and keys == [["ref", "reversed"]]
    loose = {r["id"]: r["disposition"] for r in FT.dispositions(a, features, "UNION", ignore_strand=True).collect()}
    assert loose["d"] == "f2" and loose["j"] == "f1"
