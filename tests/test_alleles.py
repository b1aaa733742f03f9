"""Allele calling against planted placements and plain recurrences."""

import random

import pytest

from seqloom.operators import alleles as A

STOPS = ("TAA", "TAG", "TGA")


def turn(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def bases(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def gene(rng, codons):
    inner = ["".join(c) for c in (bases(rng, 3) for _ in range(3 * codons)) if c not in STOPS]
    return "ATG" + "".join(inner[:codons]) + "TAA"


def plain_chains(rows, apart, least):
    """Every pair is looked at."""
    rows = sorted(rows, key=lambda r: (r[2], r[0]))
    best, left = [r[4] for r in rows], [None] * len(rows)
    for i, a in enumerate(rows):
        for j in reversed(range(i)):
            b = rows[j]
            if b[2] < a[2] and b[3] < a[3] and abs((a[2] - a[0]) - (b[2] - b[0])) <= apart:
                new = best[j] + a[4] - max(0, b[3] - a[2] + 1)
                if new > best[i]:
                    best[i], left[i] = new, j
    out, gone = [], set()
    for i in reversed(range(len(rows))):
        if i not in gone and best[i] >= least:
            walk = [i]
            while left[walk[-1]] is not None:
                walk.append(left[walk[-1]])
            gone |= set(walk[1:])
            d = [rows[x][2] - rows[x][0] for x in walk]
            out.append((rows[walk[-1]][0], rows[i][1], rows[walk[-1]][2], rows[i][3], best[i], min(d), max(d)))
    return out


def test_chains_equal_all_pairs():
    rng = random.Random(2)
    for _ in range(300):
        rows = []
        for d in rng.sample(range(-40, 40), rng.randrange(1, 12)):
            q = rng.randrange(60)
            n = rng.randrange(5, 30)
            rows.append((q, q + n - 1, q + d + 50, q + d + 49 + n, rng.randrange(1, n + 1)))
        assert A.best_chains(rows, 15, 12) == plain_chains(rows, 15, 12)


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(12)
    genes = {f"L{i}": gene(rng, rng.randrange(30, 90)) for i in range(7)}
    change = lambda s, i: s[:i] + {"A": "C", "C": "A", "G": "C", "T": "C"}[s[i]] + s[i + 1 :]
    contig, planted = {"c1": "", "c2": "", "c3": ""}, []

    def put(name, locus, text, plus, allele, matches):
        contig[name] += bases(rng, 211)
        at = len(contig[name]) + 1
        contig[name] += text if plus else turn(text)
        planted.append((locus, allele, name, at, at + len(text) - 1, plus, text, matches))

    put("c1", "L0", genes["L0"], True, "1", len(genes["L0"]))
    put("c1", "L1", genes["L1"], False, "1", len(genes["L1"]))
    other = change(change(genes["L2"], 50), 51)
    put("c2", "L2", other, True, "2", len(other) - 2)
    unknown = change(genes["L3"], 40)
    put("c2", "L3", unknown, False, None, len(unknown) - 1)
    g = genes["L4"]
    more = g[:60] + bases(rng, 6) + g[60:]
    put("c1", "L4", more, True, None, len(g))
    less = genes["L5"][:45] + genes["L5"][48:]
    put("c3", "L5", less, True, None, len(less))
    contig["c3"] += bases(rng, 300)
    contig["c1"] += bases(rng, 90)
    contig["c2"] += bases(rng, 90)
    contig["c4"] = genes["L6"][40:] + bases(rng, 500)  # cut off by the contig's end
    contig["c5"] = bases(rng, 400) + turn(genes["L6"][45:])
    rows = [(k, "1", v) for k, v in genes.items()] + [("L2", "2", other), ("L9", "1", "ACGT"), (None, "1", genes["L0"]), ("L8", "1", None)]
    alleles = spark.createDataFrame(rows, "locus string, allele string, seq string")
    contigs = spark.createDataFrame([*contig.items(), ("none", None), ("empty", "")], "contig string, bases string").repartition(3)
    return genes, planted, contig, alleles, contigs, A.call_alleles(alleles, contigs).collect()


def test_planted_alleles_are_called(world):
    genes, planted, _, _, _, called = world
    got = {(r["locus"], r["allele"], r["contig"], r["from"], r["to"], r["plus"], r["seq"], r["matches"]) for r in called if r["locus"] != "L6"}
    assert got == set(planted)
    for r in called:
        if r["locus"] in ("L0", "L1"):
            assert r["has_start"] and r["has_stop"] and r["consistent"] and r["identity"] == 100.0
        size = max(len(genes[r["locus"]]), len(r["seq"]))
        assert abs(r["identity"] - 100 * r["matches"] / size) < 1e-9


def test_queries_cut_off_by_a_contig(world):
    genes, _, contig, _, _, called = world
    got = {(r["contig"], r["from"], r["to"], r["plus"], r["not_aligned_5"], r["not_aligned_3"], r["matches"], r["has_start"], r["has_stop"]) for r in called if r["locus"] == "L6"}
    n = len(genes["L6"])
    assert got == {("c4", 1, n - 40, True, 40, 0, n - 40, False, True), ("c5", 401, 400 + n - 45, False, 45, 0, n - 45, False, True)}


def test_mappings_and_loci(spark, world):
    genes, planted, contig, alleles, contigs, called = world
    df = spark.createDataFrame(called)
    lines = [r["line"].split("\t") for r in A.format_mappings(df).collect()]
    assert all(len(x) == 11 for x in lines)
    assert [x for x in lines if x[0] == "L1"] == [["L1", "1", "Consistent", "Start", "Stop", "c1", *(str(v) for v in planted[1][3:5]), "-", genes["L1"], str(len(genes["L1"]))]]
    assert {(x[2], x[3], x[4]) for x in lines if x[0] == "L6"} == {("Partial", "40", "Stop"), ("Partial", "45", "Stop")}
    found = {r["locus"]: r for r in A.resolve_loci(df).collect()}
    assert {"L0", "L1", "L2", "L3"} <= set(found) and "L6" not in found and all(r["kept"] for r in found.values())
    assert found["L2"]["allele"] == "2" and found["L3"]["allele"] is None


def test_conflicts_of_loci(spark):
    rows = []

    def put(locus, contig, a, b, identity=100.0, lost=(0, 0), plus=True, allele="1"):
        rows.append((locus, allele, contig, a, b, plus, "ATG", 9, identity, b - a + 1, lost[0], lost[1], True, True, True))

    put("long", "c", 1000, 1600)
    put("short", "c", 1200, 1500)  # inside a longer one
    put("x", "d", 100, 400)
    put("y", "d", 250, 550)  # as long, and they share too much
    put("twice", "e", 1, 300)
    put("twice", "f", 1, 300)
    put("same", "g", 1, 300, 95.0, allele="a")
    put("same", "g", 1, 300, 99.0, allele="b")
    put("partial", "h", 1, 200, lost=(10, 0))
    put("near", "h", 100, 399)
    put("far", "h", 150, 449)
    put("low", "i", 1, 300, 80.0)
    kind = "locus string, allele string, contig string, `from` int, `to` int, plus boolean, seq string, matches int, identity double, qlen int, not_aligned_5 int, not_aligned_3 int, has_start boolean, has_stop boolean, consistent boolean"
    got = {(r["locus"], r["contig"], r["allele"], r["kept"]) for r in A.resolve_loci(spark.createDataFrame(rows, kind), 90).collect()}
    assert got == {("long", "c", "1", True), ("x", "d", "1", False), ("y", "d", "1", False), ("twice", "e", "1", False), ("twice", "f", "1", False), ("same", "g", "b", True), ("far", "h", "1", True)}


def test_chains_of_islands_in_small_batches(spark):
    """Islands that begin and end inside batches are chained alone, without a call of Python's for each."""
    import contextlib
    import io
    import random

    draw, rows = random.Random(5), []
    for locus in range(3):
        for contig in range(4):
            for island in range(9):
                for d in draw.sample(range(40), draw.randint(1, 5)):
                    at = draw.randint(0, 60)
                    rows.append((locus, True, contig, at, at + 30, island * 1000 + at + d, island * 1000 + at + d + 30, 31, 100, 9000))
    found = spark.createDataFrame(rows, "locus long, plus boolean, contig long, qfrom long, qto long, sfrom long, sto long, score int, qlen int, clen int")
    want = []
    for key in {(r[0], r[2], r[5] // 1000) for r in rows}:
        want += [(key[0], key[1], *x) for x in A.best_chains([r[3:8] for r in rows if (r[0], r[2], r[5] // 1000) == key], 15, 10.0)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        told = A.chains(found)
        got = [(r.locus, r.contig, r.qfrom, r.qto, r.sfrom, r.sto, r.score, r.low, r.high) for r in told.collect()]
        with contextlib.redirect_stdout(io.StringIO()) as plan:
            told.explain()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got) == sorted(want)
    assert "FlatMapGroups" not in plan.getvalue()
