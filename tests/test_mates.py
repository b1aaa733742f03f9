"""Mate pairs and assembly on planted genomes."""

import random

import pytest

from seqloom.operators import graph as G
from seqloom.operators import kmerdb as KD
from seqloom.operators import mates as M


def turn(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def genome(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


K = 9


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(4)
    g = genome(rng, 400)
    fork = g[:100] + {"A": "C"}.get(g[100], "A") + g[101:200]  # a bubble: two walks from 90 to 110
    counts = KD.count_kmers(spark.createDataFrame([(1, g), (2, g), (3, fork), (4, fork)], "id long, bases string"), K)
    nodes = G.oriented(counts.select("kmer", "n"), K)
    return g, nodes.cache(), G.edges(nodes, K).cache()


def test_reads_are_clipped(spark, world):
    g, _, found = world
    bad = g[250:280] + {"A": "C"}.get(g[280], "A") + g[281:300]
    rows = [(1, g[220:260]), (2, bad), (3, turn(g[300:350])), (4, "ACGT"), (5, ""), (6, None), (7, turn(g[300:330]) + "AAAAAAAAAAAA")]
    got = {r["id"]: r["bases"] for r in M.clip_reads(spark.createDataFrame(rows, "id long, bases string"), found, K).collect()}
    assert got[1] == g[220:260] and got[2] == g[250:280] and got[3] == turn(g[300:350]) and set(got) == {1, 2, 3, 7}
    assert got[7].startswith(turn(g[300:330]))


def test_mates_are_connected(spark, world):
    g, nodes, found = world
    pairs = [
        (1, g[210:240], turn(g[250:280])), (2, turn(g[250:280]), g[210:240]),  # ten bases between them, from either strand
        (3, g[210:240], turn(g[330:360])),  # too far
        (4, g[70:98], turn(g[104:130])),  # over the bubble
        (5, g[300:340], turn(g[320:350])),  # overlapping
        (6, g[210:240], "ACGTACGTAC"), (7, g[210:240], None),
    ]
    got = {r["id"]: (r["status"], r["bases"]) for r in M.connect_mates(spark.createDataFrame(pairs, "id long, first string, second string"), found, nodes, K, 20).collect()}
    assert got[1] == ("connected", g[210:280]) and got[2] == ("connected", turn(g[210:280])) and got[5] == ("overlapping", g[300:350])
    assert [got[i] for i in (3, 4, 6, 7)] == [("none", None), ("ambiguous", None), ("none", None), ("none", None)]


def test_insert_sizes(spark):
    rng = random.Random(9)
    g = genome(rng, 900)
    pairs, want = [], {}
    for i in range(40):
        n, at = rng.randrange(120, 260), rng.randrange(600)
        a, b = g[at : at + 50], turn(g[at + n - 50 : at + n])
        pairs.append((i, a, b) if i % 2 else (i, b, a))
        want[i] = n
    pairs += [(90, g[:50], g[100:150]), (91, g[:50], genome(rng, 50))]
    sizes = M.insert_sizes(spark.createDataFrame(pairs, "id long, first string, second string"), spark.createDataFrame([("c", g)], "contig string, bases string"), 15)
    assert {r["id"]: r["size"] for r in sizes.collect()} == want
    rows, run, half = sorted(want.values(), reverse=True), 0, sum(want.values()) / 2
    for n, size in enumerate(rows, 1):
        run += size
        if run >= half:
            break
    assert tuple(M.insert_estimate(sizes).first()) == (size, n)


def test_assembly_over_growing_k(spark):
    rng = random.Random(3)
    repeat = genome(rng, 14)
    g = genome(rng, 120) + repeat + genome(rng, 120) + repeat + genome(rng, 120)
    reads = [(i, r if i % 2 else turn(r)) for i, r in enumerate(g[at : at + 40] for at in [*range(0, len(g) - 40, 2), len(g) - 40])]
    made = M.assemble(spark.createDataFrame(reads, "id long, bases string"), [9, 21], 2).collect()
    assert {r["k"] for r in made} == {9, 21}
    longest = {k: max((r["bases"] for r in made if r["k"] == k), key=len) for k in (9, 21)}
    assert len(longest[9]) < 200 and (longest[21] in g or turn(longest[21]) in g) and len(longest[21]) > 350
    assert M.assemble(spark.createDataFrame([], "id long, bases string"), [5]).collect() == []


def test_places_of_frequent_kmers(spark):
    """1,200 k-mers that each lie at 800,000 places: pairs of all places would be a thousand million rows."""
    from seqloom.operators import assembly as AS

    contigs = spark.range(400).selectExpr("id AS contig", "repeat('A', 2000) AS bases").repartition(4)
    reads = spark.range(50).selectExpr("id AS spotid", "if(id % 2 = 0, repeat('A', 38), concat('C', repeat('T', 37))) AS bases")
    rows = {r.spotid: tuple(r)[1:] for r in AS.place_reads(reads, contigs, 15).select("spotid", "contig", "read_pos", "contig_pos", "plus").collect()}
    assert rows == {i: (0, 0, 0, True) if i % 2 == 0 else (0, 1, 0, False) for i in range(50)}


def test_counts_of_tasks(spark, monkeypatch):
    """The same as one row a k-mer gives, over edges of pieces, in fewer rows."""
    rng = random.Random(5)
    texts = [genome(rng, rng.randrange(0, 120)) for _ in range(60)] + ["A" * 5000, None, "", "ACGTNACGTT"]
    reads = spark.createDataFrame([(t,) for t in texts], "bases string").coalesce(1)
    for k, piece in ((4, 50), (9, 64), (31, 1 << 21)):
        monkeypatch.setattr(KD, "PIECE", piece)
        rows = KD.task_counts(reads, k)
        told = {r["kmer"]: r["n"] for r in rows.groupBy("kmer").sum("n").toDF("kmer", "n").collect()}
        assert told == {r["kmer"]: r["n"] for r in KD.count_kmers(KD.clean_runs(reads), k).collect()}
    assert rows.count() < KD.explode_kmers(KD.clean_runs(reads), 31).count()


def test_spent_reads(spark):
    """Reads of one id leave together, those without an id or k-mers stay; one place that is not there keeps a read."""
    rng = random.Random(6)
    g = genome(rng, 300)
    other = {"A": "C"}.get(g[63], "A")
    rows = [(1, g[:100]), (2, g[50:63] + other + g[64:200]), (3, g[10:19]), (4, g[:8]), (5, g[:60]), (5, genome(rng, 60)), (6, g[20:60]), (6, turn(g[100:200])), (None, g[:50]), (7, None), (8, "")]
    used = spark.createDataFrame([(g,)], "bases string")
    used = KD.count_kmers(used, K).select("kmer")
    got = [r["id"] for r in M.spent_reads(spark.createDataFrame(rows, "id long, bases string"), used, K).collect()]
    assert sorted(got) == [1, 3, 6]
