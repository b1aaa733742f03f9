"""FASTQ in blocks, archives in archives, binary indexes, remaps with replaced accessions."""

import gzip
import io
import random
import struct
import tarfile

import pytest

from seqloom.operators import agp as AG
from seqloom.sources import files as FI


@pytest.fixture
def small_blocks(spark):
    names = {"spark.sql.files.maxPartitionBytes": "700b", "spark.sql.files.openCostInBytes": "1b"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def records(rng, n, longest):
    out = []
    for i in range(n):
        size = rng.randrange(1, longest)
        bases = "".join(rng.choice("ACGTN") for _ in range(size))
        quals = "".join(rng.choice("@+!IJ") for _ in range(size))  # lines that look like names and third lines
        out.append((f"r{i}", bases, quals))
    return out


def fastq(rows, end="\n", last=True):
    text = "".join(f"@{n}/1 more{end}{b}{end}+{rng_name}{end}{q}{end}" for n, b, q, rng_name in ((*r, r[0] if i % 3 else "") for i, r in enumerate(rows)))
    return text if last else text[: -len(end)]


@pytest.mark.parametrize(("longest", "end"), [(60, "\n"), (60, "\r\n"), (2500, "\n")])
def test_fastq_in_blocks(spark, tmp_path, small_blocks, longest, end):
    rng = random.Random(longest)
    want = []
    for name, n, last in (("a.fastq", 150, True), ("b.fastq", 40, False), ("c.fastq", 1, True), ("d.fastq", 0, True)):
        rows = records(rng, n, longest)
        want += rows
        (tmp_path / name).write_bytes(fastq(rows, end, last).encode())
    got = FI.read_fastq(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_fastq_of_other_kinds(spark, tmp_path):
    rows = records(random.Random(1), 900, 90)
    with gzip.open(tmp_path / "a.fastq.gz", "wt") as f:
        f.write(fastq(rows))
    assert sorted(map(tuple, FI.read_fastq(spark, str(tmp_path / "a.fastq.gz")).collect())) == sorted(rows)
    (tmp_path / "bad.fastq").write_text(fastq(rows[:30]) + "@x\nACG\n+\nII\n" + fastq(rows[30:60]))
    with pytest.raises(Exception, match="malformed"):
        FI.read_fastq(spark, str(tmp_path / "bad.fastq")).collect()
    (tmp_path / "b.fastq").write_text(fastq([(n, q.replace("@", "A"), q) for n, _, q in rows[::2]]))
    pairs = FI.read_pairs(spark, str(tmp_path / "a.fastq.gz"), str(tmp_path / "b.fastq")).collect()
    assert len(pairs) == 450 and {(r["id"], r["first"]) for r in pairs} == {(n, b) for n, b, _ in rows[::2]}


def test_phases():
    lines = ["@a", "AC", "+", "@+", "@b", "G", "+b", "@", "@c"]
    assert [FI.record_phase(lines[i:]) for i in range(4)] == [0, 3, 2, 1]
    assert FI.record_phase(["A", "C"]) is None and FI.record_phase([]) is None
    assert FI.record_phase(["@", "@", "+", "+", "+", "+", "+"]) is None  # two places would do


def test_archives_in_archives(spark, tmp_path):
    def tar(members, mode="w"):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode=mode) as t:
            for name, data in members.items():
                info = tarfile.TarInfo(name)
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
        return out.getvalue()

    inner = tar({"x.txt": b"1\n2\r\n3", "empty.txt": b""})
    (tmp_path / "all.tgz").write_bytes(tar({"in.tar": inner, "y.txt.gz": gzip.compress(b"four\n")}, "w:gz"))
    (tmp_path / "z.txt").write_text("five\nsix\n")
    (tmp_path / "w.gz").write_bytes(gzip.compress(b"seven"))
    (tmp_path / "none").write_bytes(b"")
    got = {(r["path"].rsplit(tmp_path.name + "/")[1], r["place"], r["line"]) for r in FI.read_nested(spark, str(tmp_path)).collect()}
    assert got == {("all.tgz/in.tar/x.txt", 0, "1"), ("all.tgz/in.tar/x.txt", 1, "2"), ("all.tgz/in.tar/x.txt", 2, "3"), ("all.tgz/y.txt", 0, "four"), ("z.txt", 0, "five"), ("z.txt", 1, "six"), ("w", 0, "seven")}


def test_binary_indexes(spark, tmp_path):
    rng = random.Random(2)
    head = lambda n, k=32, version=1: struct.pack("<QQQ", version, k, n)
    kmers = [rng.randrange(1 << 64) for _ in range(500)]
    signed = [x - (1 << 64) if x >> 63 else x for x in kmers]
    (tmp_path / "a.db").write_bytes(head(500) + b"".join(struct.pack("<Q", x) for x in kmers))
    (tmp_path / "a.dbs").write_bytes(head(500, 31) + b"".join(struct.pack("<Qi", x, i) for i, x in enumerate(kmers)))
    (tmp_path / "a.dbsm").write_bytes(head(500) + b"".join(struct.pack(f"<Qi{i % 4}i", x, i % 4, *range(i % 4)) for i, x in enumerate(kmers)))
    read = lambda kind: sorted(tuple(r) for r in FI.read_binary_index(spark, str(tmp_path / f"a.{kind}"), kind).collect())
    assert [(x, k) for x, _, k in read("db")] == sorted((x, 32) for x in signed)
    assert read("dbs") == sorted((x, i, 31) for i, x in enumerate(signed))
    assert read("dbsm") == sorted((x, t, 32) for i, x in enumerate(signed) for t in range(i % 4))
    for name, data, said in (("v", head(0, version=2), "version"), ("k", head(0, 65), "length"), ("wide", head(0, 40), "more than 32"), ("cut", head(9), "buffer"), ("none", b"x", "header")):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(Exception, match=said):
            FI.read_binary_index(spark, str(tmp_path / name)).collect()


def test_remap_with_replaced_accessions(spark):
    kind = "object string, beg int, `end` int, component string, cbeg int, cend int, strand int"
    old = [("o1", 1, 100, "c1", 1, 100, 1), ("o2", 1, 100, "c1", 1, 100, -1), ("o3", 1, 50, "c2", 1, 50, 1), ("o4", 1, 60, "c3", 1, 60, 1)]
    new = [("n1", 11, 110, "c1", 1, 100, 1), ("n2", 1, 50, "c2", 1, 50, -1), ("n3", 1, 60, "c3", 1, 60, 1), ("n4", 1, 60, "c3", 1, 60, 1)]
    a, b = spark.createDataFrame(old, kind), spark.createDataFrame(new, kind)
    assert {tuple(r) for r in AG.remap(a, b).collect()} == {("n2", 1, 50, "o3", 1, True)}
    known = spark.createDataFrame([("o2", "n1"), ("o4", "n4"), ("o3", "n2"), ("o1", "n9"), ("o2", "n1")], "old string, new string")
    assert {tuple(r) for r in AG.remap(a, b, known).collect()} == {("n2", 1, 50, "o3", 1, True), ("n1", 11, 100, "o2", 1, True), ("n4", 1, 60, "o4", 1, False)}
