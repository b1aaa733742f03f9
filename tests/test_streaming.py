from pyspark.sql import functions as F

from seqloom.functions import seq as S
from seqloom.sources.formats import read_fasta
from seqloom.streaming.classify import read_stream, stream_hits


def index(spark):
    return spark.createDataFrame([("ACG", 5), ("TTT", 7), ("GGG", 0)], "k string, tax_id int").select(F.least(S.encode("k"), S.encode(S.revcomp("k"))).alias("kmer"), "tax_id")


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.fasta").write_bytes(b">s1 x len>30 >y\r\nACGTN\r\nACGA\r\n>s2\nTTTT\n")
    query = stream_hits(read_stream(spark, str(folder)), index(spark), 3).writeStream.outputMode("complete").format("memory").queryName("hits").start()
    query.processAllAvailable()
    (folder / "b.fasta").write_text(">s1\nCGT\n")
    query.processAllAvailable()
    query.stop()
    got = {(r.spotid, r.tax_id): r.n for r in spark.sql("SELECT * FROM hits").collect()}
    assert got == {("s1", 5): 4, ("s2", 7): 2}
    batch = {(r.spotid, r.bases) for r in read_fasta(spark, str(folder)).collect()}
    assert batch == {("s1", "ACGTNACGA"), ("s2", "TTTT"), ("s1", "CGT")}


def test_late_spots_leave_the_state(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    hits = stream_hits(read_stream(spark, str(folder)), index(spark), 3, "10 minutes")
    assert {"window", "spotid", "tax_id", "n"} == set(hits.columns)
    (folder / "a.fasta").write_text(">s1\nACG\n")
    query = hits.writeStream.outputMode("update").format("memory").queryName("late_hits").start()
    query.processAllAvailable()
    query.stop()
    assert [(r.spotid, r.tax_id, r.n) for r in spark.sql("SELECT * FROM late_hits").collect()] == [("s1", 5, 1)]
