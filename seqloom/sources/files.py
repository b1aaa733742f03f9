"""Files that line readers do not fit: FASTQ in blocks, archives in archives, binary indexes.

All bytes come from Spark's own readers, so any store that Spark reads will do.
"""

from __future__ import annotations

import gzip
import io
import tarfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Lines of a block that decide where its records begin.
DECIDING = 400
#: Fixed value: the version that the header of a binary index names.
INDEX_VERSION = 1


def record_phase(lines: list[str]) -> int | None:
    """How many lines of a block of four-line records come before its first whole record; None if that cannot be told.

    A record has ``@`` before its name, ``+`` before its third line, and as many qualities as bases.  A place is right if all whole
    records from there on are so, and no other place of the four is.
    """

    def fits(at: int) -> bool:
        whole = range(at, len(lines) - 3, 4)
        return len(whole) > 0 and all(lines[i][:1] == "@" and lines[i + 2][:1] == "+" and len(lines[i + 1]) == len(lines[i + 3]) for i in whole)

    found = [at for at in range(4) if fits(at)]
    return found[0] if len(found) == 1 else None


_PARTS = "path string, block long, kind string, lines array<string>"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``record`` for whole records, and ``head``, ``tail`` or ``whole`` for the lines of a block that are not in one."""
    held: list[tuple] = []

    def rows(most: int = 0) -> Iterator[pa.RecordBatch]:
        if len(held) > most:
            columns = list(zip(*held, strict=True))
            held.clear()
            yield pa.record_batch([pa.array(columns[0]), pa.array(columns[1], pa.int64()), pa.array(columns[2]), pa.array(columns[3], pa.list_(pa.string()))], ["path", "block", "kind", "lines"])

    class Block:
        def __init__(self, path: str, start: int):
            self.key, self.lines, self.decided = (path, start), [], False

        def cut(self) -> None:
            whole = len(self.lines) // 4 * 4
            held.extend((*self.key, "record", self.lines[i : i + 4]) for i in range(0, whole, 4))
            self.lines = self.lines[whole:]

        def decide(self) -> None:
            self.decided = True
            at = 0 if self.key[1] == 0 else record_phase(self.lines)
            self.sure = at is not None
            if self.sure:
                held.append((*self.key, "head", self.lines[:at]))
                self.lines = self.lines[at:]

        def add(self, line: str) -> None:
            self.lines.append(line)
            if not self.decided and len(self.lines) == DECIDING:
                self.decide()
            if self.decided and self.sure and len(self.lines) >= DECIDING:
                self.cut()

        def end(self) -> None:
            if not self.decided:
                self.decide()
            if self.sure:
                self.cut()
            held.append((*self.key, "tail" if self.sure else "whole", self.lines))

    block = None
    for batch in batches:
        for path, start, line in zip(*(batch.column(c).to_pylist() for c in ("path", "block", "value")), strict=True):
            if block is None or block.key != (path, start):
                if block:
                    block.end()
                block = Block(path, start)
            block.add(line)
        yield from rows(20_000)
    if block:
        block.end()
    yield from rows()


def _joined(table: pa.Table) -> pa.Table:
    """The records of lines that neighbouring blocks share, in the order of the blocks."""
    order = np.lexsort((np.array([{"tail": 1}.get(k, 0) for k in table.column("kind").to_pylist()]), table.column("block").to_numpy()))
    lines = [x for i in order for x in table.column("lines")[int(i)].as_py()]
    whole = [lines[i : i + 4] for i in range(0, len(lines) - len(lines) % 4, 4)]
    return pa.table([pa.array(whole, pa.list_(pa.string()))], ["lines"])


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """``spotid, bases, quals`` of FASTQ files of four-line records, with either kind of line end; gz files are one block each.

    Spark deals a file out in blocks.  A block finds where its records begin by what all of them look like (the first block begins with one); what it has before
    its first and behind its last record joins with that of the blocks next to it.  A block that cannot tell, as when a record is longer
    than a block, passes its lines on whole.  Lines that are left over at a file's end, fewer than four, are no record; other malformed records are an error.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
    parts = lines.mapInArrow(_blocks, _PARTS)
    shared = parts.where("kind <> 'record'")
    # a run of lines ends with the head of a block that knows where its records begin
    w = Window.partitionBy("path").orderBy("block", F.col("kind") == "tail")
    runs = shared.withColumn("_run", F.coalesce(F.sum(F.when(F.col("kind") == "tail", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.when(F.col("kind") == "tail", 1).otherwise(0))
    joined = runs.groupBy("path", "_run").applyInArrow(_joined, "lines array<string>")
    r = parts.where("kind = 'record'").select("lines").unionByName(joined)
    line = lambda i: F.get("lines", F.lit(i))
    good = line(0).startswith("@") & line(2).startswith("+") & (F.length(line(1)) == F.length(line(3)))
    checked = F.when(good, line(1)).otherwise(F.raise_error(F.concat(F.lit("malformed record "), line(0))))
    return r.select(F.regexp_extract(line(0), "^@([^ /]*)", 1).alias("spotid"), checked.alias("bases"), line(3).alias("quals"))


def read_pairs(spark: SparkSession, first: str, second: str) -> DataFrame:
    """``id, first, second``: the bases of mates, which two FASTQ files have under one name, that ends at a space or slash; a read without a mate is left out."""
    one, two = read_fastq(spark, first), read_fastq(spark, second)
    return one.select(F.col("spotid").alias("id"), F.col("bases").alias("first")).join(two.select(F.col("spotid").alias("id"), F.col("bases").alias("second")), "id")


def read_nested(spark: SparkSession, path: str) -> DataFrame:
    """``path, place, line``: lines of text files, of gz files, and of the members of tar archives, which may be any of these again; ``place`` counts from 0.

    A member's path is that of its archive and its name.  An archive is read by one task, member by member, and must be below 2 GB.
    """

    def members(data: bytes, name: str) -> Iterator[tuple[str, bytes]]:
        try:
            with tarfile.open(fileobj=io.BytesIO(data)) as tar:
                for member in tar:
                    if member.isfile():
                        yield from members(tar.extractfile(member).read(), f"{name}/{member.name}")
            return
        except tarfile.ReadError:
            pass
        if data[:2] == b"\x1f\x8b":
            yield from members(gzip.decompress(data), name.removesuffix(".gz"))
        else:
            yield name, data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                for member, text in members(data, name) if data else ():
                    lines = text.decode("utf-8", "replace").splitlines() if text else []
                    for at in range(0, len(lines), 50_000):
                        some = lines[at : at + 50_000]
                        yield pa.record_batch([pa.array([member] * len(some)), pa.array(range(at, at + len(some)), pa.int64()), pa.array(some)], ["path", "place", "line"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, place long, line string")


def read_binary_index(spark: SparkSession, path: str, kind: str = "dbs") -> DataFrame:
    """``kmer, tax_id, k`` of binary index files: ``db`` (k-mers alone, tax_id null), ``dbs`` (a taxon each) or ``dbsm`` (a row for each taxon of a k-mer).

    A file begins with 64-bit numbers, the version and k, then the count of records.  k-mers take 64 bits, up to 32 bases; taxa 32.
    Another version, a k outside 1 to 64, a k above 32 or a file that is too short is an error.  Files must be below 2 GB; an index of several is dealt over tasks.
    """
    if kind not in ("db", "dbs", "dbsm"):
        raise ValueError(f"no such kind of index: {kind}")

    def records(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray | None, int]]:
        if len(data) < 24:
            raise ValueError("the index has no header")
        version, k, count = (int(x) for x in np.frombuffer(data[:24], "<u8"))
        if version != INDEX_VERSION:
            raise ValueError(f"unsupported version {version}")
        if not 1 <= k <= 64:
            raise ValueError(f"invalid length of k-mers {k}")
        if k > 32:
            raise ValueError("k-mers of more than 32 bases are not read")
        if kind == "dbsm":
            at, kmers, taxa = 24, [], []
            for _ in range(count):
                n = int(np.frombuffer(data, "<i4", 1, at + 8)[0])
                kmers.extend([int(np.frombuffer(data, "<i8", 1, at)[0])] * n)
                taxa.extend(np.frombuffer(data, "<i4", n, at + 12).tolist())
                at += 12 + 4 * n
                if len(kmers) >= 100_000:
                    yield np.array(kmers, np.int64), np.array(taxa, np.int32), k
                    kmers, taxa = [], []
            yield np.array(kmers, np.int64), np.array(taxa, np.int32), k
            return
        width = {"db": [("kmer", "<i8")], "dbs": [("kmer", "<i8"), ("tax", "<i4")]}[kind]
        rows = np.frombuffer(data, np.dtype(width), count, 24)
        for at in range(0, count, 100_000):
            some = rows[at : at + 100_000]
            yield some["kmer"], some["tax"] if kind == "dbs" else None, k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                for kmers, taxa, k in records(data.as_py()):
                    own = pa.array([None] * len(kmers), pa.int32()) if taxa is None else pa.array(np.ascontiguousarray(taxa))
                    yield pa.record_batch([pa.array(np.ascontiguousarray(kmers)), own, pa.array(np.full(len(kmers), k, np.int32))], ["kmer", "tax_id", "k"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "kmer long, tax_id int, k int")
