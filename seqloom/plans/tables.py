"""Declared tables over a run, and SQL jobs over them.

A declaration is ``name = SOURCE.TYPE {fields} #range %chunk``; the type may be left out (SPOT), fields too (all), ranges
may be several.  A range is ``start.count``, ``@ref`` or ``@ref:start.count``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of each table type, in schema order.
FIELDS = {
    "ALIG": "id refspec bases cigar cigarclipped cigarlong cigarlongclipped refpos mapq refbases readgroup readid reversed clippedfragmentbases qualities category length softclipleft softclipright templatelength rnaorientation hasmate mateid materefspec matereversed".split(),
    "SPOT": "id bases readgroup qualities category nfragments name".split(),
    "FRAG": "id bases readgroup qualities category name".split(),
    "REF": "refspec length name circular nalignments".split(),
    "RDGRP": ["name"],
    "PILEUP": "id refspec refpos mapq refbases qualities depth event indel".split(),
}
OPTION_KEYS = "OUT TEMP SQL MASTER SLICES FORMAT EXECMEM DRVMEM MAXRES LOCNODES RESREQ".split()
PER_BASE = {"refspec", "refpos", "refbases", "depth"}


@dataclass(frozen=True)
class Range:
    ref: str | None = None
    start: int | None = None
    count: int | None = None

    @classmethod
    def parse(cls, text: str) -> Range:
        m = re.fullmatch(r"(?:@([^:]+)(?::(\d+)\.(\d+))?|(\d+)\.(\d+))", text.strip())
        if not m:
            raise ValueError(f"not a range: {text}")
        ref, a, n, b, c = m.groups()
        start, count = (a, n) if ref else (b, c)
        return cls(ref, int(start) if start else None, int(count) if count else None)

    def predicate(self, kind: str, row: str = "row") -> Column:
        """The rows of this range: by place on a reference, or by row number counted from 1; a count of 0 takes all."""
        out = F.lit(True)
        if self.ref is not None:
            out = F.col("refspec") == self.ref
        if self.start is not None and self.count:
            at = F.col("refpos" if self.ref is not None else row)
            out = out & (at >= self.start) & (at < self.start + self.count)
        return out


@dataclass
class TableSpec:
    name: str
    source: str
    kind: str = "SPOT"
    fields: list[str] = field(default_factory=list)
    ranges: list[Range] = field(default_factory=list)
    chunk: int = 1500

    @classmethod
    def parse(cls, line: str) -> TableSpec:
        name, eq, rest = line.partition("=")
        if not eq or not name.strip():
            raise ValueError(f"not a table declaration: {line}")
        fields = re.search(r"\{([^}]*)\}", rest)
        ranges = [Range.parse(x) for x in re.findall(r"#(\S+)", rest)]
        chunk = re.search(r"%(\d+)", rest)
        source = re.split(r"[{#%]", rest)[0].strip()
        base, dot, kind = source.rpartition(".")
        kind = kind.upper() if dot and kind.upper() in FIELDS else "SPOT"
        source = base if dot and source.rpartition(".")[2].upper() in FIELDS else source
        spec = cls(name.strip(), source, kind, ranges=ranges, chunk=int(chunk[1]) if chunk else 1500)
        spec.fields = select_fields(kind, fields[1] if fields else "*")
        return spec


def select_fields(kind: str, text: str) -> list[str]:
    """The asked fields in schema order; one that the table type lacks is an error."""
    asked = {x.strip().lower() for x in text.split(",") if x.strip()}
    if not asked or "*" in asked:
        return list(FIELDS[kind])
    if wrong := asked.difference(FIELDS[kind]):
        raise ValueError(f"{kind} has no {', '.join(sorted(wrong))}")
    return [f for f in FIELDS[kind] if f in asked]


@dataclass
class JobOptions:
    values: dict[str, str]
    tables: list[TableSpec]

    @classmethod
    def parse(cls, text: str) -> JobOptions:
        """``KEY=VALUE`` lines; ``#`` begins a comment line; other names declare tables."""
        values, tables = {}, []
        for line in text.splitlines():
            if not line.strip() or line.lstrip().startswith("#"):
                continue
            key, _, value = line.partition("=")
            if key.strip().upper() in OPTION_KEYS:
                values[key.strip().upper()] = value.strip()
            else:
                tables.append(TableSpec.parse(line))
        return cls(values, tables)

    def missing(self) -> list[str]:
        return [k for k in ("OUT", "TEMP", "SQL") if not self.values.get(k)]


def scan(spec: TableSpec, source: DataFrame) -> DataFrame:
    """The declared columns and rows of a source; columns that it lacks are empty text, or false for flags."""
    flags = {"reversed", "hasmate", "matereversed", "circular"}
    rows = source
    if spec.ranges:
        keep = F.lit(False)
        for r in spec.ranges:
            keep = keep | r.predicate(spec.kind)
        rows = rows.where(keep)
    if spec.kind == "PILEUP" and set(spec.fields) <= PER_BASE:
        rows = rows.select(*spec.fields).distinct()
        return rows
    empty = lambda f: F.lit(False) if f in flags else F.lit("")
    return rows.select(*((F.coalesce(F.col(f), empty(f)) if f in flags or dict(source.dtypes)[f] == "string" else F.col(f)).alias(f) if f in source.columns else empty(f).alias(f) for f in spec.fields))


#: Places of a reference that share a row of depths.
BIN = 256
#: Places of a reference whose steps are added up in one task; a place in it has two bytes.
STRETCH = 1 << 16
#: Alignments that a task adds up at once.
TOGETHER = 1 << 20


def _bin_pieces(alignments: DataFrame, *keep: str) -> DataFrame:
    """Alignments cut where bins of a reference begin: ``keep, refspec, _bin, _from, _to`` (places in the bin, end exclusive)."""
    bins = F.explode(F.expr(f"sequence(CAST(floor(refpos / {BIN}) AS BIGINT), CAST(floor((refpos + length - 1) / {BIN}) AS BIGINT))"))
    first = F.col("_bin") * BIN
    cut_off = alignments.where("length > 0").select(*keep, "refspec", "refpos", "length", bins.alias("_bin"))
    return cut_off.select(*keep, "refspec", "_bin", F.greatest(F.col("refpos") - first, F.lit(0)).cast("int").alias("_from"), F.least(F.col("refpos") + F.col("length") - first, F.lit(BIN)).cast("int").alias("_to"))


def _steps_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From ``refspec, refpos, length`` the steps of depth in each stretch: ``refspec, _stretch, _at, _n``, as bytes.

    ``TOGETHER`` alignments are added up before they leave, so a stretch sends a row for so many alignments and each of its places at most once.
    """
    held, count = [], 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= TOGETHER:
            yield from _added_up(pa.Table.from_batches(held))
            held, count = [], 0
    if count:
        yield from _added_up(pa.Table.from_batches(held))


def _added_up(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    names = rows["refspec"].combine_chunks().dictionary_encode(null_encoding="encode")
    ref, first, length = names.indices.to_numpy(), rows["refpos"].to_numpy(), rows["length"].to_numpy()
    ref, at, n = np.concatenate([ref, ref]), np.concatenate([first, first + length]), np.repeat(np.array([1, -1]), len(first))
    order = np.lexsort((at, ref))
    ref, at, n = ref[order], at[order], n[order]
    own = np.flatnonzero(np.concatenate([[True], (np.diff(ref) != 0) | (np.diff(at) != 0)]))
    ref, at, n = ref[own], at[own], np.add.reduceat(n, own)
    stretch, depth = at // STRETCH, np.cumsum(n)  # which is 0 where a reference ends
    # what is still open where a stretch ends is a step at the beginning of the next one
    more = np.where(depth[:-1] > 0, np.diff(stretch), 0)
    after = np.repeat(np.arange(len(more)), more)
    nth = np.arange(len(after)) - np.repeat(np.cumsum(more) - more, more) + 1
    on = stretch[after] + nth
    ref, at, n, stretch = (np.insert(x, after + 1, y) for x, y in ((ref, ref[after]), (at, on * STRETCH), (n, depth[after]), (stretch, on)))
    begin = np.flatnonzero(np.concatenate([[True], (np.diff(ref) != 0) | (np.diff(stretch) != 0)]))
    ends = np.append(begin, len(at))
    for i in range(0, len(begin), 1 << 12):
        some = ends[i : i + (1 << 12) + 1]
        x, which = slice(some[0], some[-1]), begin[i : i + (1 << 12)]
        packed = lambda values, kind: pa.Array.from_buffers(pa.binary(), len(which), [None, pa.py_buffer(((some - some[0]) * kind().itemsize).astype(np.int32)), pa.py_buffer(values.astype(kind))])
        yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(ref[which])), pa.array(stretch[which]), packed(at[x] - stretch[x] * STRETCH, np.uint16), packed(n[x], np.int32)], names=["refspec", "_stretch", "_at", "_n"])


def _depths_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From all steps of a stretch, which follow one another, ``refspec, _bin, depths`` of the bins that are touched."""
    steps, low, high, now = np.zeros(STRETCH, np.int64), STRETCH, 0, None
    made, size = [], 0

    def closed() -> None:
        """The bins of the stretch ``now``; its steps are 0 again."""
        nonlocal low, high, size
        low, high = low // BIN * BIN, -(-(high + 1) // BIN) * BIN
        depths = np.cumsum(steps[low:high])
        open_end = depths[-1]
        steps[low:high] = 0
        if open_end:  # the last depth goes on to the end
            depths = np.concatenate([depths, np.full(STRETCH - high, open_end)])
        depths = depths.reshape(-1, BIN)
        touched = np.flatnonzero(depths.any(axis=1))
        made.append((now[0], now[1] * (STRETCH // BIN) + low // BIN + touched, depths[touched]))
        low, high, size = STRETCH, 0, size + len(touched)

    def batch() -> pa.RecordBatch:
        refs = pa.array([m[0] for m in made], pa.string()).take(pa.array(np.repeat(np.arange(len(made)), [len(m[1]) for m in made])))
        depths = pa.ListArray.from_arrays(np.arange(size + 1, dtype=np.int32) * BIN, np.concatenate([m[2] for m in made]).ravel())
        return pa.RecordBatch.from_arrays([refs, pa.array(np.concatenate([m[1] for m in made])), depths], names=["refspec", "_bin", "depths"])

    for rows in batches:
        for key in zip(rows["refspec"].to_pylist(), rows["_stretch"].to_pylist(), rows["_at"], rows["_n"], strict=True):
            if now is not None and now != key[:2]:
                closed()
                if size >= STRETCH // BIN:
                    yield batch()
                    made, size = [], 0
            now, at, n = key[:2], np.frombuffer(key[2].as_buffer(), np.uint16), np.frombuffer(key[3].as_buffer(), np.int32)
            np.add.at(steps, at, n)
            low, high = min(low, int(at[0])), max(high, int(at[-1]))
    if now is not None:
        closed()
        yield batch()


def _bin_depths(alignments: DataFrame) -> DataFrame:
    """``refspec, _bin, depths``: the depths of all places of each bin that is touched.

    Only steps of depth travel, added up in their task and packed by stretches, so no place is written out for an alignment.
    """
    rows = alignments.where("length > 0 AND refpos IS NOT NULL").select(F.col("refspec").cast("string").alias("refspec"), F.col("refpos").cast("long").alias("refpos"), F.col("length").cast("long").alias("length"))
    steps = rows.mapInArrow(_steps_of_task, "refspec string, _stretch long, _at binary, _n binary")
    by = steps.repartition("refspec", "_stretch").sortWithinPartitions("refspec", "_stretch")
    return by.mapInArrow(_depths_of_task, "refspec string, _bin long, depths array<long>")


def pileup(alignments: DataFrame) -> DataFrame:
    """``refspec, refpos, id, mapq, depth``: a row for each base of each alignment, with the depth at its place.

    Alignments meet the depths of their bins, and bases are written out after the last shuffle.
    """
    pieces, bins = _bin_pieces(alignments, "id", "mapq"), _bin_depths(alignments).withColumnsRenamed({"refspec": "_ref", "_bin": "_at"})
    met = pieces.join(bins, F.col("refspec").eqNullSafe(F.col("_ref")) & (F.col("_bin") == F.col("_at")))
    own = F.slice("depths", F.col("_from") + 1, F.col("_to") - F.col("_from"))
    rows = met.select("refspec", (F.col("_bin") * BIN + F.col("_from")).alias("_first"), "id", "mapq", F.posexplode(own).alias("_i", "depth"))
    return rows.select("refspec", (F.col("_first") + F.col("_i")).alias("refpos"), "id", "mapq", "depth")


def depth(alignments: DataFrame) -> DataFrame:
    """``refspec, refpos, depth`` of covered places."""
    rows = _bin_depths(alignments).select("refspec", "_bin", F.posexplode("depths").alias("_i", "depth")).where("depth > 0")
    return rows.select("refspec", (F.col("_bin") * BIN + F.col("_i")).alias("refpos"), "depth")


def spots(fragments: DataFrame) -> DataFrame:
    """A row a spot: all fragments' bases and qualities in order."""
    parts = F.array_sort(F.collect_list(F.struct("frag", "bases", "quals")))
    g = fragments.groupBy("spotid").agg(parts.alias("p"), F.min("readgroup").alias("readgroup"), F.count("*").alias("nfragments"))
    return g.select(F.col("spotid").alias("id"), F.array_join(F.transform("p", lambda x: x["bases"]), "").alias("bases"), F.array_join(F.transform("p", lambda x: x["quals"]), "").alias("qualities"), "readgroup", F.col("nfragments").cast("int").alias("nfragments"))


def can_be_fastq(columns: list[str]) -> bool:
    return bool({"name", "id"} & set(columns)) and {"bases", "qualities"} <= set(columns)


def fastq_lines(rows: DataFrame) -> DataFrame:
    """Four-line records; the name is ``id`` or else ``name``."""
    if not can_be_fastq(rows.columns):
        raise ValueError("FASTQ needs bases, qualities and a name or id")
    name = F.col("id" if "id" in rows.columns else "name").cast("string")
    return rows.select(F.concat_ws("\n", F.concat(F.lit("@"), name), "bases", F.concat(F.lit("+"), name), "qualities").alias("line"))


def delimited_lines(rows: DataFrame, sep: str = ",") -> DataFrame:
    """Lines of values; text stands in quotes, and quotes in it are doubled."""
    cell = lambda c, t: F.coalesce(F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"')) if t == "string" else F.col(c).cast("string"), F.lit(""))
    return rows.select(F.concat_ws(sep, *(cell(c, t) for c, t in rows.dtypes)).alias("line"))


def run_job(spark: SparkSession, options: JobOptions, sources: dict[str, DataFrame]) -> DataFrame:
    """Register the declared tables and run the job's statement; ``sources`` has a frame for each source and type."""
    if missing := options.missing():
        raise ValueError(f"missing options: {', '.join(missing)}")
    for t in options.tables:
        scan(t, sources[f"{t.source}.{t.kind}"]).createOrReplaceTempView(t.name)
    return spark.sql(options.values["SQL"])


def write_job(rows: DataFrame, options: JobOptions) -> None:
    """Write a job's result as text in the format that it asks for, with a header line for delimited text."""
    kind = options.values.get("FORMAT", "CSV").upper()
    if kind == "FASTQ":
        fastq_lines(rows).write.text(options.values["OUT"])
    else:
        rows.write.csv(options.values["OUT"], sep="\t" if kind == "TAB" else ",", header=True, quoteAll=True)
