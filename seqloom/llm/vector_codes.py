"""Vector code compression: product quantization with exact integer arithmetic and norm-of-sum bounds.

Vectors become integers and are cut into parts; each part position has a codebook, which rounds of assignment and
averaging refine.  A vector keeps, for each part and group of codebook entries, a lower bound of its distance to the
group's entries other than its own, and the round of that bound.  All rounds' codebooks are kept, so a bound of an
earlier round holds now less the net way that an entry has gone since, which is never more than the sum of its ways
round by round.  A group is scanned again, exactly, only if its bound does not rule it out.

The driver sees codebooks and sums of parts by entry: numbers of a size that parameters fix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import cut, forget, rows_of

#: Components beyond this are held as this, so that sums of squares stay exact.
LARGEST = 1 << 26
#: Entries of a codebook that share a lower bound.
GROUP = 16
#: Relative room for rounding in the bounds, which are kept in 32 bits.
ROOM = 1e-6


def squared(rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all entries."""
    largest = max(int(np.abs(rows).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * largest * largest * max(1, rows.shape[1]) < 1 << 53:  # exact in doubles
        a, b = rows.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None]).astype(np.int64)
    out = np.empty((len(rows), len(entries)), np.int64)
    for j, e in enumerate(entries):
        out[:, j] = ((rows - e) ** 2).sum(1)
    return out


class Rounds:
    """The codebooks of all rounds so far, ``(round, part, entry, position)``, and the ways between them."""

    def __init__(self, history: np.ndarray):
        self.history, self.now = history, len(history) - 1
        self.parts, self.entries = history.shape[1], history.shape[2]
        self.groups = -(-self.entries // GROUP)
        ways = np.sqrt(((history - history[-1]) ** 2).sum(3, dtype=np.float64)) * (1 + ROOM)
        padded = np.zeros((len(history), self.parts, self.groups * GROUP))
        padded[:, :, : self.entries] = ways
        #: the furthest net way of a group's entries since each round
        self.ways = padded.reshape(len(history), self.parts, self.groups, GROUP).max(3)

    def assign(self, part: int, rows: np.ndarray, own: np.ndarray | None, bound: np.ndarray | None, stamp: np.ndarray | None):
        """Nearest entries of rows of one part, squared distances, and the bounds and their rounds; ``own`` None: nothing is known.

        Returns the number of scanned groups, too.
        """
        book, m = self.history[-1, part], len(rows)
        if own is None:
            own, bound = np.zeros(m, np.int64), np.full((m, self.groups), -1.0, np.float32)
            stamp = np.full((m, self.groups), self.now, np.uint8)
        best = ((rows - book[own]) ** 2).sum(1)
        old, old_distance = own.copy(), best.copy()
        low = bound - np.take_along_axis(self.ways[:, part], stamp.astype(np.int64), 0) if m else bound
        near = low <= (np.sqrt(best) * (1 + ROOM))[:, None]
        own, bound, stamp = own.copy(), bound.copy(), stamp.copy()
        seconds = {}
        for g in range(self.groups):
            at = np.flatnonzero(near[:, g])
            if not len(at):
                continue
            lo = g * GROUP
            d = squared(rows[at], book[lo : lo + GROUP])
            j = d.argmin(1)  # the first of equal ones
            first = d[np.arange(len(at)), j]
            better = (first < best[at]) | ((first == best[at]) & (lo + j < own[at]))
            own[at[better]], best[at[better]] = lo + j[better], first[better]
            seconds[g] = at, d
        for g, (at, d) in seconds.items():  # bounds leave a row's own entry out
            mine = own[at] - g * GROUP
            inside = (mine >= 0) & (mine < d.shape[1])
            d[np.flatnonzero(inside), mine[inside]] = np.iinfo(np.int64).max
            bound[at, g] = np.sqrt(d.min(1).astype(np.float64)) * (1 - ROOM)
            stamp[at, g] = self.now
        moved = np.flatnonzero(own != old)
        group = old[moved] // GROUP
        kept = ~near[moved, group]  # the group it left was not scanned: its bound now holds for the entry that was left, too
        moved, group = moved[kept], group[kept]
        bound[moved, group] = np.minimum(low[moved, group], np.sqrt(old_distance[moved]) * (1 - ROOM)) * (1 - ROOM)
        stamp[moved, group] = self.now
        return own, best, bound, stamp, int(near.sum())


_STATE = "vec_id long, label string, v binary, codes binary, bounds binary, stamps binary, error long"


def _assign(history: Broadcast):
    """State rows with codes, bounds and errors of the newest round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rounds = Rounds(history.value)
        parts, groups, width = rounds.parts, rounds.groups, history.value.shape[3]
        for batch in rows_of(batches, 2048):
            m = batch.num_rows
            v = np.frombuffer(b"".join(batch.column("v").to_pylist()), np.int32).reshape(m, parts, width).astype(np.int64)
            codes, bounds, stamps = np.zeros((m, parts), np.uint8), np.zeros((m, parts, groups), np.float32), np.zeros((m, parts, groups), np.uint8)
            error = np.zeros(m, np.int64)
            known = batch.column("codes").null_count == 0
            if known:
                old = [np.frombuffer(b"".join(batch.column(c).to_pylist()), kind).reshape(shape) for c, kind, shape in (("codes", np.uint8, codes.shape), ("bounds", np.float32, bounds.shape), ("stamps", np.uint8, stamps.shape))]
            for p in range(parts):
                before = (old[0][:, p].astype(np.int64), old[1][:, p], old[2][:, p]) if known else (None, None, None)
                own, distance, bounds[:, p], stamps[:, p], _ = rounds.assign(p, v[:, p], *before)
                codes[:, p] = own
                error += distance
            packed = [pa.array([row.tobytes() for row in x], pa.binary()) for x in (codes, bounds, stamps)]
            yield pa.record_batch([*(batch.column(c) for c in ("vec_id", "label", "v")), *packed, pa.array(error)], [x.split()[0] for x in _STATE.split(", ")])

    return run


def _sums(parts: int, width: int, entries: int):
    """``part, entry, count, s0, s1, ...``: sums of the components of a task's parts by entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in rows_of(batches, 4096):
            v = np.frombuffer(b"".join(batch.column("v").to_pylist()), np.int32).reshape(-1, width)
            at = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(-1, parts).astype(np.int64) + np.arange(parts) * entries
            at = at.reshape(-1)
            order = np.argsort(at, kind="stable")
            first = np.flatnonzero(np.concatenate(([True], np.diff(at[order]) != 0)))
            total[at[order][first]] += np.add.reduceat(v[order].astype(np.int64), first, 0)
            count += np.bincount(at, minlength=len(count))
        used = np.flatnonzero(count)
        yield pa.record_batch([pa.array(used // entries), pa.array(used % entries), pa.array(count[used]), *(pa.array(total[used, i]) for i in range(width))], ["part", "entry", "count", *(f"s{i}" for i in range(width))])

    return run


def prepared(vectors: DataFrame, parts: int, scale: int) -> DataFrame:
    """``vec_id, label, n, v``: kept vectors as packed integers of their ``n`` components."""
    x = F.col("embedding")
    whole = F.transform(x, lambda c: F.greatest(F.least(F.floor(c.cast("double") * scale), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int"))
    good = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    rows = vectors.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.size(x).alias("n"), whole.alias("x"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 4096):
            x = batch.column("x")
            flat, at = x.flatten().to_numpy(zero_copy_only=False).astype(np.int32), np.concatenate(([0], np.cumsum(batch.column("n").to_numpy())))
            packed = pa.array([flat[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
            yield pa.record_batch([batch.column("vec_id"), batch.column("label"), batch.column("n"), packed], ["vec_id", "label", "n", "v"])

    return rows.where((F.col("n") > 0) & (F.col("n") % parts == 0)).mapInArrow(pack, "vec_id long, label string, n int, v binary")


def train_codes(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, label, codes, error`` of every kept vector (codes: a byte a part), and the codebooks ``(part, entry, position)``.

    Codebooks begin with the parts of the smallest vec_ids; a round assigns every part to its nearest entry, the
    first of equal ones, and moves entries to the floored mean of their parts; after the rounds parts are assigned again.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code is a byte: 1 to 256 entries")
    spark = vectors.sparkSession
    ready = cut(prepared(vectors, parts, scale))
    first = ready.groupBy("vec_id").agg(F.min(F.struct("v", "n")).alias("m")).orderBy(F.asc_nulls_last("vec_id")).limit(entries).select("m.*").collect()
    if not first:
        return ready.select("vec_id", "label", F.col("v").alias("codes"), F.lit(0).cast("long").alias("error")), np.empty((parts, 0, 0), np.int64)
    n = first[0]["n"]
    book = np.array([np.frombuffer(x["v"], np.int32) for x in first if x["n"] == n], np.int64).reshape(-1, parts, n // parts).transpose(1, 0, 2)
    history = book[None].copy()
    unknown = [F.lit(None).cast(kind).alias(name) for name, kind in (x.split() for x in _STATE.split(", ")[3:])]
    state = ready.where(F.col("n") == n).select("vec_id", "label", "v", *unknown)
    for turn in range(rounds + 1):
        known = spark.sparkContext.broadcast(history)
        state, before = cut(state.mapInArrow(_assign(known), _STATE)), state
        forget(before, None if turn else ready)
        if turn == rounds:
            break
        width = n // parts
        names = [f"s{i}" for i in range(width)]
        rows = state.mapInArrow(_sums(parts, width, book.shape[1]), "part long, entry long, count long, " + ", ".join(f"{s} long" for s in names))
        book = book.copy()
        for row in rows.groupBy("part", "entry").agg(F.sum("count").alias("count"), *(F.sum(s).alias(s) for s in names)).collect():  # a row an entry
            book[row["part"], row["entry"]] = [row[s] // row["count"] for s in names]
        history = np.concatenate((history, book[None]))
    return state.select("vec_id", "label", "codes", "error"), book


def digest(book: np.ndarray) -> str:
    """SHA-256, in lower-case hex, of all entries' components as decimal numbers with commas between."""
    return hashlib.sha256(",".join(map(str, book.reshape(-1).tolist())).encode()).hexdigest()


def compress_vectors(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every kept vector.

    Vectors go that are null or hold null, NaN or an infinite component; so do vectors without components, whose
    length is no multiple of ``parts``, or is not that of the smallest kept vec_id.  A component x is floor(1024 * x), held within 2**26.  A vec_id that
    repeats is a row each time and begins one entry, its smallest vector in the order of its bytes.  A null vec_id
    comes last.  With fewer vec_ids than ``entries`` the codebooks are as short.  Null labels are one label; an empty table gives no rows; other columns are not looked at.
    """
    state, book = train_codes(vectors, parts, entries, rounds, scale)
    rows = state.select("vec_id", "label", F.lower(F.hex("codes")).alias("code"), "error")
    by_label = rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    joined = rows.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(book)).alias("codebooks_sha256"))


def _sql(rounds: int = 4) -> str:
    """The same rows as SQL of another engine, a join of all components with all entries in each round."""
    rows = ["k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, embedding AS x, CAST(len(embedding) AS INTEGER) AS n FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0)"]
    rows.append("v AS MATERIALIZED (SELECT rid, (i - 1) // (n // 4) AS part, (i - 1) % (n // 4) AS pos, CAST(floor(1024 * CAST(x[i] AS DOUBLE)) AS BIGINT) AS c FROM (SELECT rid, n, x, unnest(range(1, n + 1)) AS i FROM k))")
    rows.append("e0 AS MATERIALIZED (SELECT rid - 1 AS entry, part, pos, c FROM v WHERE rid <= 256)")
    for r in range(rounds + 1):
        rows.append(f"d{r} AS MATERIALIZED (SELECT v.rid, v.part, e.entry, CAST(sum((v.c - e.c) * (v.c - e.c)) AS BIGINT) AS d FROM v JOIN e{r} e USING (part, pos) GROUP BY ALL)")
        rows.append(f"a{r} AS MATERIALIZED (SELECT rid, part, min(d * 256 + entry) % 256 AS entry, min(d) AS d FROM d{r} GROUP BY ALL)")
        if r < rounds:
            rows.append(f"m{r} AS (SELECT a.part, a.entry, v.pos, CAST(floor(CAST(sum(v.c) AS DOUBLE) / count(*)) AS BIGINT) AS c FROM v JOIN a{r} a USING (rid, part) GROUP BY ALL)")
            rows.append(f"e{r + 1} AS MATERIALIZED (SELECT e.entry, e.part, e.pos, coalesce(m.c, e.c) AS c FROM e{r} e LEFT JOIN m{r} m USING (part, entry, pos))")
    rows.append(f"s AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, pos)) AS h FROM e{rounds})")
    rows.append(f"t AS (SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY rid)")
    return "WITH " + ",\n  ".join(rows) + "\n  SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM k JOIN t USING (rid), s"


SQL = _sql()
