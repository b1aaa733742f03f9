"""MinHash profiles, centroids and searches for near profiles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.seq import fnv1_rank


def masks(n: int) -> list[int]:
    """``n`` masks of 63 bits from a linear congruence."""
    out, x = [], 0x2545F4914F6CDD1D
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append(x >> 1)
    return out


def profiles(kmers: DataFrame, key: str, n: int) -> DataFrame:
    """``key, profile``: for each of ``n`` masks the k-mer whose FNV-1 hash, as an unsigned number, is smallest under the mask.

    One aggregation with a minimum per mask, combined before the shuffle; each different k-mer of a key is hashed once, and
    k-mers are not multiplied by masks.
    """
    hashed = kmers.select(key, "kmer").distinct().withColumn("_h", fnv1_rank("kmer"))
    mins = [F.min_by("kmer", F.col("_h").bitwiseXOR(F.lit(m))).alias(f"m{i}") for i, m in enumerate(masks(n))]
    return hashed.groupBy(key).agg(*mins).select(key, F.array(*(F.col(f"m{i}") for i in range(n))).alias("profile"))


def similarity(a: Column, b: Column) -> Column:
    """Part of the places at which two profiles agree; profiles of different length cannot be compared."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("profiles differ in length")).cast("double")).otherwise(same / F.size(a))


#: Profiles in a block, and queries that are compared with a block in one step.
BLOCK, STEP = 4096, 256


def _places(profiles: pa.ChunkedArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Profiles of one size as a matrix, and which of its values are there."""
    flat = pa.concat_arrays(profiles.chunks).flatten() if profiles.num_chunks else pa.array([], profiles.type.value_type)
    there = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, size)
    if pa.types.is_boolean(flat.type):
        flat = flat.fill_null(False).to_numpy(zero_copy_only=False).view(np.int8)
    elif pa.types.is_integer(flat.type):
        flat = flat.fill_null(0).to_numpy(zero_copy_only=False)
    else:
        flat = np.array(flat.to_pylist(), object)
    return flat.reshape(-1, size), there


def nearest(queries: DataFrame, data: DataFrame, key: str, top: int, least: int = 1) -> DataFrame:
    """``key, other, similarity``: the ``top`` nearest profiles of each query by equal places, the smallest keys of equally near ones.

    Blocks of queries meet blocks of profiles of the same size, a task compares two blocks and only its ``top`` of each query
    go on; no pair is shuffled.  Pairs that agree in fewer than ``least`` places are not returned; nulls agree with nothing.
    """
    queries, data = (df.where("size(profile) > 0").select(F.size("profile").alias("size"), key, "profile") for df in (queries, data))
    parts = [max(1, -(-df.count() // BLOCK)) for df in (queries, data)]
    block = lambda n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    one = queries.withColumn("_q", block(parts[0])).withColumn("_d", each(parts[1]))
    two = data.withColumn("_d", block(parts[1])).withColumn("_q", each(parts[0]))
    kind = dict(data.dtypes)[key]

    def compare(q: pa.Table, d: pa.Table) -> pa.Table:
        mine, others, counts = [], [], []
        if q.num_rows and d.num_rows:
            size = q.column("size")[0].as_py()
            d = d.sort_by(key)
            (a, a_there), (b, b_there) = _places(q.column("profile"), size), _places(d.column("profile"), size)
            whole = a_there.all() and b_there.all()
            # keys of both as numbers, to leave out a query's own
            numbers = pa.chunked_array([*q.column(key).chunks, *d.column(key).chunks]).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            own, theirs = numbers[: q.num_rows], numbers[q.num_rows :]
            n = d.num_rows
            for s in range(0, q.num_rows, STEP):
                same = np.zeros((min(STEP, q.num_rows - s), n), np.int64)
                for p in range(size):
                    agree = a[s : s + STEP, p, None] == b[None, :, p]
                    same += agree if whole else agree & a_there[s : s + STEP, p, None] & b_there[None, :, p]
                same[(own[s : s + STEP, None] == theirs) | (own[s : s + STEP, None] < 0) | (theirs < 0)] = -1
                rank = same * n + (n - 1 - np.arange(n))  # all different: equal places first, then the order of keys
                best = np.argpartition(rank, n - min(top, n), axis=1)[:, n - min(top, n) :]
                found = np.take_along_axis(same, best, 1)
                row, at = np.nonzero(found >= least)
                mine.append(row + s), others.append(best[row, at]), counts.append(found[row, at] / size)
        pick = lambda t, x: t.column(key).take(pa.array(np.concatenate(x) if x else [], pa.int64())).combine_chunks()
        return pa.table([pick(q, mine), pick(d, others), pa.array(np.concatenate(counts) if counts else [], pa.float64())], [key, "other", "similarity"])

    by = ["size", "_q", "_d"]
    scored = one.groupBy(*by).cogroup(two.groupBy(*by)).applyInArrow(compare, f"{key} {kind}, other {kind}, similarity double")
    w = Window.partitionBy(key).orderBy(F.desc("similarity"), "other")
    return scored.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top).drop("_r")


def closest(found: DataFrame, key: str, top: int) -> DataFrame:
    return nearest(found, found, key, top)


def centroids(kmers: DataFrame, group: str, seq: str) -> DataFrame:
    """``group, kmer, n_seq``: in how many sequences of a group each k-mer is."""
    return kmers.select(group, seq, "kmer").distinct().groupBy(group, "kmer").agg(F.count("*").alias("n_seq"))


def encode_position(tax_id: Column, offset: Column, total: Column, mul: int) -> Column:
    """A taxon and a place along its sequence as one number."""
    return (tax_id.cast("long") * mul + F.floor(offset * mul / total)).cast("long")
