"""Self-join of documents on the Jaccard similarity of their word n-grams, with a count-vector R-tree.

1.  A document becomes the set of its distinct n-gram hashes (64 bits).  Equal sets form a class and only
    one member of a class goes on; the grouping combines before the shuffle, so copies cost nothing.
2.  The hash space is cut into more slices than two linked sets may differ in (a bound that the sizes give:
    similarity s of sets of a and b elements leaves at most (1-s)(a+b)/(1+s) elements on one side only).
    So linked sets agree wholly in some slice.  Each set names its highest slices; sets that name the same
    slice contents are tied together, each task tying its own before the shuffle, so that a slice that a
    third of all sets share sends one row a batch.  Ties give clusters, between which no link can lie.
    These are the roots of the forest of trees.
3.  Clusters are laid out in order of size and coarse counts and cut into blocks of bounded size.  A set goes to its own
    block and to those pairs of blocks of its cluster whose sizes let sets link, so rows grow with the cluster's
    size times its number of blocks, and a large cluster spreads over all tasks.
4.  In a pair of blocks an R-tree of count vectors, leaves under boxes under boxes, is asked for each set's neighbours:
    summed coordinate minima bound the overlap from above, first with boxes and then with points.  What survives
    is verified by the sets themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import U64, WordCache, ascii_words, cut, forget, mix, rows_of, windows
from seqloom.llm.components import components

GROUPS = 256
FAN = 32
#: A block has so many sets at most, and so many elements unless a single set has more.
BLOCK_ROWS = 2048
BLOCK_GRAMS = 1 << 20
SALTS = 16
BITS = 1 << 22


def gram_set(text: str | None, size: int, words: WordCache) -> np.ndarray:
    """Sorted distinct hashes of the n-grams; of the whole text if it has fewer words; none without words."""
    h = words.hashes(ascii_words(text))
    if len(h) == 0:
        return h
    h = windows(h, size) if len(h) >= size else windows(h, len(h)) ^ U64(len(h))
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


class Slices:
    """Slice counts and boundaries for bands of set sizes.  A band's largest size is at most its smallest over
    the threshold, so two linked sets lie in one band or in neighbouring ones."""

    def __init__(self, percent: int, slack: float = 1.4):
        self.percent, self.low, self.parts, self.edges = percent, [1], [], {}
        while self.low[-1] < 1 << 40:
            high = self.low[-1] * 100 // percent
            self.parts.append(int(np.ceil(slack * (self.differ(high, high * 100 // percent) + 1))))
            self.low.append(high + 1)
        self.low = np.array(self.low)

    def differ(self, a: int, b: int) -> int:
        """The most elements that only one of two linked sets of these sizes has."""
        return (100 - self.percent) * (a + b) // (100 + self.percent)

    def bounds(self, band: int) -> np.ndarray:
        if band not in self.edges:
            self.edges[band] = np.array([(j << 64) // self.parts[band] for j in range(self.parts[band])], U64)
        return self.edges[band]

    def keys(self, grams: np.ndarray) -> np.ndarray:
        """For each set, the contents of its highest slices, of its own band and as a larger partner in the one below.

        Slices have a rank: their number of elements, then a hash of what they hold.  A set names one slice more than
        it may differ in from a partner.  Of two linked sets take the one whose last named rank is higher: one of its
        named slices agrees with the other's, has the same rank there, and so is named by both.
        """
        n = len(grams)
        own = int(np.searchsorted(self.low, n, "right")) - 1
        sums = np.concatenate((np.zeros(1, U64), np.cumsum(mix(grams))))
        found = []
        for band, differ in ((own, self.differ(n, n * 100 // self.percent)), (own - 1, self.differ(n, int(self.low[own]) - 1))):
            if band < 0 or differ == 0:  # then only equal sets are linked, and these are one class
                continue
            at = np.append(np.searchsorted(grams, self.bounds(band)), n)
            held = mix(mix(sums[at[1:]] - sums[at[:-1]]) + np.arange(len(at) - 1, dtype=U64) + U64(band << 32))
            rank = (np.minimum(np.diff(at), (1 << 23) - 1).astype(U64) << U64(40)) | (held >> U64(24))
            found.append(held[rank >= np.partition(rank, len(rank) - 1 - differ)[len(rank) - 1 - differ]])
        return np.concatenate(found) if found else np.empty(0, U64)


def digest(grams: np.ndarray) -> tuple[int, int]:
    """128 bits that tell a set, as two signed numbers."""
    m = mix(grams)
    both = np.array([m.sum(dtype=U64), mix(m ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64)], U64).view(np.int64)
    return int(both[0]), int(both[1])


def _describe(size: int, percent: int):
    """Batches of doc_id, row, text to a row each: size of the set, its digest, coarse counts, slice keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, slices, seen = WordCache(), Slices(percent), set()
        for batch in rows_of(batches):
            ns, digests, z, keys = [], [], [], []
            for text in batch.column("text").to_pylist():
                g = gram_set(text, size, words)
                ns.append(len(g))
                digests.append(both := digest(g))
                first = len(g) > 0 and both not in seen  # of equal sets in a task one sends its keys
                if first and len(seen) < 500_000:
                    seen.add(both)
                keys.append(slices.keys(g).view(np.int64) if first else None)
                z.append(np.minimum(np.bincount((g >> U64(60)).astype(np.int64), minlength=16), 255).astype(np.uint8).tobytes())
            hi, lo = (pa.array(x, pa.int64()) for x in zip(*digests, strict=True))
            found = [pa.array(ns, pa.int64()), hi, lo, pa.array(z, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.record_batch([batch.column("doc_id"), batch.column("row"), *found], ["doc_id", "row", "n", "hi", "lo", "z", "keys"])

    return run


def _tied(keys: np.ndarray, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys once each with their first set, and the ties of all other sets under a key to its first."""
    order = np.lexsort((sets, keys))
    keys, sets = keys[order], sets[order]
    first = np.concatenate(([True], keys[1:] != keys[:-1]))
    head = sets[np.flatnonzero(first)][np.cumsum(first) - 1]
    other = head != sets
    return keys[first], sets[first], sets[other], head[other]


def _packed_keys(buckets: int, most: int = 1_000_000):
    """Keys and the sets that name them, packed by range of keys: ``bucket, keys, sets``.  A key leaves a batch once; the
    ties of other sets in it go along, in buckets below 0."""

    def flush(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys, sets, a, b = _tied(*(np.concatenate([h[i] for h in held]) for i in (0, 1)))
        bucket = (((keys >> U64(40)) * U64(buckets)) >> U64(24)).astype(np.int64)
        start = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        end = np.append(start[1:], len(keys))
        rows = [(int(bucket[s]), keys[s:e].tobytes(), sets[s:e].tobytes()) for s, e in zip(start, end, strict=True)]
        rows += [(-1 - int(a[i] % buckets), a[i : i + 10_000].tobytes(), b[i : i + 10_000].tobytes()) for i in range(0, len(a), 10_000)]
        kinds = (pa.int64(), pa.binary(), pa.binary())
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["bucket", "keys", "sets"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in rows_of(batches):
            lists = batch.column("keys")
            size = np.where(lists.is_valid().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()), 0)
            held.append((lists.flatten().to_numpy().view(U64), np.repeat(batch.column("hi").to_numpy(), size)))
            n += int(size.sum())
            if n > most:
                yield flush(held)
                held, n = [], 0
        if n:
            yield flush(held)

    return run


def _ties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ties ``a, b`` of packed keys that come sorted by bucket."""

    def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

    last, held = None, []
    for batch in rows_of(batches, 64):
        for bucket, keys, sets in zip(*(batch.column(c).to_pylist() for c in ("bucket", "keys", "sets")), strict=True):
            if bucket < 0:
                yield out(np.frombuffer(keys, np.int64), np.frombuffer(sets, np.int64))
                continue
            if bucket != last and held:
                yield out(*_tied(*(np.concatenate(x) for x in zip(*held, strict=True)))[2:])
                held = []
            last = bucket
            held.append((np.frombuffer(keys, U64), np.frombuffer(sets, np.int64)))
    if held:
        yield out(*_tied(*(np.concatenate(x) for x in zip(*held, strict=True)))[2:])


def _blocks(most: int):
    """Number the blocks: rows come in order of cluster, size and coarse counts; a block ends when it is full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, rows, grams = TaskContext.get().partitionId() << 40, 0, 0
        for batch in batches:
            number = []
            for n in batch.column("n").to_pylist():
                if rows >= most or rows and grams + n > BLOCK_GRAMS:
                    block, rows, grams = block + 1, 0, 0
                rows, grams = rows + 1, grams + n
                number.append(block)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number, pa.int64())], names=[*batch.schema.names, "block"])

    return run


def _sets(size: int):
    """A row for each pair of blocks in which a set is wanted: ``a, b, side, cluster, node, copies, grams``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordCache()
        for batch in rows_of(batches, 256):
            rows = []
            for r in batch.to_pylist():
                grams = gram_set(r["text"], size, words)
                if digest(grams) == (r["hi"], r["lo"]):  # another text may have got the same row number
                    for pair in [{"a": r["block"], "b": r["block"]}, *(r["partners"] or [])]:
                        rows.append((pair["a"], pair["b"], int(pair["a"] != r["block"]), r["cluster"], r["node"], r["copies"], grams.tobytes()))
            for at in range(0, len(rows), 1024):
                columns = zip(*rows[at : at + 1024], strict=True)
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, SENT, strict=True)], schema=SENT)

    return run


SENT = pa.schema([(c, pa.int64()) for c in ("a", "b", "side", "cluster", "node", "copies")] + [("grams", pa.binary())])


class CountTree:
    """An R-tree over points, packed in the order in which they come.

    An element belongs to one of GROUPS groups by its hash, and a set's numbers of elements in the groups are its point.
    A node has the box of what is below it, that is the largest count of each group, and the smallest and largest
    size.  The sum of coordinate minima of a point and a box bounds every overlap with the sets in the box.
    """

    def __init__(self, points: np.ndarray, n: np.ndarray):
        self.levels = [(points, n, n)]  # box, smallest and largest size; leaves first
        while len(self.levels[-1][0]) > FAN:
            box, least, most = self.levels[-1]
            start = np.arange(0, len(box), FAN)
            self.levels.append((np.maximum.reduceat(box, start), np.minimum.reduceat(least, start), np.maximum.reduceat(most, start)))

    def near(self, point: np.ndarray, n: int, after: int, percent: int) -> np.ndarray:
        """Numbers, greater than ``after``, of the points that may be linked with this one."""
        at = np.arange(len(self.levels[-1][0]))
        for k in range(len(self.levels) - 1, -1, -1):
            box, least, most = self.levels[k]
            at = at[((at + 1) * FAN**k > after + 1) & (100 * most[at] >= percent * n) & (100 * n >= percent * least[at])]
            bound = np.minimum(point, box[at]).sum(axis=1)
            at = at[(100 + percent) * bound >= percent * (n + least[at])]
            if not len(at):
                break
            if k:
                at = (at[:, None] * FAN + np.arange(FAN)).ravel()
                at = at[at < len(self.levels[k - 1][0])]
        return at


def points(sets: list[np.ndarray]) -> np.ndarray:
    kind = np.float32 if max(map(len, sets)) < 1 << 24 else np.float64  # whole numbers, exact in either
    return np.stack([np.bincount((g & U64(GROUPS - 1)).astype(np.int64), minlength=GROUPS) for g in sets]).astype(kind)


def linked(rows: list[tuple[int, int, bytes]], first: int, percent: int) -> Iterator[tuple[int, int, int]]:
    """Links of the first ``first`` sets ``node, copies, grams`` with the others, or among all if these are all.

    Gives nodes of a forest that joins what is linked, with 0, and each linked node with the copies that it links with.
    """
    within = first == len(rows)
    if len(rows) < 2 or first == 0:
        return
    rows = sorted(rows[:first], key=lambda r: (len(r[2]), r[0])) + sorted(rows[first:], key=lambda r: (len(r[2]), r[0]))
    sets = [np.frombuffer(r[2], U64) for r in rows]
    nodes, copies, n = [r[0] for r in rows], np.array([r[1] for r in rows]), np.array([len(s) for s in sets])
    at = points(sets)
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    start, mark = np.concatenate(([0], np.cumsum(n))), np.zeros(int(flat.max()) + 1, np.uint8)
    base = 0 if within else first
    tree = CountTree(at[base:], n[base:])
    links, part = np.zeros(len(rows), np.int64), np.arange(len(rows))
    for x in range(first):
        near = tree.near(at[x], int(n[x]), x if within else -1, percent) + base
        near = near[near > x]
        if not len(near):
            continue
        mark[flat[start[x] : start[x + 1]]] = 1
        size = n[near]
        ends = np.cumsum(size)
        begins = ends - size
        common = np.add.reduceat(mark[flat[np.arange(ends[-1]) + np.repeat(start[near] - begins, size)]], begins, dtype=np.int64)
        mark[flat[start[x] : start[x + 1]]] = 0
        near = near[(100 + percent) * common >= percent * (n[x] + size)]
        if len(near):
            links[x] += copies[near].sum()
            links[near] += copies[x]
            for other in np.unique(part[near]):
                if other != part[x]:
                    yield nodes[x], nodes[near[np.flatnonzero(part[near] == other)[0]]], 0
                    part[part == other] = part[x]
    for x in np.flatnonzero(links):
        yield nodes[x], nodes[x], int(links[x])


def _verify(percent: int):
    """Links in pairs of blocks, which come one after another, each sorted by cluster and side: ``x, y, links``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(held: dict[int, tuple[int, int, bytes]], first: int) -> list[tuple[int, int, int]]:
            return list(linked(list(held.values()), first, percent))

        def out(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], ["x", "y", "links"])

        last, held, first = None, {}, 0
        for batch in rows_of(batches, 256):
            found = []
            for a, b, side, cluster, *row in zip(*(batch.column(c).to_pylist() for c in SENT.names), strict=True):
                if (a, b, cluster) != last:
                    found += links(held, first)
                    last, held, first = (a, b, cluster), {}, 0
                held.setdefault(row[0], tuple(row))  # rows that repeat doc_id and text come more than once
                first = len(held) if side == 0 else first
            if found:
                yield out(found)
        if held and (found := links(held, first)):
            yield out(found)

    return run


def _having(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` joined with ``rows`` by row.  A bitmap of BITS hashed numbers, which is broadcast and whose size is fixed,
    first drops most texts that are not asked for; the join then decides."""
    bit = F.pmod(F.xxhash64("row"), F.lit(BITS))

    def at(df: DataFrame) -> DataFrame:
        return df.withColumn("_word", F.floor(bit / 64)).withColumn("_bit", (bit % 64).cast("int"))

    bitmap = at(rows.select("row")).groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
    some = at(docs).join(F.broadcast(bitmap), "_word").where("getbit(_bits, _bit) = 1").drop("_word", "_bit", "_bits")
    return some.join(rows, "row")


def _partners(blocks: DataFrame, percent: int) -> DataFrame:
    """``block, partners``: the pairs with other blocks of the same cluster whose sizes let sets link."""
    sizes = blocks.groupBy("cluster", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    one = sizes.select("cluster", F.col("block").alias("a"), F.col("least").alias("least_a"), F.col("most").alias("most_a"), salts)
    two = sizes.select("cluster", F.col("block").alias("b"), "least", "most", F.pmod(F.hash("block"), F.lit(SALTS)).alias("salt"))
    near = f"a < b AND 100 * most >= {percent} * least_a AND 100 * most_a >= {percent} * least"
    pairs = one.join(two, ["cluster", "salt"]).where(near).select("a", "b").distinct()
    sides = F.explode(F.array("a", "b")).alias("block")
    return pairs.select(sides, F.struct("a", "b").alias("pair")).groupBy("block").agg(F.collect_list("pair").alias("partners"))


def ngram_jaccard_join(docs: DataFrame, size: int = 4, percent: int = 85, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, n_links``.

    Words are runs of other than ASCII white space, A-Z lower-cased.  A document's set holds its distinct
    ``size``-word shingles, or its whole word sequence if shorter.  Two documents link when
    ``100 * intersection >= percent * union``; ``component_id`` is the smallest doc_id reachable by links and
    ``n_links`` the number of other documents linked with.

    Null text is as empty: the set is empty, nothing is linked, the component is the document itself.  Every row is a
    document of its own, also if it repeats a doc_id with the same or with another text.  A null doc_id links like any
    other and counts for no component_id, which is null only if all documents of a component have none.  Ties do
    not arise: links and smallest numbers depend on no order.  Long texts take part whole.  An empty table gives no
    rows.  Columns beyond doc_id and text are not looked at.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    described = cut(docs.mapInArrow(_describe(size, percent), "doc_id long, row long, n long, hi long, lo long, z binary, keys array<long>"))
    facts = cut(described.drop("keys"))
    same = facts.where("n > 0").groupBy("hi", "lo")
    classes = same.agg(F.min("doc_id").alias("first"), F.min("row").alias("row"), F.count("*").alias("copies"), F.min("n").alias("n"), F.min("z").alias("z"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))
    buckets = max(64, (classes.agg(F.sum("n")).first()[0] or 0) // 1_000_000)
    packed = described.where("keys IS NOT NULL").select("hi", "keys").mapInArrow(_packed_keys(buckets), "bucket long, keys binary, sets binary")
    ties = packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_ties, "a long, b long")
    clusters = components(ties).withColumnsRenamed({"node": "hi", "label": "cluster"})
    forget(described)
    members = cut(classes.drop("first").join(clusters, "hi"))
    order = ["cluster", "n", "z", "node"]
    numbered = members.repartitionByRange(*order).sortWithinPartitions(*order).select("node", "row", "hi", "lo", "cluster", "copies", "n")
    blocks = cut(numbered.mapInArrow(_blocks(block_rows), "node long, row long, hi long, lo long, cluster long, copies long, n long, block long"))
    wanted = blocks.join(_partners(blocks, percent), "block", "left")
    sent = _having(docs, wanted).mapInArrow(_sets(size), "a long, b long, side long, cluster long, node long, copies long, grams binary")
    sorted_pairs = sent.repartition("a", "b").sortWithinPartitions("a", "b", "cluster", "side", "node")
    found = cut(sorted_pairs.mapInArrow(_verify(percent), "x long, y long, links long"))
    forget(members, blocks)
    label = components(found.where("links = 0").select(F.col("x").alias("a"), F.col("y").alias("b")))
    links = found.where("links > 0").groupBy(F.col("x").alias("node")).agg(F.sum("links").alias("links"))
    least = label.join(classes.select("node", "first"), "node").groupBy("label").agg(F.min("first").alias("component"))
    label = label.join(least, "label").select("node", "component", F.lit(True).alias("joined"))
    component = F.when(F.col("joined"), F.col("component")).otherwise(F.col("first")).alias("component")
    classes = classes.join(label, "node", "left").join(links, "node", "left")
    classes = classes.select("hi", "lo", component, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    some = F.col("n") > 0
    return facts.join(classes, ["hi", "lo"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(some, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(some, F.col("links")).otherwise(F.lit(0)).alias("n_links"),
    )
