"""Phrase collocation mining: phrases counted in HAT-tries, scored against their best cut.

Texts are read once for words, and once more for each depth of ``depths``.  A task holds the windows of words that start
at each place in a trie: word ids lead to hash containers that hold the rest of the window, and a container that grows
too large bursts into a node with a container for each next word.  A full trie gives whole subtrees away, largest
first, as runs sorted by word ids, cut by the hash of their prefix; the runs of a prefix partition are merged
into counts of all phrases of the new lengths.

A phrase that occurs ``least`` times has only parts that do.  So windows end where a word, or a phrase of the depth before,
is not frequent by a bitmap of fixed size.  Strange bits let more windows through and change no count.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import U64, cut, mix, rows_of, windows

#: Bits of the bitmap of frequent words or phrases.
BITS = 24
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: The marks and line ends that part pieces, and A-Z, in one table.
_MARKED = bytearray(LOWER)
for _c in b".,;:!?\x0a\x0b\x0c\x0d":
    _MARKED[_c] = ord(".")
_MARKED = bytes(_MARKED)
#: Bytes of texts that are cut into words at a time.
HELD = 1 << 22


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text, with ``.`` between and behind its pieces; a long text in several lists that end with a piece."""
    marked, at = text.translate(_MARKED) + b".", 0
    while at < len(marked):
        end = len(marked) if len(marked) - at <= HELD else (marked.rfind(b".", at, at + HELD) + 1 or marked.index(b".", at) + 1)
        yield marked[at:end].replace(b".", b" . ").split()
        at = end


class Ids(dict):
    """Numbers of the words of one language: 64-bit hashes; the mark between pieces is 0."""

    def __init__(self, lang: str):
        super().__init__()
        self.seed = xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"))

    def __missing__(self, word: bytes) -> int:
        value = self[word] = 0 if word == b"." else xxhash.xxh3_64_intdigest(word, self.seed) or 1
        return value


def by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[list[bytes]]]]:
    """Lists of words of one language, a few at a time."""
    for batch in rows_of(batches, 512):
        held: dict[str, list] = {}
        size = 0
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            text = text or b""
            for words in tokens(text):
                held.setdefault(lang, []).append(words)
                size += min(len(text), HELD)
                if size > HELD:
                    yield from held.items()
                    held, size = {}, 0
        yield from held.items()


def _count_words(most: int = 400_000):
    """``id, lang, word, f`` of the words of a task, as many rows for a word as the counter was emptied."""

    def flush(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, c in counts.items():
            c.pop(b".", None)
            ids, words = Ids(lang), list(c)
            for at in range(0, len(words), 50_000):
                some = words[at : at + 50_000]
                numbers = pa.array(np.array([ids[w] for w in some], U64).view(np.int64))
                yield pa.record_batch([numbers, pa.array([lang] * len(some), pa.string()), pa.array(some, pa.binary()), pa.array([c[w] for w in some], pa.int64())], ["id", "lang", "word", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for lang, texts in by_language(batches):
            own = counts.setdefault(lang, Counter())
            for words in texts:
                own.update(words)
            if sum(map(len, counts.values())) > most:
                yield from flush(counts)
                counts.clear()
        yield from flush(counts)

    return run


class HatTrie:
    """Counts of windows of ``depth`` word ids; shorter ones end with zeros.

    The first id leads to a hash container of the other ids; a container of more than ``burst`` windows bursts
    into containers by the next id, as long as two ids or more are left in it.
    """

    def __init__(self, depth: int, burst: int = 8_192):
        self.depth, self.burst = depth, burst
        self.root: dict[int, Counter | dict] = {}
        self.sizes: Counter = Counter()

    def _keys(self, rest: np.ndarray) -> list:
        """The rest of each window as a key: an id, or the bytes of several."""
        if rest.shape[1] == 1:
            return rest[:, 0].tolist()
        return np.ascontiguousarray(rest).view(f"V{8 * rest.shape[1]}")[:, 0].tolist()

    def _rest(self, keys: list, width: int) -> np.ndarray:
        return np.array(keys, U64).reshape(-1, 1) if width == 1 else np.frombuffer(b"".join(keys), U64).reshape(-1, width)

    def _add(self, node: dict, rows: np.ndarray, counts: np.ndarray | None, sizes: Counter | None) -> int:
        """Put rows below a node by their first id; the number of windows that are new."""
        order = np.argsort(rows[:, 0], kind="stable")
        rows = rows[order]
        first = np.flatnonzero(np.concatenate(([True], rows[1:, 0] != rows[:-1, 0])))
        keys = self._keys(rows[:, 1:])
        counts = None if counts is None else counts[order].tolist()
        new = 0
        for word, a, b in zip(rows[first, 0].tolist(), first.tolist(), [*first[1:].tolist(), len(rows)], strict=True):
            held = node.get(word)
            if held is None:
                held = node[word] = Counter()
            if isinstance(held, Counter):
                before = len(held)
                if counts is None:
                    held.update(keys[a:b])
                else:
                    for key, n in zip(keys[a:b], counts[a:b], strict=True):
                        held[key] += n
                more = len(held) - before
                if len(held) > self.burst and rows.shape[1] > 2:
                    node[word] = burst = {}
                    self._add(burst, self._rest(list(held), rows.shape[1] - 1), np.fromiter(held.values(), np.int64, len(held)), None)
            else:
                more = self._add(held, rows[a:b, 1:], None if counts is None else np.array(counts[a:b]), None)
            new += more
            if sizes is not None:
                sizes[word] += more
        return new

    def add(self, rows: np.ndarray) -> None:
        """Count windows, of which each has two ids at least."""
        if len(rows):
            self._add(self.root, rows, None, self.sizes)

    def __len__(self) -> int:
        return self.sizes.total()

    def _collect(self, node: Counter | dict, prefix: tuple, out: list) -> None:
        if isinstance(node, Counter):
            rest = self._rest(list(node), self.depth - len(prefix))
            rows = np.empty((len(rest), self.depth), U64)
            rows[:, : len(prefix)], rows[:, len(prefix) :] = prefix, rest
            out.append((rows, np.fromiter(node.values(), np.int64, len(node))))
        else:
            for word, below in node.items():
                self._collect(below, (*prefix, word), out)

    def spill(self, down_to: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Take whole subtrees out, largest first, until ``down_to`` windows are left; their windows and counts."""
        out: list = [(np.empty((0, self.depth), U64), np.empty(0, np.int64))]
        left = len(self)
        for word, size in self.sizes.most_common():
            if left <= down_to:
                break
            self._collect(self.root.pop(word), (word,), out)
            left -= size
            del self.sizes[word]
        return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def merged(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows in order, once each, with the sums of their counts."""
    if len(rows) < 2:
        return rows, counts
    order = np.lexsort(rows.T[::-1])
    rows, counts = rows[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]).any(1))))
    return rows[first], np.add.reduceat(counts, first)


def _count_windows(before: int, depth: int, parts: int, bitmap: Broadcast, most: int):
    """Sorted runs ``part, rows, counts`` of the windows of a task; ``before`` is the length of the phrases in the bitmap.

    A part holds windows by the hash of their first ``before + 1`` words, the shortest phrase that is still to count.
    """

    def runs(rows: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        part = (prefixes(rows, before + 1) % U64(parts)).astype(np.int64)
        order = np.lexsort((*rows.T[::-1], part))
        rows, counts, part = rows[order], counts[order], part[order]
        first = np.flatnonzero(np.concatenate(([len(part) > 0], part[1:] != part[:-1])))
        for at in range(0, len(first), 256):
            some = [*first[at : at + 256].tolist(), first[at + 256] if at + 256 < len(first) else len(part)]
            pieces = list(zip(some[:-1], some[1:], strict=True))
            yield pa.record_batch([pa.array(part[some[:-1]]), pa.array([rows[a:b].tobytes() for a, b in pieces], pa.binary()), pa.array([counts[a:b].tobytes() for a, b in pieces], pa.binary())], ["part", "rows", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, bits, ids = HatTrie(depth), np.frombuffer(bitmap.value, np.uint8), {}
        for lang, texts in by_language(batches):
            if sum(map(len, ids.values())) > 400_000:
                ids.clear()
            own = ids.setdefault(lang, Ids(lang))
            trie.add(windows_of(np.fromiter((own[w] for words in texts for w in words), U64), before, depth, bits))
            if len(trie) > most:
                yield from runs(*trie.spill(most // 2))
        yield from runs(*trie.spill())

    return run


def prefixes(rows: np.ndarray, size: int) -> np.ndarray:
    """A hash of the first ids of each row, that of ``windows``."""
    h = np.zeros(len(rows), U64)
    for i in range(size):
        h = mix(h * U64(0x9E3779B97F4A7C15) + rows[:, i])
    return h


def windows_of(ids: np.ndarray, before: int, depth: int, bits: np.ndarray) -> np.ndarray:
    """The windows of more than ``before`` ids that start at each place and end before a 0, at ``depth`` ids, or where a
    phrase of ``before`` ids is not in the bitmap."""
    h = windows(ids, before) & U64((1 << BITS) - 1)
    known = (bits[(h >> U64(3)).astype(np.int64)] >> (h & U64(7)).astype(np.uint8)) & 1 == 1
    gone = np.flatnonzero(ids == 0)
    for i in range(before):
        at = gone - i
        known[at[(at >= 0) & (at < len(known))]] = False
    start = np.flatnonzero(known[:-1] & known[1:])
    rows = np.zeros((len(start), depth), U64)
    for i in range(before + 1):
        rows[:, i] = ids[start + i]
    alive = np.arange(len(start))
    for i in range(before + 1, depth):
        at = start[alive] + i - before + 1
        alive = alive[(at < len(known)) & known[np.minimum(at, len(known) - 1)]]
        rows[alive, i] = ids[start[alive] + i]
    return rows


def _merge_runs(before: int, depth: int, least: int, most: int = 2_000_000):
    """``ids, size, f, h`` of the phrases of ``before + 1`` to ``depth`` words that occur ``least`` times, from runs in the order of their parts."""

    def phrases(rows: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows, counts = merged(rows, counts)
        for size in range(before + 1, depth + 1):
            own = rows[:, size - 1] != 0
            some, n = rows[own][:, :size], counts[own]
            if not len(some):
                return
            first = np.flatnonzero(np.concatenate(([True], (some[1:] != some[:-1]).any(1))))
            some, n = some[first], np.add.reduceat(n, first)
            some, n = some[n >= least], n[n >= least]
            if len(some):
                ids = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * size, pa.int32()), pa.array(some.reshape(-1).view(np.int64)))
                yield pa.record_batch([ids, pa.array([size] * len(some), pa.int32()), pa.array(n), pa.array(prefixes(some, size).view(np.int64))], ["ids", "size", "f", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, counts, waiting = None, [], [], 0
        for batch in batches:
            for p, r, c in zip(*(batch.column(x).to_pylist() for x in ("part", "rows", "counts")), strict=True):
                if p != part:
                    if held:
                        yield from phrases(np.concatenate(held), np.concatenate(counts))
                    part, held, counts, waiting = p, [], [], 0
                held.append(np.frombuffer(r, U64).reshape(-1, depth))
                counts.append(np.frombuffer(c, np.int64))
                waiting += len(held[-1])
                if waiting > most:  # only what differs stays
                    rows, n = merged(np.concatenate(held), np.concatenate(counts))
                    held, counts, waiting = [rows], [n], 0
        if held:
            yield from phrases(np.concatenate(held), np.concatenate(counts))

    return run


def _bitmap(hashes: DataFrame) -> Broadcast:
    """A bitmap of 2**BITS bits, from the column ``h``; of 2 MB whatever the table's size."""
    bit = F.col("h").bitwiseAND(F.lit((1 << BITS) - 1))
    words = hashes.groupBy(F.shiftright(bit, 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(h & 63 AS INT))")).alias("bits")).toPandas()
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[words["at"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return hashes.sparkSession.sparkContext.broadcast(out.astype("<i8").tobytes())


def count_phrases(docs: DataFrame, least: int = 100, depths: tuple[int, ...] = (2, 5), most: int = 600_000, part_words: int = 2_000_000) -> tuple[DataFrame, DataFrame]:
    """``words``: ``id, lang, word, f`` of all words, and ``phrases``: ``ids, size, f, h`` of all that occur ``least`` times.

    ``depths`` rises to the longest phrase; more steps read the texts more often and hold fewer windows.  ``most``: windows
    in a task's trie.  ``part_words``: there is a prefix partition for so many words of the texts.
    """
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").cast("binary").alias("text"))
    words = cut(rows.mapInArrow(_count_words(), "id long, lang string, word binary, f long").groupBy("id", "lang", "word").agg(F.sum("f").alias("f")))
    total = words.agg(F.sum("f")).first()[0] or 0
    parts = int(total // part_words + 1) * 16
    sure = words.where(F.col("f") >= least)
    first = sure.select("id").mapInArrow(_chained, "h long")
    phrases, before = None, 1
    for depth in depths:
        bits = _bitmap(first)
        runs = rows.mapInArrow(_count_windows(before, depth, parts, bits, most), "part long, rows binary, counts binary")
        found = cut(runs.repartition("part").sortWithinPartitions("part").mapInArrow(_merge_runs(before, depth, least), "ids array<long>, size int, f long, h long"))
        phrases = found if phrases is None else phrases.unionByName(found)
        first, before = found.where(F.col("size") == depth).select("h"), depth
    return words, phrases


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash that ``windows`` gives to single words."""
    for batch in batches:
        ids = batch.column("id").to_numpy().view(U64)
        yield pa.record_batch([pa.array(windows(ids, 1).view(np.int64))], ["h"])


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, absorb_percent: int = 100, depths: tuple[int, ...] | None = None) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases of 2 to ``longest`` words.

    A-Z are lower-cased, ``[.,;:!?\\x0A-\\x0D]`` part pieces and spaces and tabs part words; phrases lie within pieces.  ``n``: words of the
    language; ``a, l, r``: occurrences of the phrase and of the two parts of its lowest-scoring cut, the first of equal ones;
    ``score``: floor(1000 * a * n / (l * r)).  A phrase inside a longer one that occurs ``absorb_percent`` of its own
    times is dropped.  Order: score, then a, falling, then the phrase's bytes.

    Null text is empty; a null language is ``und``, as one that is called so; rows that repeat count again; an empty table, or
    one without frequent phrases, gives no rows; other columns are not looked at.  Word ids are 64-bit hashes.
    """
    words, phrases = count_phrases(docs, least, depths or tuple(sorted({2, longest})))
    known = words.where(F.col("f") >= least)
    count = lambda name: phrases.select("ids", "f").unionByName(known.select(F.array("id").alias("ids"), "f")).select(F.col("ids").alias(name), F.col("f").alias(f"f_{name}"))
    subs = F.expr("flatten(transform(sequence(2, size - 1), s -> transform(sequence(1, size - s + 1), i -> slice(ids, i, s))))")
    longer = phrases.where("size > 2").select("f", F.explode(subs).alias("ids")).groupBy("ids").agg(F.max("f").alias("f_longer"))
    left = phrases.join(longer, "ids", "left").where(F.col("f_longer").isNull() | (100 * F.col("f_longer") < absorb_percent * F.col("f"))).select("ids", "size", F.col("f").alias("a"))
    cuts = left.select("ids", "size", "a", F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    cuts = cuts.withColumn("first", F.expr("slice(ids, 1, k)")).withColumn("rest", F.expr("slice(ids, k + 1, size - k)"))
    both = cuts.join(count("first"), "first").join(count("rest"), "rest")
    sizes = words.groupBy("lang").agg(F.sum("f").alias("n"))
    told = both.join(known.select(F.col("id").alias("head"), "lang"), F.element_at("ids", 1) == F.col("head")).join(sizes, "lang")
    score = F.expr("CAST((CAST(1000 AS DECIMAL(4,0)) * CAST(a AS DECIMAL(15,0)) * CAST(n AS DECIMAL(19,0))) DIV (CAST(f_first AS DECIMAL(19,0)) * CAST(f_rest AS DECIMAL(19,0))) AS BIGINT)")
    best = told.withColumn("score", score).groupBy("lang", "ids", "a", "n").agg(F.min(F.struct("score", "k", F.col("f_first").alias("l"), F.col("f_rest").alias("r"))).alias("m"))
    at = best.select("lang", "ids", "a", "n", "m.*").select("*", F.posexplode("ids").alias("place", "id"))
    spelt = at.join(known.select("id", "word"), "id").groupBy("lang", "ids", "a", "n", "score", "l", "r").agg(F.array_sort(F.collect_list(F.struct("place", F.col("word").cast("string").alias("word")))).alias("w"))
    rows = spelt.select("lang", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("phrase"), "a", "l", "r", "n", "score")
    # a language's rows meet in one task only once each of 64 parts of them has kept no more than ``top``
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    some = rows.withColumn("_s", F.xxhash64("phrase") % 64).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_s").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same rows as SQL of another engine, which counts every phrase of every length.
SQL = r"""WITH p AS (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM (SELECT coalesce(lang, 'und') AS lang, text FROM documents)),
  w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
  n AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM w GROUP BY lang),
  f AS (SELECT lang, size, phrase, count(*) AS f FROM (SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase FROM w, range(1, 6) s(size) WHERE len(w) >= size) GROUP BY ALL HAVING count(*) >= 100),
  c AS (SELECT lang, size, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE size > 1),
  longer AS (SELECT lang, sub, max(a) AS a FROM (SELECT lang, a, unnest(flatten(list_transform(range(2, size), lambda s: list_transform(range(1, size - s + 2), lambda i: array_to_string(w[i:i + s - 1], ' '))))) AS sub FROM c WHERE size > 2) GROUP BY ALL),
  cuts AS (SELECT c.lang, c.phrase, c.a, k, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k + 1:size], ' ') AS rest FROM c LEFT JOIN longer o ON o.lang = c.lang AND o.sub = c.phrase, range(1, 5) t(k) WHERE k < size AND (o.a IS NULL OR 100 * o.a < 100 * c.a)),
  scored AS (SELECT cuts.lang, cuts.phrase, cuts.a, k, l.f AS l, r.f AS r, n.n, CAST(1000 AS HUGEINT) * cuts.a * n.n // (CAST(l.f AS HUGEINT) * r.f) AS score FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = first JOIN f r ON r.lang = cuts.lang AND r.phrase = rest JOIN n ON n.lang = cuts.lang),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS t FROM scored) WHERE t = 1)
  SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM best) WHERE rank <= 2000"""
