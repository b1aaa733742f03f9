"""Benchmark decontamination with SimHash fingerprints of item-sized windows, with DataFrame functions only.

Words are runs of letters and digits in lower case.  Item and window are bags of their five-word shingles, and a window
has as many words as the item.  The similarity is that of the bags weighted by how often a shingle occurs: the sum of
smaller counts over the sum of larger counts.

1.  A window that is similar enough lacks at most a ninth (for 0.8) of the item's shingles.  So of any so many shingles
    and one more, its anchors, it has one, at whatever place.  Two bitmaps of fixed size, of the anchors' words and of the
    anchors, are tested in the scan; texts without an anchor end there.  All item-sized windows that hold an anchor get
    fingerprints; no other can match.
2.  A window's fingerprint has 64 bits, each the sign of a sum over shingle hashes.  A fingerprint is cut into BLOCKS blocks.
    Two fingerprints within ``RADIUS`` bits have a block in which they differ in at most ``RADIUS // BLOCKS`` bits; the index of
    items holds all block values so near, so an equi-join on length and blocks misses none within the radius and brings
    about a fourth of the windows and items of equal length together.
3.  Pairs within the radius are verified by the exact similarity.  Only places travel to the index and back; the words
    of a window are cut from the text where they are needed, and a text is cut into words once.

Fingerprints of bags with similarity just at 0.8 differ in 9 to 10 bits of 64 in the mean; measured over 20,000 random bags
for each of nine sizes from 8 to 200 shingles, at most 1 in 1,000 differ in more than 19, and at most 1 in 20,000 in more than 23.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import cut

SHINGLE = 5
RADIUS = 19
BLOCKS = 5
#: Numbers of 64 bits in a bitmap of anchors.  A fuller bitmap lets more through and loses nothing.
BITMAP = 1 << 14
_EDGES = [64 * i // BLOCKS for i in range(BLOCKS + 1)]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def gram_at(words: Column, start: Column, width: int = SHINGLE) -> Column:
    """The words from ``start`` on, which counts from 0, as one string.  Single elements are taken, since a slice in a lambda
    walks over its whole array."""
    return F.concat_ws(" ", *(F.get(words, start + k) for k in range(width)))


def shingles(words: Column, start: Column | int = 0, length: Column | None = None) -> Column:
    """The five-word shingles of ``length`` words from ``start`` on, in order and with repeats; all words if there are fewer."""
    start = F.lit(start) if isinstance(start, int) else start
    length = F.size(words) if length is None else length
    some = F.transform(F.sequence(start, start + F.greatest(length - SHINGLE, F.lit(0))), lambda i: gram_at(words, i))
    few = F.array(F.array_join(F.transform(F.sequence(start, start + F.greatest(length - 1, F.lit(0))), lambda i: F.get(words, i)), " "))
    return F.when(length == 0, F.array().cast("array<string>")).when(length < SHINGLE, few).otherwise(some)


def _right(value: Column, by: Column | int) -> Column:
    return F.call_function("shiftrightunsigned", value, F.lit(by) if isinstance(by, int) else by)


def simhash(hashes: Column) -> Column:
    """A bit is set where more than half the hashes have it.

    Counts add up in lanes of a number.  A lane has 16 bits, or 32 where there are so many hashes that 16 could overflow.
    """
    zero = F.lit(0).cast("long")

    def counted(h: Column, width: int) -> Column:
        mask = F.lit(sum(1 << at for at in range(0, 64, width)))

        def lane(k: int) -> Column:
            return F.aggregate(h, zero, lambda a, x: a + _right(x, k).bitwiseAND(mask))


        def bit(counts: Column, b: Column) -> Column:
            one = _right(F.element_at(counts, b % width + 1), F.floor(b / width).cast("int") * width)
            more = one.bitwiseAND(F.lit((1 << width) - 1)) * 2 > F.size(h)
            return F.when(more, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(zero)

        bits = F.sequence(F.lit(0), F.lit(63))
        return let(F.array(*map(lane, range(width))), lambda counts: F.aggregate(bits, zero, lambda a, b: a.bitwiseOR(bit(counts, b))))

    return let(hashes, lambda h: F.when(F.size(h) < 1 << 15, counted(h, 16)).otherwise(counted(h, 32)))


def _block(fingerprint: Column, i: int) -> Column:
    return _right(fingerprint, _EDGES[i]).bitwiseAND(F.lit((1 << _EDGES[i + 1] - _EDGES[i]) - 1)).cast("int")


def _near(i: int) -> list[int]:
    """What to flip in block ``i``: up to RADIUS // BLOCKS of its bits."""
    bits = range(_EDGES[i + 1] - _EDGES[i])
    return [sum(1 << b for b in some) for k in range(RADIUS // BLOCKS + 1) for some in combinations(bits, k)]


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two bags: what they share once each, and more of what both repeat."""

    def repeated(bag: Column) -> Column:
        again = let(F.array_sort(bag), lambda s: F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (x == F.get(s, i - 1)))))
        return F.when(F.size(F.array_distinct(bag)) == F.size(bag), F.array().cast("array<string>")).otherwise(again)

    def count(bag: Column, x: Column) -> Column:
        return F.size(F.filter(bag, lambda y: y == x))

    def of(ab: Column) -> Column:
        one, two = ab["a"], ab["b"]
        more = F.transform(F.array_intersect(repeated(one), repeated(two)), lambda x: F.least(count(one, x), count(two, x)) - 1)
        low = F.size(F.array_intersect(one, two)) + F.aggregate(more, F.lit(0), lambda s, x: s + x)
        return let(low, lambda n: n / (F.size(one) + F.size(two) - n))

    return let(F.struct(a.alias("a"), b.alias("b")), of)


def describe_items(benchmark: DataFrame, threshold: float) -> DataFrame:
    """``item_id, item_len, item_grams, item_print, anchors`` (shingle and its longest word) of items with a word."""
    few = F.lit((1 - threshold) / (1 + threshold) + 1e-9)

    def anchor(w: Column) -> Callable[[Column, Column], Column]:
        def of(gram: Column, i: Column) -> Column:
            words = F.array(*(F.struct(F.length(F.get(w, i + k)).alias("n"), F.get(w, i + k).alias("word")) for k in range(SHINGLE)))
            return F.struct(F.array_max(words).alias("best"), i.alias("at"), gram.alias("gram"))

        return of

    def item(w: Column) -> Column:
        def of(grams: Column) -> Column:
            ranked = F.reverse(F.array_sort(F.transform(grams, anchor(w))))
            needed = F.floor(F.size(grams) * few).cast("int") + 1
            anchors = F.transform(F.slice(ranked, F.lit(1), needed), lambda x: F.struct(x["gram"].alias("gram"), x["best"]["word"].alias("word")))
            fingerprint = simhash(F.transform(grams, lambda g: F.xxhash64(g))).alias("item_print")
            return F.struct(F.size(w).alias("item_len"), grams.alias("item_grams"), fingerprint, anchors.alias("anchors"))

        return let(shingles(w), of)

    whole = let(words_of(F.col("text")), item)
    return benchmark.select("item_id", F.inline(F.filter(F.array(whole), lambda x: x["item_len"] > 0)))


def _bitmap(values: DataFrame) -> Column:
    """A bitmap of fixed size of hashed strings, as a scalar subquery that gives an array of BITMAP numbers."""
    spot = F.pmod(F.xxhash64(values.columns[0]), F.lit(64 * BITMAP))
    bit = F.expr("shiftleft(1L, CAST(_spot % 64 AS INT))").alias("bit")
    rows = values.withColumn("_spot", spot).select(F.expr("_spot DIV 64").alias("id"), bit)
    rows = rows.groupBy("id").agg(F.bit_or("bit").alias("bits"))
    whole = values.sparkSession.range(BITMAP).join(rows, "id", "left").select("id", F.coalesce("bits", F.lit(0)).alias("bits"))
    ordered = F.array_sort(F.collect_list(F.struct("id", "bits")))
    return whole.agg(F.transform(ordered, lambda x: x["bits"]).alias("bits")).scalar()


def _in(bitmap: Column, value: Column) -> Column:
    spot = F.pmod(F.xxhash64(value), F.lit(64 * BITMAP))
    return F.call_function("getbit", F.get(bitmap, F.floor(spot / 64).cast("int")), (spot % 64).cast("int")) == 1


def _with_anchors(docs: DataFrame, anchors: DataFrame) -> DataFrame:
    """``row, doc_id, w, n, hits`` of texts in which anchors may occur; a hit is a place, a width and a hash.

    All is bound by ``let`` and comes out of one generator, so that no filter or lambda works anything out again.
    """
    rows = docs.withColumns({"words": _bitmap(anchors.select("word")), "grams": _bitmap(anchors.select("gram"))})

    def around(w: Column, p: Column) -> Column:  # a place and a width in one number, which array_distinct can hash
        starts = lambda width: F.filter(F.sequence(p - (width - 1), p), lambda s: (s >= 0) & (s + width <= F.size(w)))
        return F.concat(*(_coded(starts(width), width) for width in range(1, SHINGLE + 1)))

    def gram(w: Column, code: Column) -> Column:
        at, width = (code / 8).cast("int"), code % 8
        return F.concat_ws(" ", *(F.when(width > k, F.get(w, at + k)) for k in range(SHINGLE)))

    def hit(w: Column, c: Column) -> Column:
        return F.struct((c / 8).cast("int").alias("at"), (c % 8).cast("int").alias("width"), F.xxhash64(gram(w, c)).alias("gram"))

    def text(w: Column) -> Column:
        places = F.filter(F.transform(w, lambda x, i: F.when(_in(F.col("words"), x), i)), lambda i: i.isNotNull())
        codes = F.array_distinct(F.flatten(F.transform(places, lambda p: around(w, p))))
        hits = F.transform(F.filter(codes, lambda c: _in(F.col("grams"), gram(w, c))), lambda c: hit(w, c))
        return F.struct(w.alias("w"), F.size(w).alias("n"), hits.alias("hits"))

    whole = let(words_of(F.col("text")), text)
    found = F.inline(F.filter(F.array(whole), lambda x: F.size(x["hits"]) > 0))
    return rows.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", found)


def _coded(starts: Column, width: int) -> Column:
    return F.transform(starts, lambda s: s.cast("long") * 8 + width)


def _fingerprints(texts: DataFrame, anchors: DataFrame) -> DataFrame:
    """``row, start, item_len, print`` of all windows that hold an anchor of an item of their length."""
    hits = texts.select("row", "n", F.inline("hits")).join(anchors.select(F.xxhash64("gram").alias("gram"), "item_len").distinct(), "gram")
    first, last = F.greatest(F.col("at") + F.col("width") - F.col("item_len"), F.lit(0)), F.least(F.col("at"), F.col("n") - F.col("item_len"))
    runs = hits.where("item_len <= n").select("row", first.alias("first"), last.alias("last"), "item_len").where("first <= last")
    places = runs.groupBy("row").agg(F.collect_set(F.struct("first", "last", "item_len")).alias("runs"))
    code = lambda r: F.transform(F.sequence(r["first"], r["last"]), lambda s: s.cast("long") * (1 << 31) + r["item_len"])
    windows = F.array_distinct(F.flatten(F.transform("runs", code)))
    every = F.transform(F.sequence(F.lit(0), F.greatest(F.col("n") - SHINGLE, F.lit(0))), lambda i: F.xxhash64(gram_at(F.col("w"), i)))

    def one(code: Column, hashes: Column) -> Column:
        start, length = F.floor(code / (1 << 31)).cast("int"), (code % (1 << 31)).cast("int")
        long = F.transform(F.sequence(start, start + F.greatest(length - SHINGLE, F.lit(0))), lambda i: F.get(hashes, i))
        short = F.transform(shingles(F.col("w"), start, length), lambda g: F.xxhash64(g))
        fingerprint = simhash(F.when(length < SHINGLE, short).otherwise(long))
        return F.struct(start.alias("start"), length.alias("item_len"), fingerprint.alias("print"))

    prints = let(every, lambda hashes: F.transform(windows, lambda code: one(code, hashes)))
    return texts.join(places, "row").select("row", F.inline(prints))


def _verified(docs: DataFrame, benchmark: DataFrame, threshold: float) -> DataFrame:
    """``row, doc_id, item_id, b`` (similarity and the negative start); a row is told by its doc_id and text."""
    items = cut(describe_items(benchmark.where("item_id IS NOT NULL").select("item_id", "text").distinct(), threshold))
    anchors = items.select("item_len", F.inline("anchors"))
    texts = cut(_with_anchors(docs.where("text IS NOT NULL").select("doc_id", "text"), anchors))
    found = _fingerprints(texts, anchors)
    flips = [F.struct(F.lit(i).alias("block"), _block(F.col("item_print"), i).alias("value"), F.array(*map(F.lit, _near(i))).alias("flips")) for i in range(BLOCKS)]
    near = items.select("item_id", "item_len", "item_print", F.inline(F.array(*flips))).withColumn("flip", F.explode("flips"))
    near = near.select("item_id", "item_len", "item_print", "block", F.col("value").bitwiseXOR(F.col("flip")).alias("value"))
    blocks = F.array(*(F.struct(F.lit(i).alias("block"), _block(F.col("print"), i).alias("value")) for i in range(BLOCKS)))
    probe = found.select("row", "start", "item_len", "print", F.inline(blocks))
    pairs = probe.join(near, ["item_len", "block", "value"]).where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS)
    starts = pairs.groupBy("row", "item_id").agg(F.collect_set("start").alias("starts"))
    starts = starts.join(items.select("item_id", "item_len", "item_grams"), "item_id")

    def exact(s: Column) -> Column:
        like = similarity(shingles(F.col("w"), s, F.col("item_len")), F.col("item_grams"))
        return F.struct(like.alias("similarity"), (-s).alias("before"))

    inside = F.filter("starts", lambda s: s + F.col("item_len") <= F.col("n"))  # another text may have got the same row number
    best = F.filter(F.array(F.array_max(F.transform(inside, exact))), lambda b: b["similarity"] >= threshold)
    return texts.join(starts, "row").select("row", "doc_id", "item_id", F.explode(best).alias("b"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``doc_id, item_id, start, similarity`` for each pair of a document and an item that it holds.

    ``start`` is the place, counted from 0, of the first word of the most similar window (the first such).  Null and empty
    texts hold nothing and are held by nothing; documents shorter than an item do not hold it; items with a null item_id
    are left out.  There is one row for a doc_id and an item, also if the doc_id comes with several texts or repeated;
    documents without a doc_id count as one with a null doc_id.  Very long texts and items take part whole; empty tables
    give no rows; other columns are not looked at.
    """
    best = _verified(docs, benchmark, threshold).groupBy("doc_id", "item_id").agg(F.max("b").alias("b"))
    return best.select("doc_id", "item_id", (-F.col("b.before")).alias("start"), F.col("b.similarity").alias("similarity"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The documents that hold no item, with their columns as they are; each row is judged by its own text."""
    held = _verified(docs, benchmark, threshold).select(F.col("row").alias("_row")).distinct()
    return docs.withColumn("_row", F.xxhash64("doc_id", "text")).join(held, "_row", "left_anti").select(*docs.columns)
