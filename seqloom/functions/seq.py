"""Sequence functions as Spark columns.  All stay in the JVM; none is a UDF.

A base has a two-bit code: A 0, C 1, T 2, G 3; a k-mer's code takes the first base as most significant.  The
complement of a code is the code XOR 2.  Codes of up to 31 bases are positive BIGINTs; with 32 bases they fill
all 64 bits and the BIGINT holds the bit pattern, so comparisons are made on strings of the digits 0 to 3.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Base alphabet in code order, the alphabet of complements, and ambiguity codes with their complements.
BASES = "ACTG"
COMPLEMENTS = "TGAC"
IUPAC = "ACGTUMRWSYKVHDBNacgtumrwsykvhdbn"
IUPAC_COMPLEMENTS = "TGCAAKYWSRMBDHVNtgcaakywsrmbdhvn"
FNV_PRIME = 1099511628211


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def digits(bases: Column | str) -> Column:
    """Bases as digits 0 to 3, whose order is that of the codes."""
    return F.translate(_c(bases), BASES, "0123")


def revcomp(bases: Column | str) -> Column:
    """Reverse complement; what is not A, C, G or T stays as it is."""
    return F.reverse(F.translate(_c(bases), BASES, COMPLEMENTS))


def revcomp_iupac(bases: Column | str) -> Column:
    """Reverse complement with ambiguity codes."""
    return F.reverse(F.translate(_c(bases), IUPAC, IUPAC_COMPLEMENTS))


def complement(bases: Column | str) -> Column:
    return F.translate(_c(bases), BASES, COMPLEMENTS)


def encode(bases: Column | str) -> Column:
    """Code of a k-mer of up to 31 bases."""
    return F.conv(digits(bases), 4, 10).cast("long")


def encode32(bases: Column | str) -> Column:
    """Bit pattern of the code of a k-mer of up to 32 bases."""
    unsigned = F.conv(digits(bases), 4, 10).cast("decimal(20,0)")
    return F.when(unsigned > F.lit(str(2**63 - 1)).cast("decimal(20,0)"), unsigned - F.lit(str(2**64)).cast("decimal(20,0)")).otherwise(unsigned).cast("long")


def decode(code: Column | str, k: int) -> Column:
    """The k-mer of a code."""
    return F.translate(F.lpad(F.conv(_c(code).cast("string"), 10, 4), k, "0"), "0123", BASES)


def rev_complement_code(code: Column | str, k: int) -> Column:
    return encode(revcomp(decode(code, k)))


def canonical(code: Column | str, k: int) -> Column:
    return F.least(_c(code), rev_complement_code(code, k))


def bit_reverse(code: Column | str, k: int) -> Column:
    """The code with its bases in reverse order."""
    return encode(F.reverse(decode(code, k)))


def transform_code(code: Column | str, k: int, reverse: bool, comp: bool) -> Column:
    text = decode(code, k)
    text = F.reverse(text) if reverse else text
    return encode(complement(text) if comp else text)


def left_half(code: Column | str, k: int) -> Column:
    return F.shiftrightunsigned(_c(code), 2 * (k - k // 2))


def right_half(code: Column | str, k: int) -> Column:
    return _c(code).bitwiseAND(F.lit((1 << 2 * (k - k // 2)) - 1))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once.  A lambda works out again, for each element, whatever it names from outside."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _strands(bases: Column | str, f: Callable[[Column, Column, Column], Column]) -> Column:
    """``f`` of the digits of both strands, as bytes, and their number.  Substrings of bytes cost what they return."""

    def of(b: Column) -> Column:
        both = F.struct(digits(b).cast("binary").alias("data"), F.translate(F.reverse(b), BASES, "2301").cast("binary").alias("back"), F.length(b).alias("n"))
        return let(both, lambda s: f(s["data"], s["back"], s["n"]))

    return let(_c(bases), of)


def kmer_digits(bases: Column | str, k: int, canonical: bool = True) -> Column:
    """All k-mers of an ACGT text, in order, as binary digit strings."""

    def of(data: Column, back: Column, n: Column) -> Column:
        one = lambda i: F.substring(data, i, F.lit(k))
        take = (lambda i: F.least(one(i), F.substring(back, n - k + 2 - i, F.lit(k)))) if canonical else one
        return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), take)).otherwise(F.array().cast("array<binary>"))

    return _strands(bases, of)


def kmers(bases: Column | str, k: int, canonical: bool = True) -> Column:
    """All k-mers of an ACGT text, in order, as codes (k up to 31)."""
    return F.transform(kmer_digits(bases, k, canonical), lambda d: F.conv(d.cast("string"), 4, 10).cast("long"))


def stranded_kmers(bases: Column | str, k: int) -> Column:
    """All k-mers as structs: canonical code, and whether the text has it as is (plus) or reversed."""
    code = lambda d: F.conv(d.cast("string"), 4, 10).cast("long")

    def of(data: Column, back: Column, n: Column) -> Column:
        pair = lambda x: F.struct(code(F.least(x["f"], x["r"])).alias("kmer"), (x["f"] <= x["r"]).alias("plus"))
        take = lambda i: let(F.struct(F.substring(data, i, F.lit(k)).alias("f"), F.substring(back, n - k + 2 - i, F.lit(k)).alias("r")), pair)
        return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), take)).otherwise(F.array().cast("array<struct<kmer:bigint,plus:boolean>>"))

    return _strands(bases, of)


def acgt_runs(bases: Column | str) -> Column:
    """Longest runs of A, C, G and T."""
    return F.regexp_extract_all(_c(bases), F.lit("([ACGT]+)"), 1)


def acgt_cut(bases: Column | str) -> Column:
    """What comes before the first base that is not A, C, G or T."""
    return F.regexp_extract(_c(bases), "^[ACGT]*", 0)


def longest_run(bases: Column | str) -> Column:
    """The leftmost of the longest ACGT runs; null if there is none."""
    runs = acgt_runs(bases)
    return F.array_max(F.transform(runs, lambda r, i: F.struct(F.length(r).alias("n"), (-i).alias("at"), r.alias("run"))))["run"]


def predicted(bases: Column | str) -> Column:
    """Number of places whose base is foreseen: it equals those 1, 2, 3 and 4 periods before, for a period of 1, 2 or 3."""

    def of(data: Column) -> Column:
        at = lambda i: F.substring(data, i, F.lit(1))
        foreseen = lambda i, p: (i > 4 * p) & (at(i) == at(i - p)) & (at(i) == at(i - 2 * p)) & (at(i) == at(i - 3 * p)) & (at(i) == at(i - 4 * p))
        n = F.octet_length(data)
        return F.when(n > 4, F.size(F.filter(F.sequence(F.lit(1), n), lambda i: foreseen(i, 1) | foreseen(i, 2) | foreseen(i, 3)))).otherwise(0)

    return let(_c(bases).cast("binary"), of)


def low_complexity(bases: Column | str, k: int) -> Column:
    return predicted(bases) >= 13 * k // 32


def fnv1(code: Column | str) -> Column:
    """FNV-1 over the eight little-endian bytes of a code, starting from the usual offset 14695981039346656037, as DECIMAL(20,0)."""
    h = fnv1_long(code)
    return F.when(h < 0, h.cast("decimal(20,0)") + F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(h.cast("decimal(20,0)")).cast("decimal(20,0)")


def fnv1_long(code: Column | str) -> Column:
    """The same hash in the 64 bits of a BIGINT, which is negative from 2**63 on.

    The prime is 2**40 + 435, so a product is a shift and a small product.  It is made in two halves of 32 bits, each of
    which stays far below the limits of BIGINT.
    """
    low, value = F.lit((1 << 32) - 1), _c(code)
    right = lambda x, n: F.call_function("shiftrightunsigned", x, F.lit(n))
    left = lambda x, n: F.call_function("shiftleft", x, F.lit(n))
    rest = F.lit(FNV_PRIME - (1 << 40)).cast("long")

    def times(h: Column) -> Column:
        small = h.bitwiseAND(low) * rest
        high = right(h, 32) * rest + right(small, 32) + left(h.bitwiseAND(F.lit((1 << 24) - 1)), 8)
        return left(high, 32).bitwiseOR(small.bitwiseAND(low))

    h = F.lit(14695981039346656037 - (1 << 64)).cast("long")
    bytes_of = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.call_function("shiftrightunsigned", value, i * 8).bitwiseAND(F.lit(255)).cast("long"))
    return F.aggregate(bytes_of, h, lambda acc, x: times(acc).bitwiseXOR(x))


def fnv1_rank(code: Column | str) -> Column:
    """A BIGINT that sorts as the unsigned hash does."""
    return fnv1_long(code).bitwiseXOR(F.lit(-(1 << 63)).cast("long"))


def parse_count(token: Column | str) -> tuple[Column, Column]:
    """The tax id and the count of a hit token ``tax`` or ``taxxN``."""
    parts = F.split(_c(token), "x")
    return parts[0].cast("int"), F.coalesce(F.try_element_at(parts, F.lit(2)).cast("long"), F.lit(1).cast("long"))


def clean_spot(name: Column | str) -> Column:
    """Tabs and line ends as spaces."""
    return F.translate(_c(name), "\t\n", "  ")


def quality_mask(bases: Column | str, quals: Column | str, floor: str = "$") -> Column:
    """Bases whose quality character is below ``floor`` become N; qualities beyond the last base say nothing."""
    # an empty text splits into one empty piece, which is no base
    pairs = F.zip_with(F.split(_c(bases), ""), F.split(_c(quals), ""), lambda b, q: F.when((b != "") & (q < F.lit(floor)), F.lit("N")).otherwise(b))
    return F.array_join(pairs, "")


def entropy(bases: Column | str) -> Column:
    """Shannon entropy, in bits, of the bases A, C, G and T in a text."""
    n = F.length(F.regexp_replace(_c(bases), "[^ACGT]", ""))
    p = [(F.length(_c(bases)) - F.length(F.replace(_c(bases), F.lit(b), F.lit("")))) / n for b in "ACGT"]
    return -sum((F.when(x > 0, x * F.log2(x)).otherwise(0.0) for x in p), F.lit(0.0))
