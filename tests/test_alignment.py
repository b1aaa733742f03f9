"""Alignments against the recurrence written out cell by cell."""

import random
import re
from functools import cache

import numpy as np
import pytest

from seqloom.operators import alignment
from seqloom.operators.alignment import align, align_pairs, align_many, read_matrix

MATCH, MISMATCH, OPENING, EXTENSION = 1, -2, 5, 2


def best(query, subject, mode, band=None):
    """Highest score over all paths, from the definition."""
    n, m = len(query), len(subject)
    inside = lambda i, j: band is None or abs(j - i) <= band
    low = float("-inf")

    @cache
    def cell(i, j, state):
        if i < 0 or j < 0 or not inside(i, j):
            return low
        if state == "I":
            return max(cell(i - 1, j, "H") - OPENING - EXTENSION, cell(i - 1, j, "I") - EXTENSION)
        if state == "D":
            return max(cell(i, j - 1, "H") - OPENING - EXTENSION, cell(i, j - 1, "D") - EXTENSION)
        tries = [cell(i, j, "I"), cell(i, j, "D")]
        if i == j == 0 or mode in ("local", "right"):
            tries.append(0)
        if i and j:
            tries.append(cell(i - 1, j - 1, "H") + (MATCH if query[i - 1] == subject[j - 1] else MISMATCH))
        return max(tries)

    if mode in ("global", "right"):
        return cell(n, m, "H")
    return max(cell(i, j, "H") for i in range(n + 1) for j in range(m + 1))


def rescored(query, subject, got):
    i, j, score, same, apart = got["query_start"], got["subject_start"], 0, 0, 0
    for k, op in re.findall(r"(\d+)([MID])", got["cigar"]):
        k = int(k)
        if op == "M":
            hits = sum(a == b for a, b in zip(query[i : i + k], subject[j : j + k], strict=True))
            score, same, apart, i, j = score + hits * MATCH + (k - hits) * MISMATCH, same + hits, apart + k - hits, i + k, j + k
        else:
            score, apart = score - OPENING - k * EXTENSION, apart + k
            i, j = (i + k, j) if op == "I" else (i, j + k)
    assert (i, j) == (got["query_end"], got["subject_end"])
    assert (same, apart) == (got["matches"], got["distance"])
    return score


@pytest.mark.parametrize("mode", ["global", "local", "left", "right"])
@pytest.mark.parametrize("band", [None, 3])
def test_scores_and_paths(mode, band):
    rng = random.Random(7)
    for trial in range(60):
        a = "".join(rng.choice("ACGT") for _ in range(rng.randrange(0, 26)))
        b = "".join(rng.choice("ACGT") for _ in range(rng.randrange(0, 26))) if trial % 2 else a[: len(a) // 3] + a[len(a) // 2 :] + "ACGTAC"
        got, want = align(a, b, mode, band=band, cells=rng.choice([1, 40, 1 << 20])), best(a, b, mode, band)
        if want == float("-inf"):
            assert got["score"] is None and got["cigar"] is None
            continue
        assert got["score"] == want, (a, b)
        assert rescored(a, b, got) == want, (a, b, got)
        if mode == "global":
            assert (got["query_start"], got["subject_start"]) == (0, 0)


def test_known_paths():
    assert align("ACGTACGT", "ACGTACGT")["cigar"] == "8M"
    assert align("AAAACCCCGGGGTTTT", "AAAACCCCTTTTGGGGTTTT")["cigar"] in {"8M4D8M", "7M4D9M"}
    assert align("", "ACG")["cigar"] == "3D" and align("ACG", "")["cigar"] == "3I" and align("", "")["cigar"] == ""
    assert align("TTTTACGTACGT", "GGACGTACGTCC", "local") == {"score": 8, "cigar": "8M", "query_start": 4, "query_end": 12, "subject_start": 2, "subject_end": 10, "matches": 8, "distance": 0}


def test_long_texts():
    rng = random.Random(3)
    a = "".join(rng.choice("ACGT") for _ in range(4000))
    b = a[:1500] + a[1510:3000] + "ACGT" * 3 + a[3000:]
    got = align(a, b, cells=1 << 12)
    assert rescored(a, b, got) == got["score"] and got["distance"] == 22


def test_pairs(spark):
    rows = spark.createDataFrame([(1, "ACGT", "ACGT"), (2, None, "AC"), (3, None, None), (1, "ACGT", "ACGT")], "spotid int, query string, subject string")
    got = sorted((r.spotid, r.score, r.cigar) for r in align_pairs(rows).collect())
    assert got == [(1, 4, "4M"), (1, 4, "4M"), (2, -9, "2D"), (3, 0, "")]
    assert align_pairs(rows.limit(0)).count() == 0
    assert {r.score for r in align_pairs(rows.where("spotid = 2"), "local", band=4).collect()} == {0}


@pytest.mark.parametrize("mode", ["global", "local", "left", "right"])
def test_batches_equal_single_pairs(mode):
    rng = random.Random(mode)
    text = lambda n: "".join(rng.choice("ACGT" if rng.random() < 0.9 else "é😀") for _ in range(n))
    pairs = [("", ""), ("A", ""), ("", "CG"), ("ACGT", "ACGT")]
    for _ in range(150):
        q = text(rng.randrange(0, 60))
        s = list(q)
        for _ in range(rng.randrange(6)):
            at = rng.randrange(len(s) + 1)
            s[at : at + rng.randrange(3)] = text(rng.randrange(4))
        pairs.append((q, "".join(s) if rng.random() < 0.8 else text(rng.randrange(60))))
    assert align_many(pairs, mode) == [align(q, s, mode) for q, s in pairs]
    assert align_many(pairs, mode, 1, -1, 8, 2, cells=3000) == [align(q, s, mode, 1, -1, 8, 2) for q, s in pairs]
    bands = [(rng.randrange(0, 12), rng.randrange(-6, 7)) for _ in pairs]
    assert align_many(pairs, mode, bands=bands) == [align(q, s, mode, band=b, shift=x) for (q, s), (b, x) in zip(pairs, bands, strict=True)]
    assert align_many([], mode) == []


def test_matrices_score_pairs():
    rng = random.Random(1)
    letters, scores = read_matrix("# comment\n   A  C  G  T\nA  5 -4  1 -4\nC -4  6 -4  0\n\nG  1 -4  7 -4\nT -4  0 -4  8\n")
    assert letters == "ACGT" and scores[1][3] == 0 and scores[3][3] == 8
    with pytest.raises(ValueError, match="a row and a column"):
        read_matrix("A C\nA 1 2\nG 1 2\n")
    text = lambda: "".join(rng.choice("ACGTN") for _ in range(rng.randrange(1, 40)))
    pairs = [(text(), text()) for _ in range(80)]
    for mode in ("global", "local"):
        many = align_many(pairs, mode, 1, -2, 5, 2, matrix=(letters, scores))
        assert many == [align(q, s, mode, 1, -2, 5, 2, matrix=(letters, scores)) for q, s in pairs]
        for (q, s), x in zip(pairs, many, strict=True):  # the score is that of the path
            i, j, total = x["query_start"], x["subject_start"], 0
            for n, op in re.findall(r"(\d+)([MID])", x["cigar"]):
                n = int(n)
                for _ in range(n if op == "M" else 0):
                    a, b = letters.find(q[i]), letters.find(s[j])
                    total += int(scores[a][b]) if a >= 0 and b >= 0 else -2
                    i, j = i + 1, j + 1
                if op != "M":
                    total -= 5 + 2 * n
                    i, j = i + n * (op == "I"), j + n * (op == "D")
            assert total == x["score"] and (i, j) == (x["query_end"], x["subject_end"])
    same = ("ACGT", np.where(np.eye(4, dtype=bool), 1, -2))
    told = lambda rows: [(x["score"], x["cigar"]) for x in rows]
    assert told(align_many(pairs, matrix=same, mismatch=-2)) == told(align_many([(q.replace("N", "n"), s.replace("N", "-")) for q, s in pairs]))


def test_unlike_pairs_share_few_steps(monkeypatch):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choices("ACGT", k=n))
    pairs = [(text(rng.randrange(400)), text(rng.randrange(400))) for _ in range(120)]
    made, batch = [], alignment._Batch

    class Counted(batch):
        def __init__(self, pairs, *rest):
            made.append(max(len(q) for q, _ in pairs) + max(len(s) for _, s in pairs))
            super().__init__(pairs, *rest)

    monkeypatch.setattr(alignment, "_Batch", Counted)
    for mode in ("global", "local", "left", "right"):
        made.clear()
        assert align_many(pairs, mode) == [align(q, s, mode) for q, s in pairs]
        assert sum(made) < 12_000  # about 400 steps a pair if each were alone
    assert align_many(pairs[:20], "local", bands=[(9, x % 5) for x in range(20)]) == [align(q, s, "local", band=9, shift=x % 5) for x, (q, s) in enumerate(pairs[:20])]
    assert align_many(pairs[:5], "local", mismatch=1) == [align(q, s, "local", mismatch=1) for q, s in pairs[:5]]
    assert align_many(pairs[:20], "local", 400, -900) == [align(q, s, "local", 400, -900) for q, s in pairs[:20]]
