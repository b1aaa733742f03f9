"""Pairwise alignment with affine gaps: whole, local, pinned at one end, or inside a band."""

from __future__ import annotations

from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOW = -(1 << 28)
CELLS = 1 << 22
DIAGONAL, QUERY, LONGER_I, LONGER_D, STOP = 1, 2, 4, 8, 16


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def read_matrix(text: str) -> tuple[str, np.ndarray]:
    """The letters and scores of a substitution matrix as it is usually written: a line of letters, then a line a letter; ``#`` begins comments."""
    rows = [line.split() for line in text.splitlines() if line.strip() and not line.startswith("#")]
    letters = "".join(rows[0])
    if [r[0] for r in rows[1:]] != list(letters) or any(len(r) != len(letters) + 1 for r in rows[1:]):
        raise ValueError("a matrix has a row and a column for each letter, in one order")
    return letters, np.array([[int(x) for x in r[1:]] for r in rows[1:]], np.int32)


def _table(matrix, mismatch):
    """Scores by code for the first 128 codes; what the matrix does not name scores as a mismatch."""
    letters, scores = matrix
    table = np.full((128, 128), mismatch, np.int32)
    at = _codes(letters)
    table[at[:, None], at[None]] = scores
    return table


class _Matrix:
    """Rows of the recurrence, a row in one step; of all rows only every ``block``-th is kept, and the flags of one block."""

    def __init__(self, query, subject, mode, match, mismatch, opening, extension, band, shift, cells, matrix=None):
        self.q, self.s = _codes(query), _codes(subject)
        self.table = None if matrix is None else _table(matrix, mismatch)[:, np.minimum(self.s, 127)]
        self.n, self.m = len(self.q), len(self.s)
        self.clamp, self.opening, self.extension = mode in ("local", "right"), opening, extension
        self.match, self.mismatch = np.int32(match), np.int32(mismatch)
        self.band, self.shift = band, shift
        self.ramp = (extension * np.arange(self.m + 1)).astype(np.int32)
        self.block = max(1, cells // (self.m + 1), isqrt(self.n) + 1)
        self.kept, self.first, self.flags = [], -1, None

    def columns(self, i):
        if self.band is None:
            return 0, self.m
        return max(0, i + self.shift - self.band), min(self.m, i + self.shift + self.band)

    def start(self):
        h, e = np.full(self.m + 1, LOW, np.int32), np.full(self.m + 1, LOW, np.int32)
        lo, hi = self.columns(0)
        if hi >= lo:
            h[lo : hi + 1] = 0 if self.clamp else -(self.opening + self.ramp[lo : hi + 1])
        if lo == 0 and hi >= 0:
            h[0] = 0
        return h, e

    def step(self, i, h, e, flags=None):
        """Turn row i - 1 into row i; the columns left of a band are those of no row."""
        lo, hi = self.columns(i)
        if hi < lo:
            h[:] = LOW
            return
        fresh, grow = h[lo : hi + 1] - (self.opening + self.extension), e[lo : hi + 1] - self.extension
        down = np.maximum(fresh, grow)
        cross = np.full(hi - lo + 1, LOW, np.int32)
        a = max(lo, 1)
        pair = np.where(self.s[a - 1 : hi] == self.q[i - 1], self.match, self.mismatch) if self.table is None else self.table[min(self.q[i - 1], 127), a - 1 : hi]
        cross[a - lo :] = h[a - 1 : hi] + pair
        if lo == 0:
            cross[0], down[0] = 0 if self.clamp else -(self.opening + self.extension * i), LOW
        own = np.maximum(cross, down)
        if self.clamp:
            own = np.maximum(own, 0)
        along = np.full(hi - lo + 1, LOW, np.int32)
        ramp = self.ramp[lo : hi + 1]
        along[1:] = np.maximum.accumulate(own + ramp)[:-1] - ramp[1:] - self.opening
        best = np.maximum(own, along)
        if flags is not None:
            f = (cross > np.maximum(down, along)) * DIAGONAL + (down >= along) * QUERY + (grow > fresh) * LONGER_I
            f[1:] += (along[:-1] > best[:-1] - self.opening) * LONGER_D
            flags[lo : hi + 1] = f + (best == 0) * STOP if self.clamp else f
        if lo:
            h[lo - 1], e[lo - 1] = LOW, LOW
        h[lo : hi + 1], e[lo : hi + 1] = best, down

    def forward(self, anywhere):
        """Score and place of the end: the last corner, or the first of the best cells."""
        h, e = self.start()
        at = int(h.argmax()) if anywhere else 0
        top = (int(h[at]), 0, at)
        for i in range(1, self.n + 1):
            if (i - 1) % self.block == 0:
                self.kept.append((h.copy(), e.copy()))
            self.step(i, h, e)
            if anywhere and (j := int(h.argmax())) >= 0 and h[j] > top[0]:
                top = (int(h[j]), i, j)
        return top if anywhere else (int(h[self.m]), self.n, self.m)

    def flag(self, i, j):
        first = (i - 1) // self.block
        if first != self.first:
            h, e = (x.copy() for x in self.kept[first])
            begin = first * self.block
            rows = min(self.block, self.n - begin)
            self.first, self.flags = first, np.zeros((rows, self.m + 1), np.uint8)
            for r in range(rows):
                self.step(begin + r + 1, h, e, self.flags[r])
        return int(self.flags[i - 1 - first * self.block, j])


def align(query: str, subject: str, mode: str = "global", match: int = 1, mismatch: int = -2, opening: int = 5, extension: int = 2, band: int | None = None, shift: int = 0, cells: int = CELLS, matrix: tuple[str, np.ndarray] | None = None) -> dict:
    """``score, cigar, query_start, query_end, subject_start, subject_end, matches, distance`` of one pair.

    A gap of n costs opening + n * extension.  D is a gap in the query, I one in the subject; a diagonal step is taken only if
    it is better than a gap.  ``global`` aligns both texts whole, ``local`` the best stretches, ``left`` what begins
    with both texts, ``right`` what ends with both.  With ``band`` only cells count whose diagonal (place in the subject less
    place in the query) differs from ``shift`` by at most that much; if no path lies in the band, score and CIGAR are null.
    ``matrix``, as ``read_matrix`` gives it, scores pairs of its letters in place of match and mismatch; other letters mismatch.
    Places count from 0, ends are exclusive.  Texts may have any length: memory grows with the length times its root.
    """
    if mode not in ("global", "local", "left", "right"):
        raise ValueError(f"no such mode: {mode}")
    x = _Matrix(query, subject, mode, match, mismatch, opening, extension, band, shift, cells, matrix)
    score, i, j = x.forward(mode in ("local", "left"))
    if score < LOW // 2:
        return dict.fromkeys(("score", "cigar", "query_start", "query_end", "subject_start", "subject_end", "matches", "distance"))
    ends, matches, distance, ops = (i, j), 0, 0, []

    def add(k, op):
        if ops and ops[-1][1] == op:
            ops[-1][0] += k
        else:
            ops.append([k, op])

    while i or j:
        if not i or not j:
            if x.clamp:
                break
            add(i or j, "I" if i else "D")
            distance, i, j = distance + (i or j), 0, 0
            break
        flag = x.flag(i, j)
        if flag & STOP:
            break
        if flag & DIAGONAL:
            same = x.q[i - 1] == x.s[j - 1]
            matches, distance = matches + int(same), distance + int(not same)
            add(1, "M")
            i, j = i - 1, j - 1
            continue
        k, longer = 1, LONGER_I if flag & QUERY else LONGER_D
        while flag & longer:
            flag = x.flag(i - k, j) if longer == LONGER_I else x.flag(i, j - k)
            k += 1
        add(k, "I" if longer == LONGER_I else "D")
        distance, i, j = distance + k, i - (k if longer == LONGER_I else 0), j - (k if longer == LONGER_D else 0)
    return {
        "score": score, "cigar": "".join(f"{k}{op}" for k, op in reversed(ops)), "query_start": i, "query_end": ends[0], "subject_start": j, "subject_end": ends[1],
        "matches": matches, "distance": distance,
    }


#: Cells of a batch whose flags are held at once, and about how many cells a step works on.
BATCH, STEP = 1 << 26, 1 << 15
#: Cells that take as long as a step does before its first cell.
WASTE = 1 << 12
#: Cells from which a pair goes to a task of its own choice, not to those of its likeness.
LARGE = 1 << 20
_OPS = "MID"


class _Batch:
    """The same recurrence for several pairs of like lengths, along diagonals: a step is all cells of one sum of places.

    No cell of a step needs another one, so a step is plain arithmetic on arrays.  They have a row a place in the queries
    and a column a pair, so what a step needs are whole rows.  ``pairs`` come longest first, by the sum of lengths; columns of
    pairs that are done are dropped on the way.  Only the cells of a band are worked out.  Scores take 16 bits where they fit.
    """

    def __init__(self, pairs, mode, match, mismatch, opening, extension, bands, matrix=None):
        self.table = None if matrix is None else _table(matrix, mismatch)
        self.pairs, self.clamp, self.anywhere = pairs, mode in ("local", "right"), mode in ("local", "left")
        self.opening, self.extension = opening, extension
        self.n, self.m = (np.array([len(p[x]) for p in pairs]) for x in (0, 1))
        self.rows, self.columns = int(self.n.max()), int(self.m.max())
        # what lies beyond a text matches nothing, so no end is found there
        self.q, self.s = np.zeros((self.rows, len(pairs)), np.uint32), np.ones((self.columns, len(pairs)), np.uint32)
        for b, (q, s) in enumerate(pairs):
            self.q[: len(q), b], self.s[self.columns - len(s) :, b] = _codes(q), _codes(s)[::-1]
        widest = max(abs(match), abs(mismatch), extension, 0 if self.table is None else int(np.abs(self.table).max()))
        small = widest * (self.rows + self.columns) + 2 * opening < 7000
        self.type, self.low = (np.int16, -16000) if small else (np.int32, LOW)
        self.match, self.mismatch = self.type(match), self.type(mismatch)
        self.bands = None if bands is None else tuple(np.array([x[1] + way * x[0] for x in bands]) for way in (-1, 1))
        if self.table is not None:
            self.table = self.table.astype(self.type)
            self.q, self.s = np.minimum(self.q, 127), np.minimum(self.s, 127)
        elif max(self.q.max(initial=0), self.s.max(initial=0)) < 256:
            self.q, self.s = self.q.astype(np.uint8), self.s.astype(np.uint8)

    def forward(self):
        """Scores and ends of all pairs; ``flags`` has those of a diagonal's cells from ``first`` on."""
        rows, columns, count, low = self.rows, self.columns, len(self.pairs), self.type(self.low)
        both, longer, zero, mismatch, more_for_match = (np.array([[x]], self.type) for x in (self.opening + self.extension, self.extension, 0, self.mismatch, self.match - self.mismatch))
        h0, h1, h2, e0, e1, g, fresh, grow, next_, pair = (np.full((rows + 1, count), low, self.type) for _ in range(10))
        test, q, s, bands = np.zeros((rows + 1, count), bool), self.q, self.s, self.bands
        total, spans, self.width, width = self.n + self.m, [], [], count
        alive, most_n, most_m = np.searchsorted(-total, -np.arange(rows + columns + 1), "right"), np.maximum.accumulate(self.n), np.maximum.accumulate(self.m)
        for d in range(int(total.max()) + 1):
            if alive[d] <= 0.8 * width:
                width = int(alive[d])
            self.width.append(width)
            lo, hi = max(0, d - int(most_m[width - 1])), min(int(most_n[width - 1]), d)
            if self.bands is not None:
                lo, hi = max(lo, -(-(d - int(self.bands[1].max())) // 2)), min(hi, (d - int(self.bands[0].min())) // 2)
            spans.append((lo, hi))
        begins = np.cumsum([0] + [max(0, min(hi, d - 1) - max(1, lo) + 1) * w for d, ((lo, hi), w) in enumerate(zip(spans, self.width, strict=True))])
        self.flags, self.first = np.zeros(int(begins[-1]), np.uint8), [int(x) - max(1, lo) * w for x, (lo, _), w in zip(begins, spans, self.width, strict=False)]
        score, end_i, end_j = np.full(count, 2 * LOW if self.anywhere else LOW, np.int64), self.n.copy(), self.m.copy()
        for d, (lo, hi) in enumerate(spans):
            a, z = max(1, lo), min(hi, d - 1) + 1
            if (width := self.width[d]) < count:
                h0, h1, h2, e0, e1, g, fresh, grow, next_, pair, test, q, s = (x[:, :width].copy() for x in (h0, h1, h2, e0, e1, g, fresh, grow, next_, pair, test, q, s))
                count, bands = width, None if bands is None else tuple(x[:width] for x in bands)
            if a < z:
                np.subtract(h1[a - 1 : z], both, out=fresh[a - 1 : z])
                np.subtract(e1[a - 1 : z - 1], longer, out=grow[a:z])
                np.subtract(g[a:z], longer, out=next_[a:z])
                if self.table is None:
                    np.equal(q[a - 1 : z - 1], s[columns - d + a : columns - d + z], out=test[a:z])
                    np.multiply(test[a:z], more_for_match, out=pair[a:z])
                    np.add(pair[a:z], mismatch, out=pair[a:z])
                else:
                    pair[a:z] = self.table[q[a - 1 : z - 1], s[columns - d + a : columns - d + z]]
                own, gap, down, along = pair[a:z], h0[a:z], e0[a:z], g[a:z]
                own += h2[a - 1 : z - 1]
                np.maximum(fresh[a - 1 : z - 1], grow[a:z], out=down)
                np.maximum(fresh[a:z], next_[a:z], out=along)
                np.maximum(down, along, out=gap)
                f, bit, bits = self.flags[begins[d] : begins[d + 1]].reshape(z - a, count), test[a:z], test[a:z].view(np.uint8)
                # flags from the highest down, each pushed up by those that follow
                compares = [(np.greater, next_[a:z], fresh[a:z]), (np.greater, grow[a:z], fresh[a - 1 : z - 1]), (np.greater_equal, down, along), (np.greater, own, gap)]
                if self.clamp:  # the best is 0 where neither a step nor a gap is more
                    np.less_equal(own, zero, out=f.view(bool))
                    np.less_equal(gap, zero, out=bit)
                    np.bitwise_and(f, bits, out=f)
                for compare, x, y in compares:
                    np.add(f, f, out=f)
                    compare(x, y, out=bit)
                    np.bitwise_or(f, bits, out=f)
                np.maximum(own, gap, out=gap)
                if self.clamp:
                    np.maximum(gap, zero, out=gap)
            for i in {0, d}:
                if lo <= i <= hi:
                    h0[i], e0[i], g[i] = 0 if self.clamp or not d else -(self.opening + self.extension * d), low, low
            if bands is not None:
                at = d - 2 * np.arange(lo, hi + 1)[:, None]
                if len(at) and (out := (at < bands[0]) | (at > bands[1])).any():
                    h0[lo : hi + 1][out], e0[lo : hi + 1][out], g[lo : hi + 1][out] = low, low, low
                for i in (lo - 1, hi + 1):
                    if 0 <= i <= rows:
                        h0[i], e0[i], g[i] = low, low, low
            if lo <= hi and self.anywhere:
                top = h0[lo : hi + 1].max(0)
                # of equal ends the one counts that comes first in the query, then in the subject
                if len(near := np.flatnonzero(top >= score[:count])):
                    i = lo + h0[lo : hi + 1, near].argmax(0)
                    more = (top[near] > score[near]) | (i < end_i[near])
                    near, i = near[more], i[more]
                    score[near], end_i[near], end_j[near] = top[near], i, d - i
            elif not self.anywhere:
                ends = np.flatnonzero((total == d) & (self.n >= lo) & (self.n <= hi))
                score[ends] = h0[self.n[ends], ends]
            h0, h1, h2, e0, e1 = h2, h0, h1, e1, e0
        # an end beyond a text is the first one found only if its band leaves the texts out
        return np.where((end_i > self.n) | (end_j > self.m), LOW, score), end_i, end_j

    def back(self, b, i, j):
        """Operations of a pair, last first, and the place of its beginning."""
        ops, gap = bytearray(), 0
        flags, first, width = memoryview(self.flags), self.first, self.width
        while i and j:
            flag = flags[first[i + j] + i * width[i + j] + b]
            if gap:
                op = gap
            elif flag & STOP:
                return ops, i, j
            else:
                op = 0 if flag & DIAGONAL else 1 if flag & QUERY else 2
            ops.append(op)
            if op == 0:
                i, j = i - 1, j - 1
            elif op == 1:
                i, gap = i - 1, 1 if flag & LONGER_I else 0
            else:
                j, gap = j - 1, 2 if flag & LONGER_D else 0
        if self.clamp:
            return ops, i, j
        return ops + bytes([1 if i else 2]) * (i or j), 0, 0

    def results(self):
        score, end_i, end_j = self.forward()
        lost = score < self.low // 2
        out = []
        for b in range(len(self.pairs)):
            if lost[b]:
                out.append(dict.fromkeys(("score", "cigar", "query_start", "query_end", "subject_start", "subject_end", "matches", "distance")))
                continue
            ops, first_i, first_j = self.back(b, int(end_i[b]), int(end_j[b]))
            own, (q, s) = np.frombuffer(ops, np.uint8)[::-1], map(_codes, self.pairs[b])
            first = np.flatnonzero(np.concatenate((np.ones(min(1, len(own)), bool), own[1:] != own[:-1])))
            runs = np.diff(np.append(first, len(own)))
            i, j = (first_i + np.cumsum(own != 2) - 1)[own == 0], (first_j + np.cumsum(own != 1) - 1)[own == 0]
            matches = int((q[i] == s[j]).sum())
            out.append({
                "score": int(score[b]), "cigar": "".join(f"{k}{_OPS[own[a]]}" for k, a in zip(runs.tolist(), first.tolist(), strict=True)), "query_start": first_i, "query_end": int(end_i[b]),
                "subject_start": first_j, "subject_end": int(end_j[b]), "matches": matches, "distance": len(own) - matches,
            })
        return out


def likeness(length: int) -> int:
    """Lengths with one number differ by a fourth at most, or by few bases."""
    return int(np.log1p(length / 16) / np.log(1.25))


def align_many(pairs: list[tuple[str, str]], mode: str = "global", match: int = 1, mismatch: int = -2, opening: int = 5, extension: int = 2, bands: list[tuple[int, int]] | None = None, cells: int = BATCH, matrix: tuple[str, np.ndarray] | None = None) -> list[dict]:
    """What ``align`` tells of each pair, for many at once; ``bands``: the band and shift of each.

    Pairs are sorted by length, and a batch takes the next one while that is less work than a batch of its own: a step costs as much as
    ``WASTE`` cells besides its own cells.  A batch holds ``cells`` flags, and a pair that has more is aligned alone, in less memory.
    """
    size = [likeness(len(q) + len(s)) for q, s in pairs]
    order = sorted(range(len(pairs)), key=lambda x: (size[x], len(pairs[x][0]) * (1 if size[x] % 2 else -1)))
    out: list = [None] * len(pairs)
    at = 0
    plain = mismatch > 0 or opening < 0 or extension < 0  # texts of a batch are filled up with what must not score
    while at < len(order):
        some, rows, columns = [], 0, 0
        while at < len(order):
            q, s = pairs[order[at]]
            r, c, n = max(rows, len(q) + 1), max(columns, len(s) + 1), len(some)
            grown = (r + c - rows - columns) * WASTE + r * c
            if some and (plain or (n + 1) * r * c > cells or (n + 1) * min(r, c) > STEP or grown > (len(q) + len(s) + 2) * WASTE + (len(q) + 1) * (len(s) + 1)):
                break
            some.append(order[at])
            rows, columns, at = r, c, at + 1
        some.sort(key=lambda x: -len(pairs[x][0]) - len(pairs[x][1]))
        if plain or len(some) == 1 and rows * columns > cells:
            band, shift = (None, 0) if bands is None else bands[some[0]]
            out[some[0]] = align(*pairs[some[0]], mode, match, mismatch, opening, extension, band, shift, matrix=matrix)
            continue
        for x, result in zip(some, _Batch([pairs[x] for x in some], mode, match, mismatch, opening, extension, None if bands is None else [bands[x] for x in some], matrix).results(), strict=True):
            out[x] = result
    return out


def align_pairs(pairs: DataFrame, mode: str = "global", band: int | None = None, parts: int | None = None, matrix: tuple[str, np.ndarray] | None = None) -> DataFrame:
    """``pairs`` with ``query, subject`` and what ``align`` tells of them; a null text counts as empty.

    Pairs are independent rows.  They are few bytes and much work, so they are dealt over ``parts`` tasks, four for each
    core unless told otherwise, that adaptive execution does not join again.  Pairs of like lengths meet in a task, where many are aligned at
    once; large ones, which are work enough alone, go anywhere.
    """
    kinds = "score int, cigar string, query_start int, query_end int, subject_start int, subject_end int, matches int, distance int"

    @F.pandas_udf(kinds)
    def run(q: pd.Series, s: pd.Series) -> pd.DataFrame:
        pairs = [(a or "", b or "") for a, b in zip(q, s, strict=True)]
        rows = pd.DataFrame(align_many(pairs, mode, bands=None if band is None else [(band, 0)] * len(pairs), matrix=matrix), columns=[k.split()[0] for k in kinds.split(", ")])
        return rows.astype({c: "Int32" for c in rows.columns if c != "cigar"})

    like = lambda c: F.floor(F.log1p(F.coalesce(F.length(c), F.lit(0)) / 16) / F.lit(float(np.log(1.25))))
    large = F.coalesce(F.length("query").cast("long") * F.length("subject"), F.lit(0)) > LARGE
    key = F.when(large, F.xxhash64("query", "subject")).otherwise(F.xxhash64(like("query"), like("subject"), F.xxhash64("query") % 4))
    dealt = pairs.repartition(parts or 4 * pairs.sparkSession.sparkContext.defaultParallelism, key)
    return dealt.withColumn("_a", run("query", "subject")).select(*pairs.columns, "_a.*")
