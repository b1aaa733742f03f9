"""Collocations, vector codes and personal data against plain Python, with awkward rows."""

import hashlib
import random
import re
from collections import Counter
from math import floor

import numpy as np
import pytest

from seqloom.llm import collocations as C
from seqloom.llm import personal_data as P
from seqloom.llm import vector_codes as V

DOCS = "doc_id long, text string, lang string, phrase string, f long, ids long"


# Collocations


def plain_collocations(rows, least, longest, top, absorb=100):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for size in range(1, longest + 1):
                for i in range(len(w) - size + 1):
                    f[lang or "und", tuple(w[i : i + size])] += 1
    often = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= least}
    gone = {(lang, w[i : i + s]) for (lang, w), a in often.items() for s in range(2, len(w)) for i in range(len(w) - s + 1) if 100 * a >= absorb * often[lang, w[i : i + s]]}
    out = {}
    for (lang, w), a in often.items():
        if (lang, w) not in gone:
            score, _, left, right = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return {(lang, i + 1, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for lang, found in out.items() for i, x in enumerate(sorted(found)[:top])}


@pytest.fixture(scope="module")
def phrases():
    rng = random.Random(5)
    words = [*"abcdefgh", "É", "x\x00y", "na me", "#1"]
    marks = [" ", " ", " ", "\t", "  ", ", ", "\n", ". ", "\r\n", "\x0b"]
    texts = [None, "", " \t\n", "one", "A b", "b A", "THE end the End the end", "x " * 400, "a" * 5000]
    texts += ["".join(rng.choice(words).upper() + rng.choice(marks) if rng.random() < 0.2 else rng.choice(words) + rng.choice(marks) for _ in range(rng.randrange(1, 120))) for _ in range(60)]
    texts += ["c d e f g h"] * 25 + ["kind regards from us all"] * 12
    texts.append(" ".join(rng.choice("abc") for _ in range(20_000)))
    return [(t, [None, "und", "en", "de"][i % 4]) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("least", "longest", "top", "depths"), [(5, 5, 2000, None), (3, 5, 7, (2, 3, 5)), (2, 3, 2000, (3,)), (4, 4, 50, (2, 4))])
def test_collocations(spark, phrases, monkeypatch, least, longest, top, depths):
    monkeypatch.setattr(C, "HELD", 1 << 12)  # this process; tasks have their own
    docs = spark.createDataFrame([(i, t, lang, "clash", 1, 2) for i, (t, lang) in enumerate(phrases)], DOCS).repartition(3)
    got = [tuple(r) for r in C.collocations(docs, least, longest, top, depths=depths).collect()]
    assert set(got) == plain_collocations(phrases, least, longest, top) and len(got) == len(set(got))


def test_collocations_of_nothing(spark):
    assert C.collocations(spark.createDataFrame([], DOCS), 1).collect() == []
    assert C.collocations(spark.createDataFrame([(1, "only some words", "en", "", 0, 0)], DOCS)).collect() == []


def test_tokens_of_long_texts(monkeypatch):
    monkeypatch.setattr(C, "HELD", 7)
    for text in (b"", b"one two", b"one two. three, four! five six seven eight nine", b"." * 30, b"averylongwordwithoutend and more. x"):
        assert [w for some in C.tokens(text) for w in some if w != b"."] == re.findall(rb"[^\x20\x09.,!]+", text)


def test_trie_bursts_and_spills():
    rng = np.random.default_rng(2)
    trie, want = C.HatTrie(4, burst=5), Counter()
    for _ in range(6):
        rows = rng.integers(1, 6, (300, 4)).astype(np.uint64)
        rows[rng.random(300) < 0.3, 3] = 0
        trie.add(rows)
        want.update(map(tuple, rows.tolist()))
    assert len(trie) == len(want) and any(isinstance(x, dict) and not isinstance(x, Counter) for x in trie.root.values())
    some, n = trie.spill(100)
    assert len(trie) <= 100
    rest, m = trie.spill()
    assert len(trie) == 0 and not trie.root
    assert {tuple(r): c for r, c in zip([*some.tolist(), *rest.tolist()], [*n.tolist(), *m.tolist()], strict=True)} == want
    assert {r[0] for r in some.tolist()}.isdisjoint({r[0] for r in rest.tolist()})  # whole subtrees


# Vector codes


def plain_codes(rows, parts, entries, rounds):
    kept = [(i, [floor(1024 * c) for c in x]) for i, x, _ in rows]
    width = len(kept[0][1]) // parts
    cut = lambda x, p: x[p * width : (p + 1) * width]
    first = sorted(kept)[:entries]
    books = [[cut(x, p) for _, x in first] for p in range(parts)]
    way = lambda a, b: sum((c - d) ** 2 for c, d in zip(a, b, strict=True))
    for turn in range(rounds + 1):
        codes = [[min(range(len(books[p])), key=lambda j, x=x, p=p: (way(cut(x, p), books[p][j]), j)) for p in range(parts)] for _, x in kept]
        if turn < rounds:
            for p in range(parts):
                for j in range(len(books[p])):
                    mine = [cut(x, p) for (_, x), c in zip(kept, codes, strict=True) if c[p] == j]
                    if mine:
                        books[p][j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    errors = [sum(way(cut(x, p), books[p][c[p]]) for p in range(parts)) for (_, x), c in zip(kept, codes, strict=True)]
    total = Counter()
    for (_, _, label), e in zip(rows, errors, strict=True):
        total[label] += e
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted((i, "".join(f"{c:02x}" for c in code), e, total[label], sha) for (i, _, label), code, e in zip(rows, codes, errors, strict=True))


VECTORS = "vec_id long, embedding array<float>, label int, code string, v int"


@pytest.mark.parametrize(("entries", "rounds", "spread"), [(20, 4, 1.0), (256, 4, 0.05), (40, 6, 0.01), (3, 0, 1.0)])
def test_vector_codes(spark, entries, rounds, spread):
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 1, (12, 8))
    rows = [(1000 - i, [float(np.float32(c)) for c in centres[i % 12] + rng.normal(0, spread, 8)], [None, 1, 2][i % 3]) for i in range(400)]
    rows += [(2000 + i, rows[i][1], 5) for i in range(30)]  # copies
    bad = [(-1, None, 1), (-2, [1.0, None] * 4, 1), (-3, [float("nan")] * 8, 1), (-4, [float("inf")] * 8, 1), (3000, [1.0] * 12, 1), (3001, [], 1), (3002, [1.0] * 7, 1)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows + bad], VECTORS).repartition(3)
    assert sorted(tuple(r) for r in V.compress_vectors(df, 4, entries, rounds).collect()) == plain_codes(rows, 4, entries, rounds)


def test_vector_codes_at_the_edges(spark):
    assert V.compress_vectors(spark.createDataFrame([], VECTORS)).collect() == []
    rows = [(None, [1.0] * 4, 1), (None, [2.0] * 4, None), (5, [3e38] * 4, 1)]
    got = V.compress_vectors(spark.createDataFrame([(*r, "x", 0) for r in rows], VECTORS)).collect()
    assert len(got) == 3 and {r["vec_id"] for r in got} == {None, 5}
    big = np.array([[V.LARGEST, -V.LARGEST]])
    assert V.squared(big, -big)[0, 0] == 2 * (2 * V.LARGEST) ** 2


def test_bounds_spare_scans_and_keep_results():
    rng = np.random.default_rng(3)
    rows = rng.normal(0, 300, (500, 6)).round().astype(np.int64)
    history = rows[None, None, :64].copy()
    own = bound = stamp = None
    scans = []
    for _ in range(12):
        own, best, bound, stamp, n = V.Rounds(history).assign(0, rows, own, bound, stamp)
        d = ((rows[:, None] - history[-1, 0][None]) ** 2).sum(2)
        assert (own == d.argmin(1)).all() and (best == d.min(1)).all()
        scans.append(n)
        new = history[-1].copy()
        for j in range(64):
            if (own == j).any():
                new[0, j] = np.floor(rows[own == j].mean(0))
        history = np.concatenate((history, new[None]))
    assert scans[-1] < scans[0] // 2


# Personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for at, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            odd = [sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])]
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(digits) <= 19 and sum(odd) % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), at, m.end()))
    return sorted(out)


def test_rules_match_the_patterns():
    rng = random.Random(11)
    parts = ["a", "é", "@", ".", "-", " ", "  ", "+", "(", ")", "1", "25", "255", "4568668072826647", "x.y@b.c", "+1 (476) 555-5473", "79.18.26.84", "%", "\n", "٣", "256"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 25)))
        assert P.base_spans(text) == plain_spans(text), text
    for text in ("1" * 200_000, "1." * 100_000, "a" * 200_000 + "@", "@" * 100_000, "1 " * 100_000 + "a", "+1" + " " * 100_000, "(1" * 50_000, "a (at) " * 20_000):
        P.units(text)  # linear, or this would not end


TEXTS = [
    None, "", "no data here at all", "😀 mail ann.b@host.example.com now",
    "call +1 (476) 555-5473 today. Much later, call 476 555 5473 or (476) 555-5473 again.",
    "write to joe.doe@mail.example.org, I said joe.doe (at) mail.example.org, or joe.doe@mail for short",
    "card 4568 6680 7282 6647, order 1234567 and 20231105, version 1.2.3.400", "from 79.18.26.84 to 79.18.26.84:8080",
    "paid with 4568 6680 7282 6647, printed as 4568-6680-7282-6647 and, with a slip, 9568 6680 7282 6647",
    "a code 4857014651521003, a date 20231105, a count 1234567890, (476) 555-5473, 300.400.500.600, a@b, +1 22",
]


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(4)
    name = lambda: "".join(rng.choice("abcdefg") for _ in range(6))
    rows = [f"{name()} {name()} {rng.choice(['+1 (%d) 555-%d' % (rng.randrange(200, 999), rng.randrange(1000, 9999)), name() + '.7@mail.example.com', '.'.join(str(rng.randrange(1, 255)) for _ in range(4)), 'nr ' + str(rng.randrange(10**7, 10**8))])} {name()}" for _ in range(400)]
    return P.fit_personal_data(spark.createDataFrame([(i, t, "en", "", 0, 0) for i, t in enumerate(rows + TEXTS)], DOCS))


def test_alike_units_share_labels(spark, model):
    docs = spark.createDataFrame([(i, t, "en", "", 0, 0) for i, t in enumerate(TEXTS)], DOCS)
    found = {r["doc_id"]: r["spans"] for r in P.find_personal_data(docs, model).collect()}
    for i, t in enumerate(TEXTS):
        base = [(s["start"], P.KINDS.index(s["kind"]), s["end"]) for s in found[i] if s["base"]]
        assert base == plain_spans(t or "")
    more = lambda i: {TEXTS[i][s["start"] : s["end"]]: s["kind"] for s in found[i] if not s["base"]}
    assert more(4) == {"476 555 5473": "phone", "(476) 555-5473": "phone"}
    assert more(5) == {"joe.doe (at) mail.example.org": "email", "joe.doe@mail": "email"}
    assert [more(i) for i in (2, 6, 7, 9)] == [{}, {}, {}, {}]
    assert more(8) == {"9568 6680 7282 6647": "card"}


def test_report_and_redaction(spark, model):
    rows = [(i, t, "en", "", 0, 0) for i, t in [*enumerate(TEXTS), (None, TEXTS[4]), (4, TEXTS[4])]]
    docs = spark.createDataFrame(rows, DOCS)
    got = P.personal_data_report(docs, model).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            continue
        base = plain_spans(TEXTS[r["doc_id"]] or "")
        assert [r[f"n_{k}"] for k in P.KINDS] == [sum(k == i for _, k, _ in base) for i in range(4)]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{P.KINDS[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest()
    joined = docs.select("doc_id", "text").dropDuplicates().join(P.find_personal_data(docs, model).dropDuplicates(["doc_id"]), "doc_id")
    clean = {r["doc_id"]: r["t"] for r in joined.select("doc_id", P.redacted(joined["text"], joined["spans"]).alias("t")).collect()}
    assert clean[3] == "😀 mail <email> now" and clean[2] == TEXTS[2]
    assert clean[4] == "call <phone> today. Much later, call <phone> or <phone> again."
    assert P.find_personal_data(spark.createDataFrame([], DOCS), P.fit_personal_data(spark.createDataFrame([], DOCS))).collect() == []


def test_messages_are_exact_on_a_chain():
    rng = np.random.default_rng(1)
    node, potentials = rng.normal(size=(4, 3)), rng.normal(size=(3, 3, 3))
    pairs = np.array([(0, 1), (1, 2), (2, 3)])
    want = np.zeros((4, 3))
    for y in np.ndindex(3, 3, 3, 3):
        p = np.exp(sum(node[i, y[i]] for i in range(4)) + sum(potentials[e, y[i], y[j]] for e, (i, j) in enumerate(pairs)))
        for i in range(4):
            want[i, y[i]] += p
    assert np.allclose(P.marginals(node, pairs, potentials, 60), want / want.sum(1, keepdims=True), atol=1e-3)
