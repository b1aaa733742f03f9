"""Text operators against plain Python, on small tables with awkward rows."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import zstandard
from pyspark.sql import functions as F

from seqloom.llm import chat_format, components, decontamination, language_id, mixing, quality, sharding, token_counts, toxicity, warc
from seqloom.llm.common import ascii_words
from seqloom.llm.ngram_jaccard import Slices, ngram_jaccard_join

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, label string, part int"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    out = [None, "", "   \n", "one", "one two three", "ONE two three", "x " * 30]
    base = prose(rng, 120).split()
    for changes in (0, 0, 1, 2, 3, 4, 5, 8, 20):
        words = list(base)
        for _ in range(changes):
            words[rng.randrange(len(words))] = prose(rng, 1)
        out.append(" ".join(words))
    out += [prose(rng, n) for n in (5, 6, 7, 8, 9, 30, 300, 6000)]
    short = prose(rng, 10).split()
    out += [" ".join(short), " ".join([*short, "more"]), " ".join(short[1:])]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en" if i % 2 else None, ["a", "a", "b", None][i % 4], 0, 0.5, "x", 1) for i, t in texts], DOCS).repartition(3)


def grams(text, n):
    w = ascii_words(text)
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def plain_join(texts, n, percent):
    sets = {i: grams(t, n) for i, t in texts}
    links = defaultdict(set)
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                links[a].add(b)
                links[b].add(a)
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            label[a] = min([label[a], *(label[b] for b in links[a])])
    return {(i, len(sets[i]), label[i], len(links[i])) for i in sets}


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80)])
def test_ngram_join(spark, docs, texts, n, percent):
    assert set(map(tuple, ngram_jaccard_join(docs, n, percent).collect())) == plain_join(texts, n, percent)


def test_ngram_join_across_leaves(spark, docs, texts):
    assert set(map(tuple, ngram_jaccard_join(docs, 4, 85, block_rows=2).collect())) == plain_join(texts, 4, 85)


def test_ngram_join_of_nothing_and_nulls(spark, docs):
    assert ngram_jaccard_join(docs.where("false")).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (None, None), (None, "f g h i j")], "doc_id long, text string")
    got = Counter((r.doc_id, r.component_id, r.n_links) for r in ngram_jaccard_join(rows).collect())
    assert got == Counter({(None, 1, 2): 1, (1, 1, 2): 2, (None, None, 0): 2})


@pytest.mark.parametrize("block_rows", [3, 2048])
def test_ngram_join_of_repeated_ids_and_a_large_group(spark, block_rows):
    rng = random.Random(11)
    base = prose(rng, 60).split()
    rows = []
    for i in range(60):  # near copies of one text, some under one doc_id
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(60)] = prose(rng, 1)
        rows.append((i // 2, " ".join(words)))
    rows += [(i, prose(rng, 40)) for i in range(20)] + [(7, base[0])] * 2
    want = plain_join([(k, t) for k, (_, t) in enumerate(rows)], 4, 85)
    smallest = {label: min(rows[k][0] for k, _, other, _ in want if other == label) for _, _, label, _ in want}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter(map(tuple, ngram_jaccard_join(df, block_rows=block_rows).collect())) == Counter((rows[k][0], n, smallest[label], links) for k, n, label, links in want)


def test_ngram_join_null_id_before_the_same_text(spark):
    base = prose(random.Random(6), 100)
    rows = [(None, base), (7, base), (3, base + " more")]
    got = ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(None, 3), (7, 3), (3, 3)}


def test_near_copies_with_null_and_repeated_ids(spark):
    import corpus_pipeline as P

    rng = random.Random(7)
    a, b, c, d, e = (prose(rng, 100) for _ in range(5))
    rows = [(None, a), (None, b), (None, b + " more"), (None, c), (4, c + " more"), (5, d), (5, e), (5, e), (6, d), (2, a + " and more"), (None, None)]
    got = P.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), "").collect()
    left = [(r.doc_id, r.text) for r in got]
    one = [x for x in left if x[1] in (b, b + " more")]
    assert len(one) == 1 and one[0][0] is None
    assert sorted(map(str, (x for x in left if x not in one))) == sorted(map(str, [(2, a + " and more"), (4, c + " more"), (5, d), (5, e), (None, None)]))


def test_slices_name_a_common_key():
    import numpy as np

    rng = np.random.default_rng(1)
    s = Slices(85)
    for n in (7, 20, 150, 2000):
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
            lost = int(0.15 * len(a) / 1.85)  # replaced elements that still link
            b = np.unique(np.concatenate((a[lost:] if lost else a, rng.integers(0, 2**63, lost, dtype=np.uint64))))
            common = len(np.intersect1d(a, b))
            if 100 * common >= 85 * (len(a) + len(b) - common) and common < len(a):
                assert np.intersect1d(s.keys(a), s.keys(b)).size


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(9)] + [(None, 3), (50, 50)], "a long, b long")
    got = dict(map(tuple, components.components(edges).collect()))
    assert got == {i: 0 for i in range(31)} | {100 + i: 100 for i in range(9)} | {50: 50}


def test_toxicity(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, 60) + (" you badword fool " if i % 3 == 0 else " ") + prose(rng, 60)) for i in range(240)] + [(900, "you badwords"), (901, ""), (902, None), (903, "you b4dw0rd"), (904, prose(rng, 9000) + " you badword fool " + prose(rng, 9)), (None, "you badword fool"), (905, "x"), (905, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit(1), "toxic": F.lit(0), "predicted": F.lit(3)})
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(240)] + [(5, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).collect()}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in held) for i in range(240))
    assert sum(got[i].predicted == (i % 3 == 0) for i in held) >= 0.9 * len(held)
    assert got[903].predicted == got[904].predicted == got[None].predicted == 1 and got[None].held_out is None
    assert toxicity.score_toxicity(docs.where("false"), toxicity.fit_toxicity(docs.where("false"), labels)).count() == 0
    assert got[900].predicted == 1 and got[901].score == got[902].score and 0 <= got[901].score <= 1


def test_chat_format(spark):
    rows = [(1, 0, "user", "hi <|im_end|> \\ there"), (1, 1, "assistant", "<|im_start|>"), (1, 1, "assistant", None), (2, 5, None, "x" * 2000), (2, 3, "as\nsist", "<"), (2, 4, "assistant", "é\\<|" * 400)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.format_chats(df.withColumn("formatted", F.lit(1))).collect()}
    for conv in (1, 2):
        turns = [(r or "", t or "") for _, _, r, t in sorted(((c, n, r or "", t or "") for c, n, r, t in rows if c == conv))]
        said, loss = "".join(f"{r}\n{t}\n" for r, t in turns), "".join(t for r, t in turns if r == "assistant")
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.format_chats(df.where("false")).count() == 0


def test_log_folding(spark):
    log = [(1, 0, 7, 0, "start", "user", ""), (1, 0, 7, 1, "delta", None, "a"), (1, 0, 7, 2, "edit", None, "b"), (1, 0, 7, 3, "delta", None, "c"), (1, 1, 8, 0, "start", "assistant", ""), (1, 1, 8, 1, "delta", None, "x"), (1, 1, 8, 2, "regenerate", None, None), (1, 1, 8, 4, "delta", None, "z"), (1, 1, 8, 3, "delta", None, "y")]
    got = chat_format.reconstruct(spark.createDataFrame(log, "conv_id long, turn long, message long, seq int, kind string, role string, text string")).collect()
    assert {(r.turn, r.role, r.text) for r in got} == {(0, "user", "bc"), (1, "assistant", "yz")}


def test_mixing(spark):
    rows = [(i, "abc"[min(2, i // 200)] if i % 11 else None) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    for weights in (None, {"a": 3.0, "b": 1.0, "c": 2.0}):
        got = mixing.mix_sources(df, weights, block=4, slots=100).collect()
        assert len(got) == 700 and len({r.mix_position for r in got if r.mix_position is not None}) == sum(r.mix_position is not None for r in got)
        taken = [r for r in got if r.in_target]
        assert taken
        if weights:
            share = mixing.whole_weights(weights, 100)
            for slot in range(1, max(r.mix_slot for r in taken) + 1):
                blocks = Counter(s for s, _ in {(r.mix_group, r.mix_block) for r in taken if r.mix_slot < slot})
                assert all(abs(blocks[s] - slot * w / 100) < 1 for s, w in share.items())
    assert mixing.mix_sources(df.where("false")).count() == 0


def plain_mix(rows, weights, slots, block):
    """Each row's position by a schedule that is simulated slot by slot."""
    share = mixing.whole_weights(weights, slots)
    order, turn, out = mixing.period(share), Counter(), []
    blocks = {s: -(-sum(x == s for x in rows) // block) for s in share}
    for slot in range(slots * max(-(-blocks[s] // share[s]) for s in share)):
        s = order[slot % slots]
        if turn[s] < blocks[s]:
            out += [(s, turn[s], slot)]
        turn[s] += 1
    return out


def test_mixing_against_a_simulation_with_awkward_columns(spark):
    rows = [(i // 2 if i % 7 else None, "abc"[min(2, i // 150)] if i % 11 else None) for i in range(500)]
    names = ["part", "within", "offset", "at", "share", "i", "slot", "mix_key", "mix_number", "mix_slot", "n", "s", "count"]
    df = spark.createDataFrame(rows, "doc_id long, source string").withColumns({c: F.lit(5) for c in names})
    got = mixing.mix_sources(df, slots=50, block=4).collect()
    sources = ["\u0000null" if s is None else s for _, s in rows]
    counts = Counter(sources)
    want = plain_mix(sources, {s: n**0.7 for s, n in counts.items()}, 50, 4)
    assert {(r.mix_group, r.mix_block, r.mix_slot) for r in got} == set(want)
    assert all(r[c] == 5 for r in got for c in names if c != "mix_slot") and len(got) == 500
    assert len({r.mix_position for r in got}) == 500
    many = spark.createDataFrame([(i, f"s{i % 40}") for i in range(400)], "doc_id long, source string")
    assert Counter(r.mix_group for r in mixing.mix_sources(many, most_sources=30).collect())[mixing.OTHER] == 100


def test_pfair_period():
    for weights in ({"a": 1, "b": 1}, {"a": 7, "b": 2, "c": 1}, {"a": 617, "b": 211, "c": 172}):
        seen = Counter()
        total = sum(weights.values())
        for t, s in enumerate(mixing.period(weights), 1):
            seen[s] += 1
            assert all(abs(seen[x] - t * w / total) < 1 for x, w in weights.items())
        assert dict(seen) == weights


def test_language(spark):
    rng = random.Random(8)
    make = {"x": lambda: " ".join(rng.choice(["alpha", "beta", "gamal", "delat"]) for _ in range(40)), "y": lambda: " ".join(rng.choice(["zuzu", "ouizz", "wozu", "ziwo"]) for _ in range(40))}
    rows = [(i, make["xy"[i % 2]](), "xy"[i % 2]) for i in range(120)] + [(500, None, "x"), (501, "12 .. 3 \u00bd \u00b2 \u2461", "x"), (None, make["x"](), None), (504, make["y"]() * 400, None), (505, make["y"](), None), (505, make["y"](), None), (502, make["x"]() + " " + " ".join([make["y"]()] * 3), None)]
    four = ["".join(rng.choice(a) for _ in range(6)) for a in ["abcd", "efgh", "ijkl", "mnop"] for _ in range(60)]
    rows += [(1000 + i, " ".join(four[i // 30 * 60 : i // 30 * 60 + 60]), "efgh"[i // 30]) for i in range(120)] + [(2000, " ".join(four), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"score": F.lit(1), "lang_pred": F.lit(2), "languages": F.lit(3)})
    got = {r.doc_id: r for r in language_id.identify_languages(df, language_id.fit_language_model(df)).collect()}
    assert all(got[i].lang_pred == "xy"[i % 2] for i in range(120))
    assert got[500].lang_pred == got[501].lang_pred == "und" and got[502].lang_pred == "y" and set(got[502].languages) == {"x", "y"}
    assert abs(got[502].languages["y"] - 0.75) < 0.1
    assert (got[None].lang_pred, got[504].lang_pred, got[505].lang_pred) == ("x", "y", "y") and set(got[2000].languages) == set("efgh")
    empty = language_id.fit_language_model(df.where("false"))
    assert {r.lang_pred for r in language_id.identify_languages(df, empty).collect()} == {"und"}


def test_token_counts(spark, texts, docs):
    vocabulary = token_counts.read_vocabulary()
    counter = token_counts.BpeCounter(vocabulary)
    for text in ["a b", " a", "a  b", "a \n b", "a\n b", "a b ", "don't 12 $x\tz", "é ñ  ü", "a\n \nb", " x y"]:
        assert counter.count(text) == counter.whole(text), text
    want = Counter()
    kept = {}
    for i, t in texts:
        kept.setdefault(t or "", i)
    for t, i in kept.items():
        key = (["a", "a", "b", None][i % 4], "en" if i % 2 else None)
        want[(*key, "words")] += len(ascii_words(t)) + 1
        want[(*key, "byte_bpe_50k")] += counter.whole(t) + 1
    got = {(r.source, r.lang, r.tokenizer): r.n_tokens for r in token_counts.maintain_counts(docs, vocabulary).collect()}
    assert got == {k: v for k, v in want.items()}


def test_rollup_commits_once(spark, tmp_path):
    r = token_counts.Rollup(spark, str(tmp_path / "r"))
    change = spark.createDataFrame([("insert", "s", "l", "t", 5, None), ("revise", "s", "l", "t", 9, 5), ("delete", "s", "m", "t", 2, None)], "kind string, source string, lang string, tokenizer string, n_tokens long, old_tokens long")
    assert r.totals().count() == 0
    assert r.apply("1", change) and not r.apply("1", change)
    assert {tuple(x) for x in r.totals().collect()} == {("s", "l", "t", 1, 9), ("s", "m", "t", -1, -2)}


def test_warc(spark, tmp_path):
    rows = [(-1, "m", "one"), (None, "n", "one"), (3, "u", "<p>é</p>"), (1, "v\n", "<p>é</p>"), (2, "w", None), (5, None, ""), (7, "x", "z" * 300000), (None, "y", "<p>é</p>"), (7, "x", "z" * 300000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = str(tmp_path / "w")
    got = warc.warc_round_trip(df, path).collect()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        revisit = i != first[h or ""]
        want.append(str((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first[h or ""] if revisit else None)))
    assert sorted(str(tuple(r)) for r in got) == sorted(want)
    bundle = warc.BundleReader(spark.read.parquet(path).where("n_records > 0").first().data)
    name = bundle.index[0][0]
    assert warc.parse_record(bundle.get(name)[0])["page_id"] == name
    files = warc.export_bundles(spark.read.parquet(path), (tmp_path / "files").as_uri()).collect()
    plain = b"".join(zstandard.ZstdDecompressor().stream_reader(open(f.file, "rb"), read_across_frames=True).read() for f in files)
    heads = plain.count(b"WARC/1.1\r\n")
    assert heads == plain.count(b"\r\nWARC-Date: ") == len(rows)
    assert len(set(re.findall(rb"WARC-Record-ID: (\S+)", plain))) == len(rows)
    extra = df.withColumns({"payload": F.lit("x"), "sha1": F.lit(1), "first": F.lit(2), "n": F.lit(3)})
    assert sorted(str(tuple(r)) for r in warc.warc_round_trip(extra).collect()) == sorted(want)
    assert warc.warc_round_trip(df.where("false")).count() == 0


def test_sharding(spark, docs, texts):
    got = {r.doc_id: r for r in sharding.shard_documents(docs, 5).collect()}
    for i, t in texts:
        data = (t or "").encode()
        assert (got[i].size, got[i].text_crc32, got[i].law) == (len(data) + 8, zlib.crc32(data), "key")
        assert got[i].grown_shard in (got[i].shard, 5)
    slots = defaultdict(list)
    for r in got.values():
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    grown = {r.doc_id: r.shard for r in sharding.shard_documents(docs, 6).collect()}
    assert all(grown[i] == got[i].grown_shard for i in grown)
    again = spark.createDataFrame([(None, "a"), (None, "a"), (3, None), (3, None), (3, "b"), (-1, "é" * 9000)], "doc_id long, text string")
    rows = sharding.shard_documents(again.withColumns({"part": F.lit(1), "slot": F.lit(2), "size": F.lit(3)}), 4).collect()
    assert len(rows) == 6 and len({r.shard for r in rows if r.doc_id is None}) == len({r.shard for r in rows if r.doc_id == 3}) == 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows))) for s in {r.shard for r in rows})
    assert sharding.shard_documents(docs.where("false")).count() == 0
    for i, _ in texts:  # the shard once more, in plain Python, from the draws
        draws = spark.range(1).select(*(sharding.draw(F.lit(i).cast("long"), k).alias(f"d{k}") for k in range(6))).first() if i < 4 else None
        assert draws is None or (max(range(5), key=lambda k: draws[k]), max(range(6), key=lambda k: draws[k])) == (got[i].shard, got[i].grown_shard)
    heavy = Counter(r.shard for r in sharding.shard_documents(spark.range(6000).selectExpr("id AS doc_id", "'' AS text"), 3, [1.0, 1.0, 4.0]).collect())
    assert abs(heavy[2] / 6000 - 2 / 3) < 0.03


def test_quality(spark, texts, docs):
    got = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    for i, t in texts:
        words, t = [w for w in (t or "").encode().split()], t or ""
        at = Counter(tuple(words[j : j + 8]) for j in range(len(words) - 7))
        inside = {j + k for j in range(len(words) - 7) if at[tuple(words[j : j + 8])] > 1 for k in range(8)}
        lines = [x for x in t.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
        want = (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside), len(words) < 20 or 100 * len(inside) > 30 * len(words))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert not (r.base_failed and r.kept)
    assert got[len(texts) - 4].n_words == 6000 and got[len(texts) - 4].kept


def test_quality_bands(spark):
    rng = random.Random(12)
    noise = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(4000))
    words = prose(rng, 40).split()  # few words, so it compresses as prose does
    text = " ".join(rng.choice(words) for _ in range(2000))
    spaced = lambda x: " ".join(x[i : i + 60] for i in range(0, len(x), 60))
    rows = [(1, text[:2048] + " " + spaced(noise)[:1500]), (2, text[:3500]), (3, spaced(noise)), (4, None), (5, ""), (None, text[:3500]), (2, text[:3500])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ratio": F.lit(1), "kept": F.lit(2)})
    bands = quality.Bands(whole=((0, 0.1, 1.05),), chunk_band=(0.1, 0.6))
    got = quality.quality_rules(df, bands).collect()
    press = zstandard.ZstdCompressor(level=3)
    for r, (i, t) in zip(got, rows, strict=True):
        data = (t or "").encode()
        at = [k for k in range(0, len(data), 2048) if k + 2048 <= len(data)]
        at += [len(data) - 2048] if at and at[-1] + 2048 < len(data) else []
        outside = sum(not 0.1 <= len(press.compress(data[k : k + 2048])) / 2048 <= 0.6 for k in at)
        kept = not r.base_failed and bool(data) and 0.1 <= len(press.compress(data)) / len(data) <= 1.05 and outside <= 0.25 * len(at)
        assert (r.doc_id, r.n_chunks, r.n_chunks_outside, r.kept) == (i, len(at), outside, kept)
    assert [r.kept for r in got] == [False, True, False, False, False, True, True]
    assert quality.quality_rules(df.where("false")).count() == 0


def test_decontamination(spark):
    rng = random.Random(2)
    items = [(i, prose(rng, rng.randint(12, 50))) for i in range(12)] + [(90, ""), (91, None), (92, "just four words here")]
    changed = items[3][1].split()
    changed[-1] = "other"
    rows = [(0, prose(rng, 80)), (1, prose(rng, 30) + " " + items[0][1].upper() + "! " + prose(rng, 30)), (2, items[1][1]), (3, prose(rng, 9) + " " + " ".join(changed) + " " + prose(rng, 9)), (4, None), (5, ""), (6, " ".join(items[4][1].split()[:6])), (7, items[5][1] + " " + items[6][1] + " " + items[5][1]), (8, "so just four words here then")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: (t or "").lower().replace("!", "").split()
    bag = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
    want = set()
    for d, t in rows:
        w = words(t)
        for i, it in items:
            b = bag(words(it))
            for s in range(len(w) - len(words(it)) + 1) if b else ():
                a = bag(w[s : s + len(words(it))])
                if sum((a & b).values()) >= 0.8 * sum((a | b).values()):
                    want.add((d, i))
    got = {(r.doc_id, r.item_id) for r in decontamination.find_contamination(docs, bench).collect()}
    assert got == want and {(1, 0), (2, 1), (7, 5), (7, 6), (8, 92)} <= got
    assert {r.doc_id for r in decontamination.decontaminate(docs, bench).collect()} == {d for d, _ in rows} - {d for d, _ in want}
    assert decontamination.find_contamination(docs, bench.where("false")).count() == 0


def test_decontamination_of_moved_shingles(spark):
    rng = random.Random(4)
    long = prose(rng, 46).split()
    long[40] = "thelongestwordofall"
    items = [long, prose(rng, 46).split(), prose(rng, 60).split(), prose(rng, 14).split()]
    rows = [long[:3] + long[4:] + prose(rng, 20).split()]  # 39 of 45 shingles at the text's start, all anchors one word early
    for it in items:
        n = len(it)
        for at in (1, 3, n // 2, n - 4, n - 2):
            gone, more = it[:at] + it[at + 1 :], [*it[:at], "extra", *it[at:]]
            for w in (gone, more):
                rows += [w + prose(rng, 9).split(), prose(rng, 9).split() + w, prose(rng, 9).split() + w + prose(rng, 9).split(), w]
        rows += [it[n // 2 :] + it[: n // 2], prose(rng, 9).split() + it[n // 2 :] + it[: n // 2], it[5:] + it[:5] + it]
    bag = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    want = {}
    for d, w in enumerate(rows):
        for i, it in enumerate(items):
            for s in range(len(w) - len(it) + 1):
                a, b = bag(w[s : s + len(it)]), bag(it)
                like = sum((a & b).values()) / sum((a | b).values())
                if like >= 0.8 and like > want.get((d, i), (0, 0))[1]:
                    want[d, i] = (s, like)
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(rows)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start, r.similarity) for r in decontamination.find_contamination(docs, bench).collect()}
    assert (0, 0) in want and len(want) > 40
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def test_decontamination_of_long_items_and_awkward_ids(spark):
    rng = random.Random(9)
    vocabulary = prose(rng, 5000).split()
    long = [rng.choice(vocabulary) for _ in range(40_000)]
    item = " ".join(rng.choice(vocabulary) for _ in range(40))
    same = "na " * 30
    clean = prose(rng, 50)
    rows = [(1, " ".join(["x", *long[:30_000], "y", *long[30_001:]])), (2, clean), (2, "so " + item), (None, item), (None, clean), (3, same), (3, same), (4, same + clean)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(long)), (2, item), (2, item), (3, same), (None, clean)], "item_id long, text string")
    got = sorted(decontamination.find_contamination(docs, bench).collect(), key=str)
    assert {(r.doc_id, r.item_id, r.start) for r in got} == {(1, 1, 1), (2, 2, 1), (None, 2, 0), (3, 3, 0), (4, 3, 0)} and len(got) == 5
    left = decontamination.decontaminate(docs, bench).collect()
    assert sorted(map(str, map(tuple, left))) == sorted(map(str, [(2, clean), (None, clean)]))


def test_source_mix_keeps_all_rows(spark):
    import corpus_pipeline as P

    rows = [(i, f"text {i}", "one" if i == 0 else None if i == 1 else "ab"[i % 2]) for i in range(40_000)]
    got = P.source_mix(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), "").collect()
    assert sorted(map(tuple, got)) == rows
    assert {r.source for r in got[:200]} >= {"a", "b"}


def like_item(text, item):
    """The largest bag similarity of a window of the item's length."""
    words, n = text.lower().split(), sum(item.values()) + 4
    bags = (Counter(zip(*(words[at + k : at + n] for k in range(5)), strict=False)) for at in range(len(words) - n + 1))
    return max((sum((b & item).values()) / sum((b | item).values()) for b in bags), default=0)


def test_pipeline_on_awkward_documents(spark, tmp_path, docs, texts):
    import corpus_pipeline as P

    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, texts[-5][1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = docs.select("doc_id", "text", "lang", "source", "n_chars")
    columns = left.columns
    kept = [(i, t) for i, t in texts if t and t.strip()]
    firsts = {label for i, n, label, _ in plain_join(kept, P.NEAR_WORDS, P.NEAR_PERCENT)}
    want = [{i for i, _ in kept}, firsts]
    item = Counter(zip(*(texts[-5][1].split()[k:] for k in range(5)), strict=False))
    held = {i for i, t in kept if i in firsts and like_item(t, item) >= 0.8}
    assert held
    want += [firsts - held] * 3
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, left, str(tmp_path)).write.parquet(str(tmp_path / name))
        left = spark.read.parquet(str(tmp_path / name))
        ids = {r.doc_id for r in left.select("doc_id").collect()}
        assert ids == want[k]
        if k == 2:
            mixed = mixing.mix_sources(left).select("doc_id", "mix_position").collect()
        if k < len(P.STAGES) - 1:
            assert left.columns == columns
    place = {r.doc_id: r.mix_position for r in mixed}
    assert len(set(place.values())) == len(mixed) == len(want[3])
    again = P.run(spark, str(tmp_path)).collect()
    plain = {r.doc_id: r for r in sharding.shard_documents(docs.where(F.col("doc_id").isin(list(want[4])))).collect()}
    known = dict(texts)
    by_shard = defaultdict(list)
    for r in again:
        want_row = plain.pop(r.doc_id)
        assert all(r[c] == want_row[c] for c in sharding.COLUMNS if c != "slot") and r.text == known[r.doc_id]
        by_shard[r.shard].append((r.slot, place[r.doc_id]))
    assert not plain
    for found in by_shard.values():  # slots follow the mix, which they do not if the mix is left out
        assert [slot for slot, _ in sorted(found)] == list(range(len(found)))
        assert [at for _, at in sorted(found)] == sorted(at for _, at in found)


def test_slots_follow_the_rows_as_written(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.randrange(500), f"text {rng.random()}", rng.choice("abc"), "en", 7) for _ in range(3000)]
    kind = "doc_id long, text string, source string, lang string, slot int"
    spark.createDataFrame(rows, kind).repartition(13).write.parquet(str(tmp_path / "t"))
    written = [[tuple(r) for r in spark.read.parquet(str(f)).collect()] for f in sorted((tmp_path / "t").glob("part-*"))]
    place = {r[1]: i for i, r in enumerate(r for part in written for r in part)}
    by_shard = defaultdict(list)
    for r in sharding.shard_as_written(spark.read.parquet(str(tmp_path / "t")), 5).collect():
        by_shard[r.shard].append((r.slot, place[r.text]))
    assert sum(map(len, by_shard.values())) == 3000
    for found in by_shard.values():
        assert [s for s, _ in sorted(found)] == list(range(len(found))) and [p for _, p in sorted(found)] == sorted(p for _, p in found)


def test_draws_in_plain_python(spark):
    """The shard of each key, with the hash and the law written out."""
    import math

    import xxhash

    def shard(key, n):
        draws = []
        for i in range(n):
            h = xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), 42)
            h = xxhash.xxh64_intdigest(i.to_bytes(4, "little", signed=True), h)
            draws.append((-1 / math.log(((h >> 11) + 0.5) / (1 << 53)), i))
        return max(draws)[1]

    got = sharding.shard_documents(spark.range(-200, 400).selectExpr("id * id * id AS doc_id", "'t' AS text"), 24).collect()
    for r in got:
        assert (r.shard, r.grown_shard) == (shard(r.doc_id, 24), shard(r.doc_id, 25))
