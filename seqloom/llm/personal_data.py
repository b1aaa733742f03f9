"""Personal data: rules, and a skip-chain conditional random field that adds what the rules miss.

The rules find e-mail addresses, IP addresses, card numbers and phone numbers; their spans always stay.  The field has a
variable for each unit of a text that looks like one of these: a span of a rule, whose label is known, or a run of numbers or a
written-out address that no rule took.  Units that follow one another share a potential, and so do distant units that repeat
or resemble each other: the same digits, the same last digits, the same address in other writing.  Loopy message
passing carries labels along both kinds of edges, so a number that a text once shows as a phone number is one wherever it returns.

Weights of units come from a softmax over features that a reader sees at a glance, learnt from what the rules say about a bounded
sample of documents.  Work is linear in a text: a unit has an edge to the next one, and to the next of each of its keys.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import rows_of

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
FEATURES = 1 << 10
#: What tells that a rule's check refuses a unit, and the label that it refuses.
REFUSED = {"no check digit": 3, "large part": 2}

# The rules' patterns.  Runs are possessive and begin where no run goes on, which matches the same at linear cost.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_SOME = re.compile(r"[0-9@]|[(\[]at[)\]]")
_NUMBER = re.compile(r"(?<![A-Za-z0-9_])\(?[0-9](?:[ ().-]{0,2}[0-9])*+")
_JOINED = re.compile(r"[A-Za-z_@]")
_AT = re.compile(r"(?P<local>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++) ?(?:@|\(at\)|\[at\]) ?(?P<domain>[A-Za-z0-9-]++(?:(?:\.| ?(?:\(dot\)|\[dot\]) ?)[A-Za-z0-9-]+)*)")
_DOT = re.compile(r" ?(?:\(dot\)|\[dot\]|\.) ?")
_BEFORE, _AFTER = re.compile(r"([^\W\d_]+)\W*$"), re.compile(r"^\W*([^\W\d_]+)")
_DIGIT = re.compile("[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each ``@``: what stands before it is the run of local characters up to the match before."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            end = found.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``start, kind, end`` of what the rules find, by start, then kind; kinds count from 0."""
    found = [(a, 0, b) for a, b in emails(text)]
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = _DIGIT.sub("", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.sub("", m[0])) <= 15]
    return sorted(found)


@dataclass
class Unit:
    start: int
    end: int
    label: int  # of LABELS, or -1 if no rule took it
    features: list[str]
    keys: list[str]


def _shape(text: str) -> str:
    """Marks as they are, runs of digits as 9, runs of letters as a."""
    return re.sub("9+", "9", re.sub("[^\\W\\d_]+", "a", re.sub("[0-9]+", "9", text)))


def units(text: str) -> tuple[list[tuple[int, int, int]], list[Unit]]:
    """The spans of the rules, and the units of a text in their order."""
    base = base_spans(text)
    taken = np.array([(a, b) for a, _, b in base], np.int64).reshape(-1, 2)
    ends = np.maximum.accumulate(taken[:, 1]) if len(taken) else taken[:, 1]

    def free(a: int, b: int) -> bool:
        """No span of a rule overlaps; spans are sorted by start."""
        i = int(np.searchsorted(taken[:, 0], b))
        return i == 0 or ends[i - 1] <= a

    spans = [(a, b, kind + 1) for a, kind, b in base]
    if "@" in text or "at)" in text or "at]" in text:
        spans += [(m.start(), m.end(), -1) for m in _AT.finditer(text) if free(m.start(), m.end())]
    for m in _NUMBER.finditer(text):
        digits = _DIGIT.sub("", m[0])
        if 7 <= len(digits) <= 19 and not _JOINED.match(text, m.end()) and free(m.start(), m.end()):
            spans.append((m.start(), m.end(), -1))
    out = []
    for a, b, label in sorted(spans):
        own = text[a:b]
        digits = _DIGIT.sub("", own)
        address = _AT.fullmatch(own)
        before, after = _BEFORE.search(text[max(0, a - 24) : a]), _AFTER.search(text[b : b + 24])
        features = ["bias", "shape " + _shape(own)[:24], "@" if address else f"digits {len(digits)}"]
        features += ["before " + before[1].lower()] if before else []
        features += ["after " + after[1].lower()] if after else []
        if not address and 12 <= len(digits) <= 19 and not luhn(digits):
            features.append("no check digit")
        if own.count(".") == 3 and any(int(p or 0) > 255 for p in own.split(".") if p.isascii() and p.isdigit() and len(p) < 9):
            features.append("large part")
        if address:
            name, domain = address["local"].lower(), _DOT.sub(".", address["domain"].lower())
            keys = [f"@{name}@{domain}", f"@{name}@{domain.split('.')[0]}"]
        else:
            keys = [f"#{digits}", f"#{digits[-7:]}"]
        out.append(Unit(a, b, label, features, keys))
    return base, out


def hashed(features: list[str]) -> list[int]:
    return [xxhash.xxh32_intdigest(f) % FEATURES for f in features]


def edges(found: list[Unit], near: int = 200) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Pairs that follow one another within ``near`` characters, and pairs that share a key: a unit and the next one with it, and
    a unit and the rule's span with it that comes last before it, or else first behind it."""
    chain = [(i, i + 1) for i in range(len(found) - 1) if found[i + 1].start - found[i].end <= near]
    last: dict[str, int] = {}
    sure: dict[str, int] = {}
    for i in reversed(range(len(found))):
        if found[i].label >= 0:
            sure.update(dict.fromkeys(found[i].keys, i))
    skip = set()
    for i, u in enumerate(found):
        for key in u.keys:
            skip.update((min(i, j), max(i, j)) for j in (last.get(key, i), sure.get(key, i)) if i != j)
            last[key] = i
            if u.label >= 0:
                sure[key] = i
    return chain, sorted(skip)


def marginals(node: np.ndarray, pairs: np.ndarray, potentials: np.ndarray, rounds: int = 20, damping: float = 0.3) -> np.ndarray:
    """Probabilities of labels by loopy message passing: ``node`` (n, L) and ``potentials`` (e, L, L) are logarithms."""
    i, j = pairs[:, 0], pairs[:, 1]
    into_i, into_j = np.zeros((len(pairs), node.shape[1])), np.zeros((len(pairs), node.shape[1]))

    def belief() -> np.ndarray:
        b = node.copy()
        np.add.at(b, i, into_i)
        np.add.at(b, j, into_j)
        return b

    def message(x: np.ndarray) -> np.ndarray:
        top = x.max(1, keepdims=True)
        m = top[:, 0] + np.log(np.exp(x - top).sum(1))
        return m - m.max(1, keepdims=True)

    for _ in range(rounds if len(pairs) else 0):
        b = belief()
        new_j = message((b[i] - into_i)[:, :, None] + potentials)
        new_i = message((b[j] - into_j)[:, :, None] + potentials.transpose(0, 2, 1))
        moved = max(np.abs(new_i - into_i).max(), np.abs(new_j - into_j).max())
        into_i, into_j = damping * into_i + (1 - damping) * new_i, damping * into_j + (1 - damping) * new_j
        if moved < 1e-4:
            break
    b = belief()
    p = np.exp(b - b.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


@dataclass(frozen=True)
class PersonalDataModel:
    weights: np.ndarray  # (FEATURES, labels)
    chain: np.ndarray  # (labels, labels)
    skip: float
    other: float
    threshold: float = 0.9

    def added(self, found: list[Unit]) -> list[tuple[int, int, int, float]]:
        """``start, kind, end, score`` of units that no rule took and that have a label but ``other``."""
        if all(u.label >= 0 for u in found):
            return []
        node = np.array([self.weights[hashed(u.features)].sum(0) for u in found])
        for row, u in zip(node, found, strict=True):
            if u.label >= 0:
                row[:] = -30.0
                row[u.label] = 0.0
                continue
            row[0] += self.other
            for feature, label in REFUSED.items():
                if feature in u.features:
                    row[label] -= self.other
        chain, skip = edges(found)
        potentials = np.concatenate((np.repeat(self.chain[None], len(chain), 0), np.repeat((self.skip * np.eye(len(LABELS)))[None], len(skip), 0)))
        p = marginals(node, np.array(chain + skip, np.int64).reshape(-1, 2), potentials)
        return [(u.start, int(q.argmax()) - 1, u.end, float(q.max())) for u, q in zip(found, p, strict=True) if u.label < 0 and q.argmax() > 0 and q.max() >= self.threshold]


def _learn(rows: list[tuple[int, list[int]]], steps: int = 300, rate: float = 0.5, decay: float = 1e-3) -> np.ndarray:
    """Softmax weights by gradient descent with momentum; each row is a label and its features."""
    weights = np.zeros((FEATURES, len(LABELS)))
    if not rows:
        weights[hashed(["bias"]), 0] = 4.0
        return weights
    x = np.zeros((len(rows), FEATURES), np.float32)
    for i, (_, features) in enumerate(rows):
        np.add.at(x[i], features, 1.0)
    y = np.eye(len(LABELS), dtype=np.float32)[[label for label, _ in rows]]
    pace = np.zeros_like(weights)
    for _ in range(steps):
        z = x @ weights.astype(np.float32)
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        pace = 0.9 * pace - rate * (x.T @ (p - y) / len(rows) + decay * weights)
        weights = weights + pace
    return weights


def fit_personal_data(docs: DataFrame, most_docs: int = 2_000, most_units: int = 8, threshold: float = 0.9, skip: float = 9.0, other: float = 4.0) -> PersonalDataModel:
    """Learn weights from the rules' word on at most ``most_docs`` documents with a digit or an ``@``, the first by a hash of
    their text, of which each gives the first ``most_units`` units; the bounds hold for learning alone.  A unit that no rule took counts as ``other``, but not
    if it resembles a span of a rule: those are for the field to decide.

    ``skip`` is the logarithm by which two alike units prefer one label, ``other`` that by which a unit that no rule took is something
    else, and by which it is not of a kind whose check it fails; ``threshold`` is the probability from which a unit is a span.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                _, found = units(text)
                sure = {key for u in found if u.label >= 0 for key in u.keys}
                found = [u for u in found if u.label >= 0 or sure.isdisjoint(u.keys)][:most_units]
                chain, skip = edges(found)
                yield pa.record_batch([pa.array([key] * len(found), pa.int64()), pa.array(range(len(found)), pa.int32()), pa.array([max(u.label, 0) for u in found], pa.int32()), pa.array([hashed(u.features) for u in found], pa.list_(pa.int32())), pa.array([(i, i + 1) in chain for i in range(len(found))], pa.bool_())], ["key", "place", "label", "features", "goes_on"])

    text = F.col("text").cast("string")
    some = docs.where(text.rlike("[0-9@]")).select(F.xxhash64(text).alias("key"), text.alias("text"))
    keys = some.select("key").distinct().orderBy("key").limit(most_docs)
    sample = some.join(F.broadcast(keys), "key", "left_semi").dropDuplicates(["key"])  # most_docs keys
    rows = sorted(sample.mapInArrow(run, "key long, place int, label int, features array<int>, goes_on boolean").collect())
    share = np.bincount([r["label"] for r in rows], minlength=len(LABELS)) + 1.0
    share /= share.sum()
    counts = 50.0 * share[:, None] * share[None]  # so few pairs say little
    for a, b in zip(rows, rows[1:], strict=False):
        if a["goes_on"] and a["key"] == b["key"]:
            counts[a["label"], b["label"]] += 1
    joint = counts / counts.sum()
    chain = np.clip(np.log(joint / (joint.sum(1)[:, None] * joint.sum(0)[None])), -1.0, 1.0)
    return PersonalDataModel(_learn([(r["label"], r["features"]) for r in rows]), chain, skip, other, threshold)


_SPANS = "array<struct<kind:string,start:int,end:int,base:boolean,score:double>>"


def find_personal_data(docs: DataFrame, model: PersonalDataModel) -> DataFrame:
    """``doc_id, spans`` of every document: ``kind, start, end, base, score``, by start, then kind; places are code points, ends exclusive.

    Spans of the rules have ``base`` and score 1.  Null text is empty; repeated rows and null ids are rows of their own; an empty table
    gives no rows; other columns are not looked at.  A text's work is linear in its length.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())]))

    def spans(text: str | None) -> list[dict]:
        if not text or not _SOME.search(text):
            return []
        base, found = units(text)
        both = [(a, k, b, True, 1.0) for a, k, b in base] + [(a, k, b, False, p) for a, k, b, p in model.added(found)]
        return [{"kind": KINDS[k], "start": a, "end": b, "base": sure, "score": p} for a, k, b, sure, p in sorted(both)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            yield pa.record_batch([batch.column("doc_id"), pa.array([spans(t) for t in batch.column("text").to_pylist()], kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, spans {_SPANS}")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span as its kind in angle brackets; where spans overlap, the first one hides what follows in it."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit("<"), s["kind"], F.lit(">"))).otherwise(acc["out"]).alias("out"), F.greatest(s["end"], acc["at"]).alias("at"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def _is_base(kind: str, span: Column) -> Column:
    return span["base"] & (span["kind"] == kind)


def personal_data_report(docs: DataFrame, model: PersonalDataModel) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone`` and ``base_sha256`` of the rules' spans, ``spans`` of all, as ``kind:start:end`` with commas between."""
    found = find_personal_data(docs, model)
    base = F.filter("spans", lambda s: s["base"])
    told = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = [F.size(F.filter("spans", partial(_is_base, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *count, F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
