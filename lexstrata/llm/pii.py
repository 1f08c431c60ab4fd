"""Operator 11: personal data by weak supervision.

Base spans of four kinds (email, ip, card, phone) come from their patterns and checks and always stay. Wider nets catch further
candidates: written-out addresses ("name [at] host [dot] com"), numbers without a country code, long forms of IP addresses,
groups of digits with dots, and what the base patterns match but their checks refuse. Every candidate, base ones too, gets
a vote (for, against, none) from each labeler: pattern, checksum, gazetteer, words before it, words that speak against it, its edges,
and variety of its digits.

Candidates are grouped by kind, votes and features, and counted over all documents; expectation-maximisation over the counts of vote
patterns (at most 3^7 for each kind, so they fit the driver) estimates how often each labeler is right, and the probability of
each pattern. These label a sample of at most 2 * `train_spans` groups (by hash), to which the final span classifier is fitted: a
logistic regression on hashed shape, context and votes. Every document is then read again, and candidates with `threshold` or more join the
base spans, the best first, where they overlap none.

Defined results: null and empty texts have no spans; of candidates that overlap, the better one stays, then the first; base spans of different kinds
may overlap; without any candidate nothing is trained and only base spans are found; repeated rows get a row each; an empty table gives
no rows; extra columns are kept. Offsets are code points, ends exclusive. Patterns take time in proportion to the text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

KINDS = ("email", "ip", "card", "phone")
TRAIN_SPANS = 20_000
THRESHOLD = 0.5
DIMENSIONS = 1 << 12
ROUNDS = 50
#: Characters before and after a candidate that labelers and features see.
AROUND = 48

# The base patterns. No match can begin inside a run of digits but at its start, which the possessive forms use.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_AT = re.compile(r"\s?(?:[\[({]\s?at\s?[\])}]|@)\s?", re.I)
_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}\Z")
_HOST = re.compile(r"[A-Za-z0-9-]{1,63}(?:\s?(?:\.|[\[({]\s?dot\s?[\])}])\s?[A-Za-z0-9-]{1,63}){1,6}", re.I)
_IP6 = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
_DOTTED = re.compile(r"(?<![0-9.])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9.])")
_NATIONAL = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-]|00[1-9][0-9 -]{2,5})[0-9]{3}[ .-]?[0-9]{4}(?![0-9]|[.-][0-9])")
_DIGITS = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\W\d_]+")

#: Gazetteers: top-level domains, first digits of card issuers, country calling codes, first parts of addresses that no host has.
DOMAINS = frozenset("com org net edu gov mil int info biz io co us uk ca au de fr es it nl be ch at se no dk fi pl pt ie eu ru jp cn in br mx".split())
ISSUERS = ("4", "51", "52", "53", "54", "55", "22", "23", "24", "25", "26", "27", "34", "37", "30", "36", "38", "6011", "65", "35", "62", "50", "56", "57", "58", "67")
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "351", "352", "353", "358", "380", "420")
NO_HOST = frozenset(["0", "127", "255"])
#: Words of the context that speak for a kind, and words and signs that speak against all.
FOR = {
    "email": frozenset("mail email e contact write address reply correo courriel kontakt".split()), "ip": frozenset("ip host server address addr login logged client adresse".split()),
    "card": frozenset("card visa mastercard amex credit debit karte carte tarjeta payment".split()), "phone": frozenset("phone tel telephone call fax mobile cell contact telefon teléfono téléphone handy".split()),
}
AGAINST = frozenset("version release section isbn issn doi figure table chapter order serial number id hash code pages page vol volume art article".split())


def _edge(text: str, start: int, end: int) -> int:
    before, after = text[start - 1 : start], text[end : end + 1]
    joined = any(c.isalnum() or c in "/=_#@\\" for c in (before, after) if c)
    return -1 if joined else 1


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, from each @ outwards: the name's characters up to the last match, then the longest domain."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            low = found.end()
            yield start, low
        at = text.find("@", max(at + 1, low))


def base(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start, kind, end) of the base spans, in order, and of matches that the checks refuse."""
    good, bad = [(s, 0, e) for s, e in emails(text)], []
    for kind, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
        for m in pattern.finditer(text):
            if kind == 1:
                ok = all(map(_small, m[0].split(".")))
            else:
                digits = "".join(_DIGITS.findall(m[0]))
                ok = 12 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 9 <= len(digits) <= 15
            (good if ok else bad).append((m.start(), kind, m.end()))
    return sorted(good), bad


def wide(text: str) -> Iterator[tuple[int, int, int]]:
    """Candidates of the wider nets."""
    if "@" in text or "at" in text.lower():
        for m in _AT.finditer(text):
            head = text[max(0, m.start() - 64) : m.start()]
            name, host = _NAME.search(head), _HOST.match(text, m.end())
            if name and host:
                yield m.start() - len(name[0]), 0, host.end()
    for kind, pattern in ((1, _IP6), (2, _DOTTED), (3, _NATIONAL)):
        for m in pattern.finditer(text):
            yield m.start(), kind, m.end()


@dataclass
class Candidate:
    start: int
    kind: int
    end: int
    base: bool
    votes: str
    features: list[int]


LABELERS = ("pattern", "checksum", "gazetteer", "for", "against", "edges", "variety")


def _checks(kind: int, found: str, digits: str) -> tuple[int, int]:
    """Votes of checksum and gazetteer."""
    if kind == 0:
        last = re.split(r"[^A-Za-z0-9-]+", found.rstrip("])}"))[-1].lower()
        return (1 if last.isalpha() and 2 <= len(last) <= 24 else -1), (1 if last in DOMAINS else 0)
    if kind == 1:
        parts = re.split("[.:]", found)
        ok = ":" in found or all(map(_small, parts))
        return (1 if ok else -1), (-1 if parts[0] in NO_HOST or (len(parts[0]) > 1 and parts[0][0] == "0" and ":" not in found) else 0)
    if kind == 2:
        ok = 12 <= len(digits) <= 19 and luhn(digits)
        return (1 if ok else -1), (1 if digits.startswith(ISSUERS) else -1)
    ok = 9 <= len(digits) <= 15
    if found.startswith(("+", "00")):
        return (1 if ok else -1), (1 if digits.lstrip("0").startswith(CALLING) else -1)
    return (1 if ok else -1), (1 if digits[0] in "23456789" and digits[3:4] in tuple("23456789") else -1)


def candidate(text: str, start: int, kind: int, end: int, is_base: bool, refused: bool) -> Candidate:
    found = text[start:end]
    digits = "".join(_DIGITS.findall(found[:256]))
    before, after = text[max(0, start - AROUND) : start].lower(), text[end : end + AROUND].lower()
    words, follow = _WORD.findall(before)[-5:], _WORD.findall(after)[:2]
    checksum, gazetteer = _checks(kind, found, digits) if found else (0, 0)
    near = set(words)
    sign = before.rstrip()[-1:] in ("$", "€", "£", "#", "§") or after[:1] in ("%", "$", "€", "£")
    plain = digits in "01234567890123456789" or digits in "98765432109876543210"
    votes = [
        -1 if refused else 1, checksum, gazetteer, 1 if near & FOR[KINDS[kind]] else 0, -1 if near & AGAINST or sign else 0, _edge(text, start, end),
        -1 if digits and kind and (len(set(digits)) < 3 or plain) else 0,
    ]
    shape = re.sub(r"(.)\1{3,}", r"\1\1\1", re.sub("[A-Za-z]", "a", re.sub("[0-9]", "9", found[:64])))
    names = ["bias", f"shape {shape}", f"length {min(len(found), 64) // 4}", f"digits {min(len(digits), 20)}", *(f"before {w}" for w in words[-2:]), *(f"after {w}" for w in follow[:1]), *(f"{n} {v}" for n, v in zip(LABELERS, votes, strict=True))]
    features = sorted({zlib.crc32(f"{kind} {n}".encode()) % DIMENSIONS for n in names})
    return Candidate(start, kind, end, is_base, "".join("-0+"[v + 1] for v in votes), features)


def candidates(text: str | None) -> list[Candidate]:
    """Base spans, refused matches, and what the wider nets catch where no base span of its kind is."""
    if not text:
        return []
    good, bad = base(text)
    out = [candidate(text, s, k, e, True, False) for s, k, e in good]
    ends = {k: ([s for s, x, _ in good if x == k], [e for _, x, e in good if x == k]) for k in range(len(KINDS))}

    def free(s: int, k: int, e: int) -> bool:
        starts, own = ends[k]
        i = int(np.searchsorted(own, s, side="right"))
        return i == len(own) or starts[i] >= e

    seen = {(s, k, e) for s, k, e in good}
    for s, k, e, refused in [*((*x, True) for x in bad), *((*x, False) for x in wide(text))]:
        if (s, k, e) not in seen and free(s, k, e):
            seen.add((s, k, e))
            out.append(candidate(text, s, k, e, False, refused))
    return out


def _seen(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        found = [c for t in batch.column(0).to_pylist() for c in candidates(t)]
        columns = [pa.array([c.kind for c in found], pa.int32()), pa.array([c.votes for c in found], pa.string()), pa.array([c.features for c in found], pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(columns, ["kind", "votes", "features"])


def reliabilities(patterns: list[tuple[int, str, int]], rounds: int = ROUNDS) -> dict[tuple[int, str], float]:
    """Probability of each (kind, votes) by expectation-maximisation over their counts.

    Labelers vote independently, given the truth. Pseudo-counts say that a vote is right rather than wrong, and give way to data.
    """
    out = {}
    for kind in {k for k, _, _ in patterns}:
        own = [(v, n) for k, v, n in patterns if k == kind]
        votes = np.array([["-0+".index(c) for c in v] for v, _ in own])
        n = np.array([float(m) for _, m in own])
        lean = np.array([[4.0, 2.0, 1.0], [1.0, 2.0, 4.0]])  # of votes against, none, for: when false, when true
        p = 1 / (1 + np.exp(-(votes - 1).sum(axis=1)))
        for _ in range(rounds):
            logs = []
            for y, share in ((0, 1 - p), (1, p)):
                w = n * share
                hits = np.stack([np.bincount(votes[:, j], weights=w, minlength=3) for j in range(votes.shape[1])]) + lean[y]
                chance = np.log(hits / hits.sum(axis=1, keepdims=True))
                logs.append(np.log((w.sum() + 1) / (n.sum() + 2)) + chance[np.arange(votes.shape[1]), votes].sum(axis=1))
            p = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
        out |= {(kind, v): float(q) for (v, _), q in zip(own, p, strict=True)}
    return out


def fitted(rows: list[tuple[list[int], float, int]], steps: int = 300, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    """Weights of a logistic regression on (features, probability, count), by gradient steps scaled by each feature's own history."""
    w, past = np.zeros(DIMENSIONS), np.full(DIMENSIONS, 1e-8)
    if not rows:
        return w
    sizes = np.array([len(f) for f, _, _ in rows])
    flat, owner = np.concatenate([np.asarray(f) for f, _, _ in rows]), np.repeat(np.arange(len(rows)), sizes)
    target = np.array([p for _, p, _ in rows])
    weight = np.log2(1 + np.array([float(n) for _, _, n in rows]))  # a span of many copies counts more, not as many times
    weight /= weight.sum()
    for _ in range(steps):
        z = np.bincount(owner, weights=w[flat], minlength=len(rows))
        miss = weight * (1 / (1 + np.exp(-z)) - target)
        g = np.bincount(flat, weights=miss[owner], minlength=DIMENSIONS) + decay * w
        past += g * g
        w -= rate * g / np.sqrt(past)
    return w


def train(docs: DataFrame, train_spans: int = TRAIN_SPANS) -> np.ndarray:
    """Weights of the final classifier. Counts are of all documents; the driver takes vote patterns and a bounded sample of groups."""
    steps = 1 << 30
    with shared.scratch(docs.sparkSession) as tmp:
        found = shared.text_batches(docs).select("text").mapInArrow(_seen, "kind int, votes string, features array<int>")
        groups = tmp.written(found.groupBy("kind", "votes", "features").agg(F.count("*").alias("n")), "pii-groups")
        patterns = groups.groupBy("kind", "votes").agg(F.sum("n").alias("n"), F.count("*").alias("groups")).collect()
        chance = reliabilities([(r.kind, r.votes, r.n) for r in patterns])
        bound = steps * train_spans // max(1, sum(r.groups for r in patterns))
        h = F.pmod(F.xxhash64("kind", "votes", "features"), F.lit(steps))
        sample = groups.withColumn("h", h).where(F.col("h") < bound).orderBy("h", "kind", "votes", "features").limit(2 * train_spans).collect()
    return fitted([(r.features, chance[r.kind, r.votes], r.n) for r in sample])


def chosen(text: str | None, weights: np.ndarray, threshold: float = THRESHOLD) -> list[tuple[int, int, int, bool, float]]:
    """(start, kind, end, base, probability) of the spans of a text, in order."""
    found = [(c, float(1 / (1 + np.exp(-weights[c.features].sum())))) for c in candidates(text)]
    out = [(c.start, c.kind, c.end, True, p) for c, p in found if c.base]
    taken = sorted((s, e) for s, _, e, _, _ in out)
    for c, p in sorted((x for x in found if not x[0].base and x[1] >= threshold), key=lambda x: (-x[1], x[0].start, x[0].kind)):
        i = int(np.searchsorted([s for s, _ in taken], c.end))
        if all(e <= c.start for _, e in taken[:i]):
            out.append((c.start, c.kind, c.end, False, p))
            taken.insert(i, (c.start, c.end))
    return sorted(out)


def masked(text: str | None, spans: list[tuple[int, int, int, bool, float]]) -> str | None:
    """The text with each run of overlapping spans replaced by the kind of its first one."""
    if not spans:
        return text
    parts, at = [], 0
    for start, kind, end, _, _ in spans:
        if start >= at:
            parts += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())])


def _judge(weights: np.ndarray, threshold: float):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts = batch.column(0).field("text").to_pylist()
            spans = [chosen(t, weights, threshold) for t in texts]
            each = pa.array([[dict(zip(("kind", "start", "end", "base", "score"), (KINDS[k], s, e, b, p), strict=True)) for s, k, e, b, p in x] for x in spans], pa.list_(_SPAN))
            yield pa.RecordBatch.from_arrays([batch.column(0), each, pa.array([masked(t, x) for t, x in zip(texts, spans, strict=True)], pa.string())], ["r", "spans", "masked"])

    return run


def found(docs: DataFrame, train_spans: int = TRAIN_SPANS, threshold: float = THRESHOLD) -> DataFrame:
    """Struct r with all columns of docs; spans (kind, start, end, base, score) by start, then kind; and masked, the text without them."""
    rows = shared.packed(docs)
    span = "array<struct<kind: string, start: long, end: long, base: boolean, score: double>>"
    schema = T.StructType([rows.schema["r"], T.StructField("spans", T._parse_datatype_string(span)), T.StructField("masked", T.StringType())])
    return rows.mapInArrow(_judge(train(docs, train_spans), threshold), schema)


def redacted(docs: DataFrame, train_spans: int = TRAIN_SPANS, threshold: float = THRESHOLD) -> DataFrame:
    """docs with their spans replaced by <KIND>."""
    return found(docs, train_spans, threshold).select(F.col("r").withField("text", F.col("masked")).alias("r")).select("r.*")
