import hashlib
import re
import time

import cases
import numpy as np
import pytest
from lexstrata.llm import pii, queries

LOOSE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def naive(text):
    """The contract's patterns as they stand."""
    out = []
    for order, (kind, pattern) in enumerate(LOOSE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip":
                ok = all(int(p) <= 255 for p in m[0].split("."))
            elif kind == "card":
                doubled = [int(d) if i % 2 == 0 else int(d) * 2 for i, d in enumerate(reversed(digits))]
                ok = 12 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0
            else:
                ok = kind == "email" or 9 <= len(digits) <= 15
            if ok:
                out.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return [x for *_, x in sorted(out)]


HARD = [
    "a@b.c@d.e x@y z@w.v. @q.r -@-.- a@b..c %+@x-.y", "1.2.3.4.5.6.7.8 999.1.1.1 001.002.003.0004 1.2.3 256.1.1.1.1", "4111 1111-1111 1111 4111  1111 5555555555554444x 1-2-3 0000 0000 0000",
    "+1 (743) 555-3824, ++49 30 1234567 +1(((( +123456789012345678 +1 2", "é漢\U0001f600 a@b.co \U0001f600+44 20 7946 0958", "4" * 19 + " +" + "1" * 15, "", None,
]


def test_base_spans_against_the_patterns():
    rng = np.random.default_rng(7)
    texts = HARD + ["".join(rng.choice(list("12340.@+- ()ab,:\n"), 60)) for _ in range(3000)]
    for text in texts:
        good, _ = pii.base(text or "")
        assert [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in good] == naive(text), text


def test_query_on_the_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op11_pii(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    total = 0
    for r in rows:
        want = naive(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k) for x in want) for k in pii.KINDS]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert set(want) <= set(spans) and spans == sorted(spans, key=lambda x: (int(x.split(":")[1]), pii.KINDS.index(x.split(":")[0])))
        total += len(want)
    assert total > 20


@pytest.fixture(scope="module")
def corpus(spark):
    """Base spans of every kind, wider forms of them with context, and numbers that are none."""
    rng = np.random.default_rng(3)
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))

    def card():
        body = "4" + d(14)
        return body + next(c for c in "0123456789" if pii.luhn(body + c))

    rows, truth = [], {}
    for i in range(400):
        other = f"version {rng.integers(300, 999)}.{d(3)}.1.{d(2)} order number 8{d(15)}9 and section {d(3)}-{d(2)}" if i % 2 else "nothing of the kind here"
        area, rest = f"{rng.integers(200, 999)}", f"{rng.integers(200, 999)}-{d(4)}"
        hidden = [f"jo{d(2)} [at] mail{d(1)} [dot] com", f"({area}) {rest}"][i % 3 % 2]
        plain = [f"write to a{d(3)}@mail.example.com", f"host 10.{rng.integers(1, 250)}.3.4", f"visa {card()}", f"call +1 ({area}) {rest}"][i % 4]
        head = f"{plain} then {other}; contact phone "
        rows.append((i, head + hidden + " today" if i % 5 else plain + " then " + other, "en"))
        truth[i] = (len(head), len(head) + len(hidden)) if i % 5 else None
    return cases.table(spark, rows), truth


def test_wider_forms_are_found_and_numbers_left_alone(corpus):
    docs, truth = corpus
    added = {r.doc_id: [(s.start, s.end) for s in r.spans if not s.base] for r in pii.found(docs).select("r.doc_id", "spans").collect()}
    want = {i for i, t in truth.items() if t}
    assert sum(added[i] == [truth[i]] for i in want) >= 0.95 * len(want)
    assert sum(bool(added[i]) for i in set(truth) - want) <= 2


def test_redaction_and_extra_columns(corpus):
    docs, _ = corpus
    out = pii.redacted(docs.where("doc_id < 8"))
    assert out.columns == docs.columns
    texts = [r.text for r in out.collect()]
    assert len(texts) == 8 and not any(re.search(r"@|555-|\b10\.\d+\.3\.4", t) for t in texts) and any("<EMAIL>" in t for t in texts)


def test_edge_cases(spark):
    docs = cases.table(spark, [*cases.TEXTS, *((50 + i, t, "en") for i, t in enumerate(HARD))])
    rows = pii.found(docs).select("r.text", "spans").collect()
    assert len(rows) == len(cases.TEXTS) + len(HARD)
    for r in rows:
        assert [f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.base] == naive(r.text)
    assert pii.found(docs.limit(0)).count() == 0
    assert pii.found(cases.table(spark, [(1, None, None), (2, "no data", "en")])).select("spans").collect()[0].spans == []


def test_reliabilities_find_the_bad_labeler():
    """Two labelers agree with each other, the third one votes at random."""
    rng = np.random.default_rng(1)
    counts = {}
    for _ in range(5000):
        y = rng.random() < 0.4
        vote = "".join("+" if (y if rng.random() < q else not y) else "-" for q in (0.95, 0.9, 0.9, 0.5))
        counts[vote] = counts.get(vote, 0) + 1
    p = pii.reliabilities([(0, v, n) for v, n in counts.items()])
    assert p[0, "+++-"] > 0.95 and p[0, "---+"] < 0.05 and abs(p[0, "+++-"] - p[0, "++++"]) < 0.05


def test_long_runs_take_linear_time():
    began = time.perf_counter()
    for unit in ("1", "1.", "a", "a@", "+1(", "1 ", "(1) ", "a[at]", "::1", "a."):
        pii.candidates(unit * 100_000)
    assert time.perf_counter() - began < 60


def test_masks_of_overlapping_spans():
    spans = [(2, 3, 8, True, 1.0), (3, 2, 10, True, 1.0), (12, 0, 14, False, 0.9)]
    assert pii.masked("0123456789abcdef", spans) == "01<PHONE>ab<EMAIL>ef"
