import hashlib
import re

import cases
import numpy as np
from lexstrata.llm import winnow
from lexstrata.llm.textkit import PLAIN, Words


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def naive(docs, items):
    windows = {}
    for name, text in items:
        w = words(text)
        m = min(13, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            windows.setdefault(tuple(w[i : i + m]), set()).add("" if name is None else str(name))
    out = []
    for i, text in docs:
        w = words(text)
        hit, named = set(), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                if (x := tuple(w[k : k + m])) in windows:
                    hit |= set(range(k, k + m))
                    named |= windows[x]
        sha = hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(named), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def run(docs, bench, **more):
    got = winnow.judged(docs, bench, **more).select("r.doc_id", *winnow.FIELDS.names).collect()
    return sorted(map(tuple, got), key=str)


def test_against_brute_force(spark, sf):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    want = naive(docs.select("doc_id", "text").collect(), bench.select("item_id", "text").collect())
    assert any(x[2] for x in want)
    assert run(docs, bench) == want
    assert run(docs, bench, block_words=300) == want


def test_edge_cases(spark):
    docs = cases.table(spark)
    items = [(1, "Three FOUR"), (2, None), (3, "..."), (None, "a row without"), (5, " ".join(cases.LONG.split()[100:140])), (5, "five"), (7, "one two three four five")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = naive([r[:2] for r in cases.TEXTS], items)
    assert run(docs, bench) == want
    assert run(docs, bench, block_words=1) == want
    assert {x[2] for x in run(docs, bench.limit(0))} == {0}
    assert run(docs.limit(0), bench) == []
    assert winnow.decontaminated(docs, bench).columns == docs.columns


def test_every_window_holds_a_kept_gram():
    rng = np.random.default_rng(1)
    texts = [" ".join(map(str, rng.integers(0, 4, n))).encode() for n in (5, 13, 14, 200, 12)]
    w = Words(texts, PLAIN, True)
    at, h = w.grams(5)
    kept = at[winnow.winnowed(h, w.doc[at], 9)]
    for i, _ in zip(*w.grams(13), strict=True):
        assert ((kept >= i) & (kept <= i + 8)).any()
