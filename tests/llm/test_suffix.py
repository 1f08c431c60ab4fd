import hashlib
import random
from collections import Counter

import cases
import numpy as np
import pytest
from lexstrata.llm import queries, suffix


def naive(docs, length):
    raws = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(r[s : s + length] for _, r in raws for s in range(len(r) - length + 1))
    out = []
    for i, r in raws:
        gone = bytearray(len(r))
        for s in range(len(r) - length + 1):
            if seen[r[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        kept = bytes(b for b, g in zip(r, gone) if not g)
        n = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(r), sum(gone), n, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(docs, **more):
    return sorted(((*r[:4], hashlib.sha256(r.kept).hexdigest()) for r in suffix.removed(docs, **more).collect()), key=str)


def test_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = naive(docs.select("doc_id", "text").collect(), 400)
    assert sum(x[2] for x in want) > 1000
    assert run(docs) == want


def test_query(spark, sf):
    """The query's digests are those of the operator's bytes; passages caught are those of LENGTH bytes or more."""
    got = queries.op7_suffix_array_dedup(spark, sf)
    want = naive(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect(), 400)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == want
    assert got.where("n_removed = 0 AND octet_length(kept_text) != n_bytes").count() == 0


@pytest.mark.parametrize("length", [5, 8, 11, 40, 63])
def test_refinement(length):
    """Bucket numbers against a count of all strings; only needed places are looked at."""
    rng = np.random.default_rng(length)
    b = rng.integers(97, 99 if length < 12 else 123, (60, 90), dtype=np.uint8)
    b[20:40, 10:80] = b[:20, 5:75]
    b[40:50] = b[7]
    needed = np.zeros(b.shape, bool)
    needed[:, 3:85] = True
    starts = needed & (rng.random(b.shape) < 0.7)
    starts[:, 85 - length + 1 :] = False
    at = [(i, k) for i in range(60) for k in range(3, 85 - length + 1) if starts[i, k]]
    seen = Counter(b[i, k : k + length].tobytes() for i, k in at)
    got = suffix.repeats(b, needed, starts, length)
    assert all(got[i, k] == (seen[b[i, k : k + length].tobytes()] > 1) for i, k in at)


def test_overlaps_runs_and_large_buckets(spark):
    rng = random.Random(6)
    base = "".join(rng.choices("abcdé ", k=260))
    rows = [(0, "a" * 300), (1, "ab" * 100), (2, base), (3, base[10:200] + "X" + base[100:]), (4, "X" + base[:60] + "é" * 30)]
    for i in range(5, 60):
        s = rng.randrange(150)
        rows.append((i, "".join(rng.choices("xyz", k=rng.randint(0, 40))) + base[s : s + rng.randint(10, 110)] + "".join(rng.choices("xyz", k=rng.randint(0, 40)))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = naive(rows, 40)
    assert run(docs, length=40, gram=8) == want
    assert run(docs, length=40, gram=8, split=3) == want


def test_edge_cases(spark):
    docs = cases.table(spark)
    assert run(docs) == naive([r[:2] for r in cases.TEXTS], 400)
    assert run(docs.limit(0)) == []
