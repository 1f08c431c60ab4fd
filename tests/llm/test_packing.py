import random
import zlib
from collections import Counter, defaultdict

import cases
import numpy as np
from lexstrata.llm import encode, packing

PATH = encode.public_path("byte_bpe_50k.json")


def check(docs, rows, capacity=packing.CAPACITY):
    """Pieces against brute force, sequences gapless and within capacity."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    want = []
    for i, text in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        edges = list(range(len(ids), 0, -capacity))[::-1]
        for k, (s, e) in enumerate(zip([0, *edges], edges)):
            want.append((i, k, s, e - s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes())))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows)
    own = defaultdict(list)
    for r in rows:
        own[r.sequence_id].append((r.offset, r.length))
    for x in own.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= capacity
    least = -(-sum(r.length for r in rows) // capacity)
    return len(own), least


def test_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    used, least = check(docs.select("doc_id", "text").collect(), packing.packed(docs, PATH).collect())
    assert used <= least * 1.02 + 1


def test_edge_cases(spark):
    docs = cases.table(spark)
    check([r[:2] for r in cases.TEXTS], packing.packed(docs, PATH).collect())
    assert packing.packed(docs.limit(0), PATH).count() == 0
    rows = packing.packed(docs, PATH, capacity=5).collect()
    check([r[:2] for r in cases.TEXTS], rows, 5)


def optimum(sizes, capacity):
    """Fewest sequences, by exhaustive search."""
    best = len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for room in sorted(set(bins)):
            if room >= sizes[i]:
                rest = list(bins)
                rest.remove(room)
                place(i + 1, [*rest, room - sizes[i]])
        place(i + 1, [*bins, capacity - sizes[i]])

    place(0, [])
    return best


def test_reduction_loses_no_sequence():
    rng = random.Random(3)
    for _ in range(150):
        capacity = rng.randint(8, 40)
        sizes = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 9))), reverse=True)
        counts = np.bincount(sizes, minlength=capacity + 1)
        plan = packing.Plan(counts)
        got = Counter()
        for filling, times in plan.fillings:
            assert sum(filling) <= capacity
            for s in filling:
                got[s] += times
        assert got == Counter(sizes)
        best = optimum(sizes, capacity)
        left = [s for f, m in plan.fillings[: plan.fixed] for _ in range(m) for s in f]
        rest = list((Counter(sizes) - Counter(left)).elements())
        assert plan.reduced + (optimum(sorted(rest, reverse=True), capacity) if rest else 0) == best
        assert plan.sequences <= best + 1


def test_large_counts_stay_small_plans():
    rng = np.random.default_rng(5)
    counts = rng.integers(0, 10**9, 2049)
    plan = packing.Plan(counts)
    least = int((counts * np.arange(2049)).sum()) / 2048
    assert plan.sequences <= least * 1.01
    assert len(plan.slots()) < 50_000
