import hashlib
import math
import re
import zlib
from collections import Counter

import cases
import numpy as np
import pyarrow as pa
import pytest
from lexstrata.llm import resample, shared

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def grams(text, longest):
    w = words(text)
    return [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def naive(docs, target, longest=1, buckets=10_000, percent=10, least=20, seed=2024):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = (Counter(bucket(g) for x in side for g in grams(x, longest)) for side in ([x for _, x in docs], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out = []
    for doc, text in docs:
        g = grams(text, longest)
        weight = sum(gain(bucket(x)) for x in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    may = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], -math.inf if r[0] is None else r[0]))
    for k, r in enumerate(may[: percent * len(may) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=str)


def rows(df):
    return sorted(map(tuple, df.select("r.doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


@pytest.mark.parametrize(("longest", "percent"), [(1, 10), (2, 35)])
def test_tables_against_brute_force(spark, sf, longest, percent):
    docs, target = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    want = naive([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()], longest, percent=percent)
    got = rows(resample.resampled(docs, target, longest, percent=percent))
    assert got == want and sum(r[4] is not None for r in got) > 10


def test_edge_cases(spark):
    docs = cases.table(spark)
    target = spark.createDataFrame([("One two",), (None,), ("",)], "text string")
    plain = [(i, t) for i, t, _ in cases.TEXTS]
    for least, percent in ((0, 100), (5, 50), (20, 10)):
        got = rows(resample.resampled(docs, target, least_words=least, percent=percent))
        assert got == naive(plain, ["One two", None, ""], least=least, percent=percent)
    assert rows(resample.resampled(docs, target.limit(0), least_words=0)) == naive(plain, [], least=0)
    assert rows(resample.resampled(docs.limit(0), target)) == []


def test_repeated_rows_take_ranks_of_their_own(spark):
    docs = spark.range(1000).selectExpr("id div 400 as doc_id", "'a b c' as text")
    got = [r.rank for r in resample.resampled(docs, docs, least_words=1, percent=100).collect()]
    assert sorted(got) == list(range(1, 1001))


@pytest.mark.parametrize("longest", [1, 3])
def test_automaton_against_zlib(longest):
    texts = ["", None, "Ab,c d", "é漢x" * 40 + " " + "y" * 200, "a" * 64 + " " + "b" * 65, " x", "x ", "no end", "begin \U0001f600", "0aZ~`{|}@[" * 9]
    array = pa.array(["skipped", *texts]).slice(1)
    n, found = 0, []
    for raw, bounds in resample.runs(array):
        doc, bucket, w = resample.features(raw, bounds, longest, 10_000)
        assert w.tolist() == [len(words(t)) for t in texts]
        found += zip((doc + n).tolist(), bucket.tolist(), strict=True)
        n += len(bounds) - 1
    assert n == len(texts)
    assert sorted(found) == sorted((i, zlib.crc32(g.encode()) % 10_000) for i, t in enumerate(texts) for g in grams(t, longest))


def test_ranges_split_rows_of_one_score(spark):
    rows = spark.range(3000).selectExpr("struct(7L as doc_id) as r", "0L as score")
    got = [r.rank for r in resample.ranked(shared.Scratch(spark), rows, 2000).collect()]
    assert sorted(r for r in got if r) == list(range(1, 2001)) and got.count(None) == 1000


def test_crc_table():
    assert resample.CRC_TABLE[np.array([0, 1, 255])].tolist() == [0, 0x77073096, 0x2D02EF8D]
