import random
import re

import cases
import numpy as np
import pytest
from lexstrata.llm import graph, jaccard, shared
from pyspark.sql import functions as F


def naive(docs, percent=90, shingle=3):
    sets = []
    for _, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} if len(w) >= shingle else {tuple(w)} if w else set())
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if docs[i][0] is None or docs[j][0] is None or not x or not y or min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
                continue
            n = len(x & y)
            if docs[i][0] == docs[j][0] or 100 * n >= percent * (len(x) + len(y) - n):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, len(sets[i]), low.get(find(i)) if d is not None else None) for i, (d, _) in enumerate(docs)), key=str)


def run(docs, **more):
    return sorted(map(tuple, jaccard.joined(docs, **more).collect()), key=str)


def test_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = naive(docs.select("doc_id", "text").collect())
    assert any(d != c for d, _, c in want)
    assert run(docs) == want


@pytest.mark.parametrize("seed", range(2))
def test_chains_and_near_copies(spark, seed):
    """Chains whose ends are far apart, stars, and groups that share all but a few words."""
    rng = random.Random(seed)
    rows, words = [], [f"w{i}" for i in range(400)]
    for _ in range(12):
        text = rng.choices(words, k=rng.randint(3, 70))
        for _ in range(rng.randint(1, 14)):
            rows.append((rng.randint(0, 10**6) * 2 + 1, " ".join(text)))
            if rng.random() < 0.7:
                text = list(text)
                text[rng.randrange(len(text))] = rng.choice(words)
    rows = list({i: (i, t) for i, t in rows}.values())
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert run(docs) == naive(rows)


def test_edge_cases(spark):
    docs = cases.table(spark)
    assert run(docs) == naive([r[:2] for r in cases.TEXTS])
    assert run(docs.limit(0)) == []
    kept = jaccard.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "5", "6", "8", "None"]


def test_groups_of_one_prefix(spark, monkeypatch):
    """Classes of equal prefix and size, linked or not, are one row in the lists and lose no link when expanded."""
    monkeypatch.setattr(jaccard, "bucket_of", lambda h: np.zeros(len(h), np.int64))
    rows = [(3 * i + k, " ".join(f"{x}{j}" for j in range(40)) + f" z{i % 4} {'y' * k}") for i, x in enumerate("abcabcabc") for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert run(docs, shingle=1, percent=95) == naive(rows, shingle=1, percent=95)
    features = "n long, p1 long, p2 long, node long, copies long, prefix array<long>, k0 long, k1 long, k2 long, k3 long"
    classes = spark.createDataFrame([(9, 1, 1, d, 2, [5, 6], d, 0, 0, 0) for d in (4, 3)] + [(9, 1, 2, 7, 1, [5, 8], 1, 0, 0, 0)], features)
    got = sorted((r.g, r.weight, r.members, r.k0) for r in jaccard.grouped(classes).collect())
    assert got == [(3, 4, 2, None), (7, 1, 1, 1)]


def test_many_texts_with_one_passage(spark):
    """Texts that share a passage and don't link."""
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(30)]
    rows = [(i, " ".join(passage + [f"x{rng.randrange(10**6)}" for _ in range(30)])) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert run(docs) == naive(rows) and all(d == c for d, _, c in run(docs))


def test_one_id_with_two_texts(spark):
    rows = [(3, "one two three four"), (5, "one two three four"), (5, "six seven eight nine"), (8, "six seven eight nine")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert run(docs) == naive(rows)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    with shared.scratch(spark) as tmp:
        got = dict(map(tuple, graph.components(tmp, spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), 200: 200, 201: 200}


def test_only_rows_that_may_go_are_joined(spark, monkeypatch):
    """Of many texts few are copies: the others are kept where they are; of repeated rows one stays."""
    text = lambda i: " ".join(f"t{i}x{j}" for j in range(12))
    rows = [(i, text(i)) for i in range(300)] + [(1000, text(7)), (1001, text(8)), (9, text(9)), (None, text(3)), (None, None)]
    marked = []
    monkeypatch.setattr(shared, "marked", lambda *a, f=shared.marked: marked.append(f(*a)) or marked[-1])
    kept = jaccard.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(kept.collect(), key=str) == sorted([(i, text(i)) for i in range(300)] + [(None, text(3)), (None, None)], key=str)
    assert 4 <= marked[-1].where("may").count() < 40


def test_components_and_marks_take_no_jobs_of_their_own(spark, monkeypatch):
    """A round of components is one written table and no other query; a bitmap is not written."""
    names = []
    monkeypatch.setattr(shared, "_write", lambda df, path, f=shared._write: names.append(path) or f(df, path))
    with shared.scratch(spark) as tmp:
        rows = shared.marked(tmp, spark.range(1000), "id", spark.range(0, 1000, 100).select(F.col("id").alias("h")))
        assert names == [] and {r.id for r in rows.where("may").collect()} >= set(range(0, 1000, 100))
        empty = graph.components(tmp, spark.createDataFrame([], "a long, b long"))
        assert empty.count() == 0 and len(names) == 2
