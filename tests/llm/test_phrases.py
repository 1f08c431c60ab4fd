import re
from collections import Counter, defaultdict

import cases
import numpy as np
import pytest
from lexstrata.llm import phrases

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def naive(rows, least=30, longest=4, top=2000, subsumed=80):
    """Everything from counts of all runs of every piece."""
    out = []
    by_lang = defaultdict(list)
    for text, lang in rows:
        by_lang["und" if lang is None else lang].append(text or "")
    for lang, texts in by_lang.items():
        f = Counter()
        for text in texts:
            for piece in re.split("[.,;:!?\n-\r]", text.translate(LOWER)):
                words = re.findall("[^ \t]+", piece)
                for m in range(1, longest + 1):
                    f.update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
        n = sum(k for w, k in f.items() if len(w) == 1)
        found = {w: a for w, a in f.items() if len(w) > 1 and a >= least}
        over = defaultdict(int)
        for w, a in found.items():
            for m in range(2, len(w)):
                for i in range(len(w) - m + 1):
                    over[w[i : i + m]] = max(over[w[i : i + m]], a)
        ranked = []
        for w, a in found.items():
            score, _, left, right = min((2_000_000 * a // (f[w[:k]] + f[w[k:]]), k, f[w[:k]], f[w[k:]]) for k in range(1, len(w)))
            if 100 * over[w] < subsumed * a:
                ranked.append((-score, -a, " ".join(w).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(ranked)[:top], 1)]
    return sorted(out)


def rows(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def test_table_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = naive([(r.text, r.lang) for r in docs.collect()], least=5)
    assert len(want) > 100 and max(len(w[2].split(" ")) for w in want) == 4
    assert rows(phrases.mined(docs, least=5)) == want


@pytest.mark.parametrize("block", [4, 50])
def test_small_blocks_subsumption_and_ties(spark, block):
    """What a block holds changes nothing."""
    texts = [("A b c d. a b c d e; x\ty, x Y", "en")] * 9 + [("a b c d f\na  b", "en"), ("b c! b c? z é É", None), ("b c b c b c", "und"), (None, "en"), ("", None), ("..,;", "de")]
    docs = cases.table(spark, [(i, t, g) for i, (t, g) in enumerate(texts)])
    for least, top, subsumed in ((1, 2000, 80), (3, 5, 80), (2, 2000, 101), (9, 3, 1)):
        assert rows(phrases.mined(docs.repartition(3), least, 4, top, subsumed, block, block)) == naive(texts, least, 4, top, subsumed)


def test_edge_cases(spark):
    docs = cases.table(spark)
    assert rows(phrases.mined(docs, least=2)) == naive([(t, g) for _, t, g in cases.TEXTS], least=2)
    assert phrases.mined(docs.limit(0)).count() == 0
    assert phrases.mined(cases.table(spark, [(1, None, None)])).count() == 0


def test_counts_pass_64_bits(spark):
    """The product of a count and 2,000,000 has more than 64 bits."""
    big = 1 << 45
    one = spark.createDataFrame([(1, "en", "a", big), (2, "en", "b", big + 1)], "id long, lang string, word string, f long")
    two = spark.createDataFrame([(1, 1, 2, big)], "id long, a long, b long, f long")
    got = phrases.candidates([one, two]).first()
    assert (got.phrase, got.score, got.l, got.r) == ("a b", 2_000_000 * big // (2 * big + 1), big, big + 1)


def test_pieces_are_cut_at_line_ends_only(monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK", 5)
    assert list(phrases.pieces(b"aa bb cc dd\nee ff\ng")) == [b"aa bb cc dd", b"ee ff", b"g"]


def test_arrays_survive_squeezing():
    a, b = np.array([1, 1 << 40, -1, 0]), np.arange(4)
    assert [x.tolist() for x in phrases.opened(phrases.squeezed(a, b), 4, 2)] == [a.tolist(), b.tolist()]
