import zlib
from collections import Counter

import cases
import numpy as np
from lexstrata.llm import encode, grammar, shared
from pyspark.sql import functions as F

PATH = encode.public_path("word_bpe_49k.json")


def run(spark, docs, **more):
    to = shared.new_path(spark, "ids")
    grammar.write(docs, to, PATH, end=1, first_rule=49_408, **more)
    return grammar.read(to, spark).collect(), spark.read.parquet(to)


def check(docs, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    at, want = 0, []
    for i, text in sorted(docs, key=lambda r: (r[0] is not None, r[0])):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in rows)


def test_round_trip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows, files = run(spark, docs, shard_ids=9_000)
    check(docs.select("doc_id", "text").collect(), rows)
    assert files.count() > 4
    size = sum(len(r.symbols) + len(r.rules) for r in files.collect())
    assert size < 2 * sum(r.n_tokens for r in rows)


def test_edge_cases(spark):
    docs = cases.table(spark)
    rows, _ = run(spark, docs)
    check([r[:2] for r in cases.TEXTS], rows)
    assert run(spark, docs.limit(0))[0] == []


def test_grammar_round_trip_at_random():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 50, 5000):
        ids = rng.integers(0, 4, n)
        ends = np.unique(np.append(rng.integers(1, n + 1, 3), n))
        symbols, doc_ends, rules = grammar.compress(ids, ends, 10, per_round=5, least=2)
        starts = np.concatenate(([True], np.isin(np.arange(1, len(symbols)), doc_ends)))
        pairs = list(zip(symbols[:-1][~starts[1:]].tolist(), symbols[1:][~starts[1:]].tolist()))
        assert max(Counter(pairs).values(), default=0) < 2
        lengths = grammar.expansion_lengths(rules, 10)
        assert (grammar.expand(symbols, rules, lengths, 10) == ids).all()
        at = 0
        for s, e in zip([0, *doc_ends], doc_ends):
            own = grammar.expand(symbols[s:e], rules, lengths, 10)
            assert (own == ids[at : at + len(own)]).all() and at + len(own) in ends
            at += len(own)
    assert len(symbols) < 2500


def test_no_frequent_pair_is_left():
    rng = np.random.default_rng(4)
    ids = np.concatenate([rng.zipf(1.3, 60_000) % 40_000, np.tile(rng.integers(0, 40_000, 700), 30), np.full(5000, 7)])
    ends = np.arange(200, len(ids) + 200, 200).clip(max=len(ids))
    symbols, doc_ends, rules = grammar.compress(ids, ends, 49_408)
    inside = np.ones(len(symbols), bool)
    inside[doc_ends - 1] = False
    left = Counter(zip(symbols[:-1][inside[:-1]].tolist(), symbols[1:][inside[:-1]].tolist()))
    assert max(left.values()) < grammar.LEAST and len(rules) > 1000
    assert (grammar.expand(symbols, rules, grammar.expansion_lengths(rules, 49_408), 49_408) == ids).all()


def test_random_access(spark, sf):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    to = shared.new_path(spark, "ids")
    grammar.write(docs, to, PATH, end=1, first_rule=49_408, shard_ids=9_000)
    for row in docs.orderBy("doc_id").limit(3).collect() + docs.orderBy(F.desc("n_chars")).limit(2).collect():
        ids = [*t.encode(row.text, add_special_tokens=False).ids, 1]
        for begin, end in ((0, None), (0, 1), (len(ids) // 3, len(ids) // 2), (len(ids) - 1, 10**9), (len(ids), None)):
            assert [r.ids for r in grammar.decode(to, spark, row.doc_id, begin, end).collect()] == [ids[begin:end]]
    assert grammar.decode(to, spark, 10**12).count() == 0
    files = shared.new_path(spark, "ids")
    grammar.write(spark.createDataFrame([(None, "a b"), (5, "c"), (5, "d")], "doc_id long, text string"), files, PATH, end=1, first_rule=49_408)
    assert [len(r.ids) for r in grammar.decode(files, spark, None).collect()] == [3] and grammar.decode(files, spark, 5).count() == 2
