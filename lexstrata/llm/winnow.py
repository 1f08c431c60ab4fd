"""Operator 9: benchmark decontamination by winnowing.

The k-gram hashes of an item's words are winnowed: of every w consecutive k-grams the smallest hash is kept. With
k + w - 1 = WINDOW, any WINDOW shared words contain a kept k-gram on both sides, since the choice depends on those words
alone. The training side keeps its own winnowed fingerprints, joins them with the fingerprints of the benchmark (a
sorted-array probe in the tasks), and extends each hit: every window that covers a joined fingerprint is compared by its
own hash and then word by word. Items of fewer than WINDOW words have one window of their own length, which winnowing
can't promise to touch; their lengths are few, and for each of them every run of that many words is probed.

A benchmark of at most `block_words` words (by its bytes, counted first) is probed in the tasks, and the corpus is not shuffled.
A larger one is never gathered: its windows and fingerprints are tables, the documents' fingerprints are joined with them in Spark,
and only windows around the hits are compared. Both ways give the same rows.

Defined results: a null or empty text has no words: n_words 0, not contaminated. Null, empty or wordless items never
occur; an item without id is counted, and named by an empty string. Repeated documents get a row each; repeated items
with the same id count as one. An empty benchmark contaminates nothing. Extra columns are kept by `decontaminated`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared
from .textkit import PLAIN, Words, batches, sliding_min

WINDOW = 13
GRAM = 5
FIELDS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("items_sha256", T.StringType()),
        T.StructField("contaminated", T.BooleanType()),
    ]
)


def winnowed(hashes: np.ndarray, doc: np.ndarray, w: int) -> np.ndarray:
    """Indexes of k-grams that are the smallest of some w consecutive ones of their text (all equal minima are kept)."""
    if len(hashes) < w:
        return np.zeros(0, np.int64)
    low = sliding_min(hashes, w)
    low[doc[: len(low)] != doc[w - 1 :]] = 0  # windows across texts choose nothing
    best = low.copy()
    # a k-gram is chosen if its hash equals the minimum of any window that holds it
    chosen = np.zeros(len(hashes), bool)
    for k in range(w):
        chosen[k : k + len(best)] |= (hashes[k : k + len(best)] == best) & (best != 0)
    return np.flatnonzero(chosen)


class Block:
    """Windows and fingerprints of some benchmark items, for probing."""

    def __init__(self, items: list[tuple[str, str]], window: int, gram: int):
        self.window, self.gram = window, gram
        kept: dict[int, dict[int, set[tuple[str, tuple[bytes, ...]]]]] = {}
        prints: list[np.ndarray] = []
        for name, text in items:
            w = Words([(text or "").encode("utf-8", "surrogatepass")], PLAIN, True)
            n = len(w.starts)
            if not n:
                continue
            words = [w.raw[s:e].tobytes() for s, e in zip(w.starts.tolist(), w.ends.tolist(), strict=True)]
            m = min(n, window)
            at, h = w.grams(m)
            for i, x in zip(at.tolist(), h.tolist(), strict=True):
                kept.setdefault(m, {}).setdefault(x, set()).add((name, tuple(words[i : i + m])))
            if m == window:
                g, gh = w.grams(gram)
                prints.append(gh[winnowed(gh, w.doc[g], window - gram + 1)])
        self.prints = np.unique(np.concatenate(prints)) if prints else np.zeros(0, np.uint64)
        self.by_length = {m: (np.array(sorted(d), np.uint64), d) for m, d in kept.items()}

    def probe(self, w: Words) -> Iterator[tuple[int, int, str]]:
        """(first word, length, item) of every occurring window; words as indexes into w."""
        for m, (keys, items) in self.by_length.items():
            at, h = w.grams(m)
            if m == self.window:
                g, gh = w.grams(self.gram)
                if not len(g):
                    continue
                mine = winnowed(gh, w.doc[g], self.window - self.gram + 1)
                hits = g[mine[found(gh[mine], self.prints)]]
                if not len(hits):
                    continue
                near = np.zeros(len(w.starts) + 1, np.int32)  # starts of windows that cover a hit
                np.add.at(near, np.maximum(hits - (self.window - self.gram), 0), 1)
                np.add.at(near, hits + 1, -1)
                keep = np.cumsum(near)[at] > 0
                at, h = at[keep], h[keep]
            ok = found(h, keys)
            for i, x in zip(at[ok].tolist(), h[ok].tolist(), strict=True):
                words = tuple(w.raw[s:e].tobytes() for s, e in zip(w.starts[i : i + m].tolist(), w.ends[i : i + m].tolist(), strict=True))
                for name, other in items[x]:
                    if other == words:
                        yield i, m, name


def found(x: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(x), bool)
    return keys[np.minimum(np.searchsorted(keys, x), len(keys) - 1)] == x


def _scan(block: Block):
    """Adds the spans and items that the benchmark hits."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            row = batch.column(0)
            texts = row.field("text").to_pylist()
            spans, items = [set() for _ in texts], [set() for _ in texts]
            counts = [0] * len(texts)
            for lo, raw in batches(texts):
                w = Words(raw, PLAIN, True)
                counts[lo : lo + len(raw)] = w.counts.tolist()
                for i, m, name in block.probe(w):
                    d = int(w.doc[i])
                    spans[lo + d].add((i - int(w.cut[d]), m))
                    items[lo + d].add(name)
            yield pa.RecordBatch.from_arrays(
                [row, pa.array([[list(x) for x in sorted(s)] for s in spans], pa.list_(pa.list_(pa.int64()))), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(counts, pa.int64())],
                ["r", "spans", "items", "n_words"],
            )

    return run


def _digest(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        row, counts = batch.column(0), batch.column(3).to_pylist()
        hit, n_items, sha = [], [], []
        for spans, items in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            n = end = 0
            for s, m in sorted(map(tuple, spans or [])):
                n += max(0, s + m - max(s, end))
                end = max(end, s + m)
            hit.append(n)
            n_items.append(len(items or []))
            sha.append(hashlib.sha256(",".join(sorted(items or [])).encode("utf-8", "surrogatepass")).hexdigest())
        bad = [h > 0 and 20 * h >= n for h, n in zip(hit, counts, strict=True)]
        yield pa.RecordBatch.from_arrays([row, pa.array(counts, pa.int64()), pa.array(hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(sha, pa.string()), pa.array(bad, pa.bool_())], ["r", *FIELDS.names])


def fingerprints(w: Words, m: int, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) by which windows of m words meet: winnowed grams for whole windows, else the windows themselves."""
    if m < window:
        return w.grams(m)
    at, h = w.grams(gram)
    kept = winnowed(h, w.doc[at], window - gram + 1) if len(at) else at
    return at[kept], h[kept]


def _spelled(w: Words, i: int, m: int) -> bytes:
    return b" ".join(w.raw[s:e].tobytes() for s, e in zip(w.starts[i : i + m].tolist(), w.ends[i : i + m].tolist(), strict=True))


def _table(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(names), kinds, strict=True)], names)


def _item_windows(window: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = Words([(text or "").encode("utf-8", "surrogatepass")], PLAIN, True)
                m = min(len(w.starts), window)
                at, h = w.grams(m) if m else ([], np.zeros(0, np.uint64))
                out = [(name, m, x, _spelled(w, i, m)) for i, x in zip(list(at), h.view(np.int64).tolist(), strict=True)]
                yield _table(out, ["item", "m", "h", "words"], [pa.string(), pa.int32(), pa.int64(), pa.binary()])

    return run


def _prints(lengths: list[int] | None, window: int, gram: int):
    """Fingerprints of texts for windows of some lengths; of items (None) for the length that their own windows have."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            keys = [batch.column(0).to_numpy(), batch.column(1).to_numpy()]
            for lo, raw in batches(batch.column(2).to_pylist()):
                if lengths is None:
                    parts = [(lo + k, m, *fingerprints(w, m, window, gram)) for k, x in enumerate(raw) if (m := min(window, len((w := Words([x], PLAIN, True)).starts)))]
                    parts = [(np.full(len(at), k), m, at, h) for k, m, at, h in parts]
                else:
                    w = Words(raw, PLAIN, True)
                    parts = []
                    for m in lengths:
                        at, h = fingerprints(w, m, window, gram)
                        parts.append((lo + w.doc[at], m, at - w.cut[w.doc[at]], h))
                for own, m, at, h in parts:
                    yield pa.RecordBatch.from_arrays([pa.array(keys[0][own]), pa.array(keys[1][own]), pa.array(np.full(len(at), m, np.int32)), pa.array(at.astype(np.int64)), pa.array(h.view(np.int64))], ["k1", "k2", "m", "pos", "g"])

    return run


def _windows_near(window: int, gram: int):
    """The windows of a text that cover one of its hits (m, pos)."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for k1, k2, text, hits in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                w = Words([(text or "").encode("utf-8", "surrogatepass")], PLAIN, True)
                n, want = len(w.starts), set()
                for x in hits:
                    m, p = x["m"], x["pos"]
                    want |= {(m, i) for i in range(max(0, p - (window - gram)) if m == window else p, p + 1) if i + m <= n}
                out = []
                for m in sorted({m for m, _ in want}):
                    _, h = w.grams(m)
                    h = h.view(np.int64)
                    out += [(k1, k2, i, m, int(h[i]), _spelled(w, i, m)) for mm, i in want if mm == m]
                yield _table(out, ["k1", "k2", "i", "m", "h", "words"], [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()])

    return run


def _counted(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        counts: list[int] = []
        for _, raw in batches(batch.column(0).field("text").to_pylist()):
            counts += Words(raw, PLAIN, True).counts.tolist()
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(counts, pa.int64())], ["r", "spans", "items", "n_words"])


def _joined(rows: DataFrame, items: DataFrame, window: int, gram: int, state: T.StructType) -> DataFrame:
    """Struct r, spans, items and n_words of every row, by joins; a text is named by 128 bits of hash."""
    spark, text = rows.sparkSession, F.col("r.text").cast("string")
    keyed = rows.select("r", F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"))
    texts = keyed.select("k1", "k2", F.col("r.text").cast("string").alias("text"))
    kinds = "k1 long, k2 long, m int, pos long, g long"
    with shared.scratch(spark) as tmp:
        known = tmp.written(items.mapInArrow(_item_windows(window), "item string, m int, h long, words binary"), "item-windows")
        lengths = [r.m for r in known.select("m").distinct().collect()]  # `window` numbers at most
        prints = items.select(F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), "text").mapInArrow(_prints(None, window, gram), kinds)
        prints = tmp.written(prints.select("m", "g").distinct(), "item-prints")
        hits = tmp.written(texts.mapInArrow(_prints(lengths, window, gram), kinds).join(prints, ["m", "g"], "left_semi").select("k1", "k2", "m", "pos").distinct(), "hits")
        near = tmp.written(hits.groupBy("k1", "k2").agg(F.collect_list(F.struct("m", "pos")).alias("hits")), "hit-texts")  # within one text
        again = shared.marked(tmp, texts, "k1", near.select(F.col("k1").alias("h"))).where("may").dropDuplicates(["k1", "k2"])
        around = again.join(near, ["k1", "k2"]).select("k1", "k2", "text", "hits").mapInArrow(_windows_near(window, gram), "k1 long, k2 long, i long, m int, h long, words binary")
        found = around.join(known, ["m", "h", "words"]).groupBy("k1", "k2").agg(F.collect_set(F.array(F.col("i"), F.col("m").cast("long"))).alias("spans"), F.collect_set("item").alias("items"))
        found = shared.written(found, "contaminated-texts")
    marked = shared.marked(shared.Scratch(spark), keyed, "k1", found.select(F.col("k1").alias("h")))
    none = [F.lit(None).cast(state[c].dataType).alias(c) for c in ("spans", "items")]
    both = marked.where("may").join(found, ["k1", "k2"], "left").select("r", "spans", "items").unionByName(marked.where("NOT may").select("r", *none))
    return both.mapInArrow(_counted, state)


def judged(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, block_words: int = 500_000) -> DataFrame:
    """Struct r with all columns of docs, and what the benchmark hits in each row."""
    rows = shared.packed(docs)
    state = T.StructType([rows.schema["r"], T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("n_words", T.LongType())])
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text"))
    size, n = items.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    if (size or 0) + n <= 16 * block_words:
        rows = rows.mapInArrow(_scan(Block([(r.item, r.text) for r in items.collect()], window, gram)), state)
    else:
        rows = _joined(rows, items, window, gram, state)
    return rows.mapInArrow(_digest, T.StructType([rows.schema["r"], *FIELDS]))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    return judged(docs, benchmark).where(~F.col("contaminated")).select("r.*")
