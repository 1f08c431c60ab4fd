"""Operator 7: removal of repeated byte strings by bucket-pointer refinement.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else. Sorting every suffix of a corpus would
shuffle a row per byte. Here the suffixes that are dealt into buckets are chosen by content: of the GRAM-grams of each LENGTH-byte
window the one with the smallest hash (leftmost of equals) is the window's anchor, so equal windows have equal anchors at
equal offsets, and about one suffix in 160 is shuffled.

  1. Initial buckets: anchors by the hash of their GRAM bytes. Buckets of one anchor are done: none of its windows repeats.
  2. Anchors of a bucket with the same context (all bytes that any window through them covers) repeat in all their windows; one of
     them stands for them from here on.
  3. Contexts that are left differ somewhere. The windows of a bucket start lo to hi bytes before the anchor, and all of them
     cover the same middle part. Each half of these windows covers more, so a bucket is split into one for each half, by the
     bytes that the half covers: the old bucket and what follows (or goes before) it. Equal contexts of a half are collapsed as in 2.
     A context alone in its bucket is done. This is done to every bucket once, and to those of more than SPLIT contexts
     again, up to single windows, where all contexts of a bucket are equal. No step has more than two rows for a context.
  4. Refinement within a bucket: all suffixes of its contexts get a bucket by their first 8 bytes. A bucket of q bytes is split by
     sorting on pairs of bucket numbers: the suffix's own, and that of the suffix q bytes later. The new numbers stand for
     2 q bytes and are used again in the next round, until they stand for LENGTH bytes. A suffix alone in its bucket is done,
     and ends those that point to it. Numbers are ranks of the bytes themselves, not hashes. Each task refines whole buckets
     of step 3 side by side.
  5. Spans of repeated windows are joined per document and cut out.

Strings never cross documents, are judged on the input, and overlaps count. Hashes are 64-bit, and meet only inside a
bucket of an equal 64-bit hash.

Defined results: a null or empty text has 0 bytes; texts shorter than LENGTH keep all; of repeated rows each counts, so both
lose all that is LENGTH bytes or longer; rows without doc_id are rows like others; an empty table gives an empty result; extra
columns are dropped; a text of 256 MB or more is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .textkit import batches, mix, prefix_hash, sliding_min, span_hash

LENGTH = 400
GRAM = 80
#: Largest bucket that one task refines: some 60 MB.
SPLIT = 2048
#: Contexts that are refined at once, unless their bucket is larger.
ROWS = 512
#: Bytes of the first bucket numbers of the refinement.
FIRST = 8

PART = "bucket long, context long, key long, doc long, pos long, low int, high int, lo int, hi int, edge boolean"
ANCHORS = f"{PART}, bucket0 long, context0 long, bucket1 long, context1 long"
HASHED = ["bucket", "context", "bucket0", "context0", "bucket1", "context1"]
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def part(c: np.ndarray, p: np.ndarray, low: np.ndarray, high: np.ndarray, lo: int, hi: int, length: int) -> tuple[np.ndarray, ...]:
    """Which places p have windows that start lo to hi bytes before them (theirs start low to high bytes before); of these the
    hashes of what all windows from lo to hi cover and of what their own cover. c: prefix hashes of the text."""
    ok = np.flatnonzero((low <= hi) & (high >= lo))
    at, first, last = p[ok], np.minimum(high[ok], hi), np.maximum(low[ok], lo)
    own = first.astype(np.uint64) << np.uint64(32) | last.astype(np.uint64)
    bucket = mix(span_hash(c, at - lo, at - hi + length) + np.uint64(lo << 32 | hi))
    context = mix(span_hash(c, at - first, at - last + length) + own * np.uint64(0x9E3779B97F4A7C15))
    return ok, bucket.view(np.int64), context.view(np.int64)


def halves(lo: int, hi: int) -> list[tuple[int, int]]:
    middle = (lo + hi) // 2
    return [(lo, middle), (middle + 1, hi)]


def anchors(texts: list[bytes], length: int, gram: int) -> dict[str, np.ndarray]:
    """The anchors of some texts: text, pos, bucket and context, and these of both halves (0 where a half has no window);
    windows start low to high bytes before pos."""
    w = length - gram + 1
    b = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    bounds = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    none = {c: np.zeros(0, np.int64) for c in ("text", "pos", "low", "high", *HASHED)}
    if len(b) >= 1 << 28:
        raise ValueError("a text of 256 MB or more")
    if len(b) <= length:
        return none
    c = prefix_hash(b)
    at = np.arange(len(b) - gram + 1)
    h = span_hash(c, at, at + gram)
    low = sliding_min((h & ~np.uint64(0xFFFFFFF)) | at.astype(np.uint64), w)  # leftmost of the smallest
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    starts = np.flatnonzero(np.arange(len(low)) + length <= bounds[owner[: len(low)] + 1] - 1)
    if not len(starts):
        return none
    chosen = (low[starts] & np.uint64(0xFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (np.diff(starts) != 1))))
    last = np.append(first[1:], len(starts)) - 1
    p, text = chosen[first], owner[starts[first]]
    out = {"text": text, "pos": p - bounds[text], "low": p - starts[last], "high": p - starts[first]}
    for name, (lo, hi) in zip(("", "0", "1"), [(0, w - 1), *halves(0, w - 1)], strict=True):
        ok, bucket, context = part(c, p, out["low"], out["high"], lo, hi, length)
        for column, value in ((f"bucket{name}", bucket), (f"context{name}", context)):
            out[column] = np.zeros(len(p), np.int64)
            out[column][ok] = value
    return out


def _arrays(ddl: str, columns: dict) -> pa.RecordBatch:
    """A batch with the columns of a schema."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [f.split() for f in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[name], kinds[kind]) for name, kind in fields], [name for name, _ in fields])


def _anchors(length: int, gram: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            key, doc = (batch.column(i).to_numpy() for i in (0, 1))
            for lo, raw in batches(batch.column(2).to_pylist()):
                a = anchors(raw, length, gram)
                own, n = a["text"] + lo, len(a["pos"])
                fixed = {"key": key[own], "doc": doc[own], "lo": np.zeros(n, np.int64), "hi": np.full(n, length - gram), "edge": np.ones(n, bool)}
                yield _arrays(ANCHORS, a | fixed)

    return run


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text, and a key: a hash of both; doc is doc_id without nulls."""
    rows = shared.text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), F.coalesce("doc_id", F.lit(-1)).alias("doc"), "text")


def _halved(length: int):
    """A row for each half of the windows of each context."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for key, doc, text, at in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                c = prefix_hash(np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8))
                spans = {(x["lo"], x["hi"]) for x in at}
                for whole in sorted(spans):
                    own = [x for x in at if (x["lo"], x["hi"]) == whole]
                    pos, low, high = (np.array([x[k] for x in own], np.int64) for k in ("pos", "low", "high"))
                    edge = np.array([x["edge"] for x in own])
                    for lo, hi in halves(*whole):
                        ok, bucket, context = part(c, pos, low, high, lo, hi, length)
                        n = len(ok)
                        yield _arrays(PART, {"bucket": bucket, "context": context, "key": np.full(n, key), "doc": np.full(n, doc), "pos": pos[ok], "low": np.maximum(low[ok], lo), "high": np.minimum(high[ok], hi), "lo": np.full(n, lo), "hi": np.full(n, hi), "edge": edge[ok]})

    return run


CONTEXTS = "bucket long, key long, doc long, pos long, low int, high int, hi int, edge boolean, bytes binary"


def _contexts(length: int, gram: int):
    """The bytes of the windows of each context, from hi bytes before the anchor on; what no window covers may be missing."""
    width = length + (length - gram) // 2

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for key, doc, text, at in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                for s in range(0, len(at), 2000):
                    own = at[s : s + 2000]
                    first = [x["pos"] - x["hi"] for x in own]
                    columns = {k: [x[k] for x in own] for k in ("bucket", "pos", "low", "high", "hi", "edge")}
                    cuts = [(b"\0" * max(0, -f) + raw[max(0, f) : f + width]).ljust(width, b"\0") for f in first]
                    yield _arrays(CONTEXTS, columns | {"key": [key] * len(own), "doc": [doc] * len(own), "bytes": cuts})

    return run


def matrix(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)


def repeats(b: np.ndarray, needed: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """At which `starts` in the rows of b a string of `length` bytes begins that begins at another of them, too.

    needed: the places where a suffix gets a bucket at all. Contexts of one document overlap, so of the last round only the
    starts take part: each window of a text is a start in one context.
    """
    n, m = b.shape
    q = min(FIRST, length)
    number = np.full(n * m, -1, np.int32)  # of the bucket of each suffix; -1: alone, or not looked at
    at = np.flatnonzero((needed if q < length else starts)[:, : m - q + 1]).astype(np.int32)
    at = at // (m - q + 1) * m + at % (m - q + 1)
    key = np.zeros(len(at), np.uint64)
    for k in range(q):
        key = key << np.uint64(8) | b.ravel()[at + k]
    while len(at):
        order = np.argsort(key)
        key = key[order]
        other = key[1:] != key[:-1]
        first, last = np.concatenate(([True], other)), np.concatenate((other, [True]))
        stay = ~(first & last)
        rank = np.cumsum(first, dtype=np.int32)
        number[at] = -1
        at = at[order[stay]]
        number[at] = rank[stay]
        if q == length:
            break
        step = min(q, length - q)
        at = at[at % m + step + q <= m]
        if q + step == length:
            at = at[starts.ravel()[at]]
        later = number[at + step]
        at, later = at[later >= 0], later[later >= 0]
        own = number[at]
        key = own.astype(np.uint64) * np.uint64(int(rank[-1]) + 1) + later.astype(np.uint64)
        number[:] = -1
        number[at] = own
        q += step
    return number.reshape(n, m) >= 0


def _refine(length: int):
    """Rows sorted by bucket: the spans of the windows of edges that another context of the bucket has too."""

    def spans(rows: list[dict]) -> pa.RecordBatch:
        b = matrix([r.pop("bytes") for r in rows])
        n, m = b.shape
        low, high, anchor = (np.array([r[k] for r in rows])[:, None] for k in ("low", "high", "hi"))
        place = np.arange(m)[None, :]
        starts = (place >= anchor - high) & (place <= anchor - low)
        twice = repeats(b, (place >= anchor - high) & (place < anchor - low + length), starts, length)
        out = []
        for j in np.flatnonzero(twice.any(axis=1)).tolist():
            if rows[j]["edge"]:
                on = np.flatnonzero(np.diff(np.concatenate(([0], twice[j].view(np.int8), [0])))) - rows[j]["hi"] + rows[j]["pos"]
                out += [(rows[j]["key"], rows[j]["doc"], int(s), int(e) - 1 + length) for s, e in zip(on[::2], on[1::2], strict=True)]
        cols = zip(*out, strict=True) if out else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["key", "doc", "start", "stop"])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in rows:
            for s in range(0, batch.num_rows, ROWS):
                held += batch.slice(s, ROWS).to_pylist()
                if len(held) >= ROWS:
                    cut = next((j for j in range(len(held) - 1, 0, -1) if held[j]["bucket"] != held[j - 1]["bucket"]), 0)
                    if cut:
                        yield spans(held[:cut])
                        held = held[cut:]
        if held:
            yield spans(held)

    return run


def settled(tmp: shared.Scratch, rows: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Spans of the edges whose context another row of their bucket has; and of buckets with several contexts a row for each of
    these, an edge if it is still open, with their number m."""
    more = [c for c in rows.columns if c not in ("bucket", "context")]
    own = tmp.written(rows.groupBy("bucket", "context").agg(F.count("*").alias("n"), F.min(F.struct(*more)).alias("first")), "contexts")
    # the small side of each join is a table of its own, so that a bucket of very many contexts can be split
    equal = tmp.written(own.where("n > 1").select("bucket", "context"), "equal-contexts")
    spans = rows.where("edge").join(equal, ["bucket", "context"])
    spans = tmp.written(spans.select("key", "doc", (F.col("pos") - F.col("high")).alias("start"), (F.col("pos") - F.col("low") + length).alias("stop")), "equal-spans")
    edge = F.col("first.edge") & (F.col("n") == 1)
    sizes = tmp.written(own.groupBy("bucket").agg(F.count("*").alias("m"), F.max(edge).alias("any")).where("m > 1 AND any").select("bucket", "m"), "sizes")
    open_ = tmp.written(own.join(sizes, "bucket").select("bucket", "m", edge.alias("edge"), *(f"first.{c}" for c in more if c != "edge")), "open-contexts")
    tmp.drop(own, equal, sizes)
    return spans, open_


def _with_texts(tmp: shared.Scratch, rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, doc, text and `at`, the wanted contexts of each text."""
    at = wanted.groupBy("key", "doc").agg(F.collect_list(F.struct("bucket", "pos", "low", "high", "lo", "hi", "edge")).alias("at"))  # within one text
    at = tmp.written(at, "open")
    again = shared.marked(tmp, rows.select("key", "doc", "text"), "key", at.select(F.col("key").alias("h"))).where("may")
    return again.dropDuplicates(["key", "doc"]).join(at, ["key", "doc"]).select("key", "doc", "text", "at")


def repeated(tmp: shared.Scratch, docs: DataFrame, length: int = LENGTH, gram: int = GRAM, split: int = SPLIT) -> DataFrame:
    """key, doc, start and stop of spans of repeated windows; spans of a document may overlap or touch."""
    rows = _rows(docs)
    found = tmp.written(rows.select("key", "doc", "text").mapInArrow(_anchors(length, gram), ANCHORS), "anchors")
    more = tmp.written(found.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket"), "buckets")
    first, found = found, tmp.written(found.join(more, "bucket"), "repeated-anchors")
    tmp.drop(first, more)
    whole, open_ = settled(tmp, found, length)
    spans = [whole]

    # the first split is made of hashes that came with the anchors
    half = lambda k, lo, hi: F.struct(F.col(f"bucket{k}").alias("bucket"), F.col(f"context{k}").alias("context"), "key", "doc", "pos", F.greatest("low", F.lit(lo)).alias("low"), F.least("high", F.lit(hi)).alias("high"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), "edge")
    both = open_.select(F.explode(F.array(*(half(k, lo, hi) for k, (lo, hi) in enumerate(halves(0, length - gram))))).alias("r")).select("r.*").where("low <= high")
    small = []
    while True:
        parts = tmp.written(both, "halves")
        whole, open_ = settled(tmp, parts, length)
        tmp.drop(parts)
        spans.append(whole)
        small.append(open_.where(F.col("m") <= split))
        large = open_.where(F.col("m") > split)
        if large.isEmpty():
            break
        both = _with_texts(tmp, rows, large).mapInArrow(_halved(length), PART)

    contexts = _with_texts(tmp, rows, reduce(DataFrame.unionByName, small)).mapInArrow(_contexts(length, gram), CONTEXTS)
    contexts = tmp.written(contexts, "context-bytes")
    spans.append(contexts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_refine(length), "key long, doc long, start long, stop long"))
    return reduce(DataFrame.unionByName, spans)


def _cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        out = []
        for doc, text, spans in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            kept, at, n = [], 0, 0
            for x in sorted(spans or [], key=lambda x: x["start"]):
                if not n or x["start"] > at:
                    kept.append(raw[at : x["start"]])
                    n += 1
                at = max(at, x["stop"])
            kept.append(raw[at:])
            rest = b"".join(kept)
            out.append((doc, len(raw), len(raw) - len(rest), n, rest))
        cols = zip(*out, strict=True) if out else [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def removed(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, split: int = SPLIT) -> DataFrame:
    """A row per row of docs: how much is removed, in how many runs, and the bytes that stay."""
    with shared.scratch(docs.sparkSession) as tmp:
        spans = repeated(tmp, docs, length, gram, split).groupBy("key", "doc").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
        spans = shared.written(spans, "spans")
    rows = shared.marked(shared.Scratch(docs.sparkSession), _rows(docs), "key", spans.select(F.col("key").alias("h")))
    rest = rows.where("NOT may").select("doc_id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    hit = rows.where("may").join(spans, ["key", "doc"], "left").select("doc_id", "text", "spans")
    return hit.mapInArrow(_cut, RESULT).unionByName(rest.mapInArrow(_cut, RESULT))
