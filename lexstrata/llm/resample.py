"""Operator 13: importance resampling towards a target distribution.

Features are all runs of 1 to `longest` consecutive words (ASCII letters lower-cased), joined by one space; a feature's bucket is
the unsigned CRC-32 of its UTF-8 bytes modulo `buckets`. Two hashed bag-of-words models are counted, of the raw and of the target
texts; a bucket's gain is the logarithm of their ratio (add-one smoothing, thousandths, floored), a document's weight the floored
mean gain of its features. Gumbel noise from a hash of the id turns the highest `percent` scores into a sample without replacement.

Words are read by a byte automaton over the Arrow buffers: a lookup table classifies every byte, differences of neighbours give
the starts and ends of words, and the CRCs of all words advance together, one byte of each in a step (longest words first, so that
those still running are a prefix of the array). The few words that are longer than STEPS bytes finish in zlib, from the same state.

Counts are added up in the tasks, so each sends at most `buckets` rows. Scores are whole numbers of bounded range: a histogram of
them gives the lowest score that is drawn, and only documents from there on are sorted, by ranges; the sorted rows are a written
table with each row's place in its range, so ranks don't change if an executor is lost.

Defined results: a null or empty text has no features, weight 0 and is never drawn while least_words is above 0; a null doc_id is
hashed as an empty string and sorts first; repeated rows are documents of their own (with one score, and ranks that follow each
other in any order); empty tables give no rows, an empty target counts as no features. Extra columns are kept in `r`.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import shared
from .textkit import BATCH_BYTES, LOWER, PLAIN

BUCKETS = 10_000
PERCENT = 10
LEAST_WORDS = 20
SEED = 2024
#: Bytes of a word that are taken in common steps.
STEPS = 64

_U32 = np.uint32


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=_U32)
    for _ in range(8):
        c = np.where(c & _U32(1), (c >> _U32(1)) ^ _U32(0xEDB88320), c >> _U32(1))
    return c


CRC_TABLE = _crc_table()


def advanced(state: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC states after the bytes raw[start:end] of each, all in step."""
    sizes = ends - starts
    order = np.argsort(-np.minimum(sizes, STEPS + 1), kind="stable")
    sizes, at, state = sizes[order], starts[order], state[order]
    running = np.searchsorted(-np.minimum(sizes, STEPS + 1), -np.arange(1, STEPS + 2), side="right")  # with at least k bytes
    for k in range(STEPS):
        n = running[k]
        if not n:
            break
        s = state[:n]
        state[:n] = CRC_TABLE[(s ^ raw[at[:n] + k]) & _U32(0xFF)] ^ (s >> _U32(8))
    for i in range(running[STEPS]):
        rest = raw[at[i] + STEPS : at[i] + sizes[i]].tobytes()
        state[i] = zlib.crc32(rest, int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    out = np.empty_like(state)
    out[order] = state
    return out


def word_bounds(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts that follow each other without a gap; a word ends with its text."""
    inside = PLAIN[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[bounds] = True
    at = np.flatnonzero(edge)
    starts = at[:-1][inside[at[:-1]]]
    return starts, at[np.searchsorted(at, starts, side="right")]


def features(raw: np.ndarray, bounds: np.ndarray, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text of each feature, its bucket, words of each text)."""
    raw = LOWER[raw]
    n = len(bounds) - 1
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n, np.int64)
    starts, ends = word_bounds(raw, bounds)
    doc = np.searchsorted(bounds, starts, side="right") - 1
    state = advanced(np.full(len(starts), 0xFFFFFFFF, _U32), raw, starts, ends)
    docs, found = [doc], [state]
    for k in range(1, longest):
        m = max(len(starts) - k, 0)
        state = state[:m]
        state = CRC_TABLE[(state ^ _U32(0x20)) & _U32(0xFF)] ^ (state >> _U32(8))
        state = advanced(state, raw, starts[k:], ends[k:])
        same = doc[:m] == doc[k:]
        docs.append(doc[:m][same])
        found.append(state[same])
    crc = np.concatenate(found) ^ _U32(0xFFFFFFFF)
    return np.concatenate(docs), (crc % _U32(buckets)).astype(np.int64), np.bincount(doc, minlength=n)


def runs(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and bounds of an Arrow string array (null as empty), in runs of rows of about BATCH_BYTES."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(at, at[first] + BATCH_BYTES, side="right")) - 1)
        yield raw[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def _count(longest: int, buckets: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in rows:
            for raw, bounds in runs(batch.column(0)):
                total += np.bincount(features(raw, bounds, longest, buckets)[1], minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts (column text) in each bucket that has any."""
    return shared.text_batches(texts).select("text").mapInArrow(_count(longest, buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of each bucket; what comes to the driver are `buckets` counts of each side."""
    sides = []
    for texts in (raw, target):
        counts = np.zeros(buckets, object)
        for r in bucket_counts(texts, longest, buckets).collect():
            counts[r.bucket] = r.n
        sides.append(counts)
    (s, t), (all_s, all_t) = sides, [int(x.sum()) for x in sides]
    return np.array([math.floor(1000 * math.log(((b + 1) * (all_s + buckets)) / ((a + 1) * (all_t + buckets)))) for a, b in zip(s, t, strict=True)], np.int64)


def _weigh(gain: np.ndarray, longest: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            words, n, sums = [], [], []
            for raw, bounds in runs(batch.column(0).field("text")):
                doc, bucket, w = features(raw, bounds, longest, len(gain))
                words.append(w)
                n.append(np.bincount(doc, minlength=len(w)))
                own = np.zeros(len(w), np.int64)
                np.add.at(own, doc, gain[bucket])
                sums.append(own)
            join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
            n, sums = join(n), join(sums)
            cols = [pa.array(x, pa.int64()) for x in (join(words), n, sums // np.maximum(n, 1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["r", "n_words", "n_features", "weight"])

    return run


def weighted(docs: DataFrame, gain: np.ndarray, longest: int = 1) -> DataFrame:
    """Struct r with all columns of docs, n_words, n_features and weight."""
    rows = shared.packed(docs)
    return rows.mapInArrow(_weigh(gain, longest), T.StructType([rows.schema["r"], *(T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight"))]))


def scored(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds score: the weight and Gumbel noise from the hash of `seed:doc_id`."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("r.doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return rows.withColumn("score", F.col("weight") + noise.cast("long"))


def ranked(tmp: shared.Scratch, rows: DataFrame, drawn: int) -> DataFrame:
    """rank from 1 for the `drawn` highest scores (ties to smaller doc_id), null for the other rows.

    Rows of equal score and id may be a large part of all; the place of a row in the scan keeps ranges apart then.
    """
    placed = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(F.desc("score"), F.col("r.doc_id"), F.col("_row"))
    placed = placed.sortWithinPartitions(F.desc("score"), "r.doc_id", "_row").drop("_row").withColumn("_at", F.monotonically_increasing_id())
    placed = tmp.written(placed, "ranges")  # places are part of the table: they can't change any more
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    out = placed.withColumn("_part", part).join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part")
    rank = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return out.select(*rows.columns, F.when(rank <= drawn, rank).alias("rank"))


def resampled(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Struct r with all columns of docs but the text, n_words, n_features, weight, score and rank (null for those not drawn)."""
    tmp = shared.Scratch(docs.sparkSession)
    rows = scored(weighted(docs, gains(docs, target, longest, buckets), longest), seed)
    rows = tmp.written(rows.withColumn("r", F.col("r").dropFields("text")) if len(docs.columns) > 1 else rows, "weights")
    may = F.col("n_words") >= least_words
    hist = sorted(rows.where(may).groupBy("score").agg(F.count("*").alias("n")).collect(), reverse=True)  # scores have some 2^17 values
    drawn = percent * sum(r.n for r in hist) // 100
    seen, lowest = 0, None
    for r in hist:
        if seen >= drawn:
            break
        seen, lowest = seen + r.n, r.score
    if lowest is None:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    top = may & (F.col("score") >= lowest)
    return ranked(tmp, rows.where(top), drawn).unionByName(rows.where(~top).withColumn("rank", F.lit(None).cast("long")))
