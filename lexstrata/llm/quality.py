"""Operator 6: quality rules by divergence from language references.

Every text gives two histograms: of character classes, and of the common words of COMMON_WORDS (with one bin for all other
words). The reference of a language is the mean of the normalised histograms of all its texts that pass the base rules and
have MIN_WORDS words: sums per language, combined in the tasks before they are shuffled. A text is kept if it passes the base
rules and its Jensen-Shannon distances (base 2, 0 to 1) from the reference of its language, and their sum, stay below the
limits; the distance of common words counts only from MIN_WORDS words on, as short texts are too sparse for it.

Defined results: a null text has no words and fails the base rules; a null language is a language of its own; a language
without a reference (no long enough text) is judged by the base rules alone; an empty table gives an empty result. Repeated
rows get a row each. Extra columns are kept by `clean`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared
from .textkit import SPACED, Words, batches, byte_table, mix

#: Frequent function words of English, German, French and Spanish.
COMMON_WORDS = (
    "the of and to in a is that for it was on are with be by as this at not "
    "der die das und in den von zu mit sich ist im nicht ein eine auf für dem des als auch "
    "le la les de des du et un une en que dans est pour par qui sur ne pas au "
    "el los las y que del se con por su lo como una no es al"
).split()
MIN_WORDS = 100
CHAR_LIMIT = 0.28
WORD_LIMIT = 0.5
SUM_LIMIT = 0.5
#: More languages than this are joined without broadcast.
BROADCAST_LANGUAGES = 4096

SYMBOLS = byte_table("#*$%&|<>")
CLASSES = [byte_table(bytes(range(0x61, 0x7B))), byte_table(bytes(range(0x41, 0x5B))), byte_table("0123456789"), byte_table(" \t\n\x0b\x0c\r"), byte_table(".,;:!?"), byte_table("'\"()-_/[]{}"), SYMBOLS, byte_table(bytes(range(0xC0, 0x100)))]
#: The class of each byte; UTF-8 continuation bytes have none, what no class names comes last.
CLASS_OF = np.full(256, len(CLASSES), np.int64)
for _k, _table in enumerate(CLASSES):
    CLASS_OF[_table] = _k
CLASS_OF[0x80:0xC0] = -1
N_CLASSES = len(CLASSES) + 1

_WORDS = sorted(set(COMMON_WORDS))
_HASHES = Words([" ".join(_WORDS).encode()], SPACED, False).hashes
_ORDER = np.argsort(_HASHES)
N_WORD_BINS = len(_WORDS) + 1

FEATURES = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("chars", T.ArrayType(T.IntegerType())), T.StructField("words", T.ArrayType(T.IntegerType()))]
)


def dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    c = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return c[bounds[1:]] - c[bounds[:-1]]


def features(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The counts and histograms of some texts."""
    w = Words(texts, SPACED, False)
    n, bounds = w.counts, w.bounds
    first = (w.raw & 0xC0) != 0x80
    firsts = np.concatenate(([0], np.cumsum(first, dtype=np.int64)))
    chars = np.bincount(w.doc, weights=firsts[w.ends] - firsts[w.starts], minlength=len(texts)).astype(np.int64)
    at, h = w.grams(3)
    h = mix(h + w.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    again = np.zeros(len(h), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(w.starts), bool)
    for k in range(3):
        covered[at[again] + k] = True
    repeat = np.bincount(w.doc[covered], minlength=len(texts))
    kind = CLASS_OF[w.raw]
    kind[bounds[1:] - 1] = -1  # the separators
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    seen = kind >= 0
    hist = np.bincount(owner[seen] * N_CLASSES + kind[seen], minlength=len(texts) * N_CLASSES).reshape(-1, N_CLASSES)
    lower = Words(texts, SPACED, True) if len(texts) else w
    slot = np.minimum(np.searchsorted(_HASHES[_ORDER], lower.hashes), len(_HASHES) - 1)
    bin_of = np.where(_HASHES[_ORDER][slot] == lower.hashes, _ORDER[slot], N_WORD_BINS - 1)
    common = np.bincount(lower.doc * N_WORD_BINS + bin_of, minlength=len(texts) * N_WORD_BINS).reshape(-1, N_WORD_BINS)
    return {"n_words": n, "word_chars": chars, "n_symbols": per_text(SYMBOLS[w.raw], bounds), "n_repeat_words": repeat, "chars": hist, "words": common}


def _measure(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        texts = batch.column(0).field("text").to_pylist()
        parts = [features(raw) for _, raw in batches(texts)]
        got = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else features([])
        dup = np.array([dup_lines(t or "") for t in texts], np.int64)
        failed = (got["n_words"] < 50) | (100 * got["n_repeat_words"] > 50 * got["n_words"])
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(got[c].ravel(), pa.int32()), got[c].shape[1]).cast(pa.list_(pa.int32())) for c in ("chars", "words")]
        counts = [pa.array(x, pa.int64()) for x in (got["n_words"], got["word_chars"], got["n_symbols"], dup, got["n_repeat_words"])]
        yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(failed, pa.bool_()), *lists], ["r", *FEATURES.names])


def measured(docs: DataFrame) -> DataFrame:
    rows = shared.packed(docs)
    return rows.mapInArrow(_measure, T.StructType([rows.schema["r"], *FEATURES]))


def _shares(hist: str, bins: int) -> list[Column]:
    total = F.aggregate(hist, F.lit(0), lambda a, x: a + x)
    return [F.sum(F.try_divide(F.col(hist)[i], total)) for i in range(bins)]


def references(docs: DataFrame) -> DataFrame:
    """Language, and its mean histograms."""
    rows = measured(docs.select("text", "lang")).where(~F.col("base_failed") & (F.col("n_words") >= MIN_WORDS))
    return rows.groupBy(F.col("r.lang").alias("ref_lang")).agg(F.array(*_shares("chars", N_CLASSES)).alias("ref_chars"), F.array(*_shares("words", N_WORD_BINS)).alias("ref_words"))


@F.pandas_udf(T.DoubleType())
def divergence(hist: pd.Series, ref: pd.Series) -> pd.Series:
    """Jensen-Shannon distance of two histograms, normalised here; null where one of them is missing or empty."""
    out = np.full(len(hist), np.nan)
    ok = np.flatnonzero([h is not None and r is not None and np.sum(h) > 0 and np.nansum(r) > 0 for h, r in zip(hist, ref, strict=True)])
    if len(ok):
        p, q = (np.nan_to_num(np.stack(x.iloc[ok].to_numpy()).astype(float)) for x in (hist, ref))
        p, q = p / p.sum(axis=1, keepdims=True), q / q.sum(axis=1, keepdims=True)
        m = (p + q) / 2
        js = sum(np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(m > 0, m, 1)), 0).sum(axis=1) for x in (p, q)) / 2
        out[ok] = np.sqrt(np.maximum(js, 0))
    return pd.Series(out)


def judged(docs: DataFrame, char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT, sum_limit: float = SUM_LIMIT) -> DataFrame:
    """Struct r with all columns of docs, the counts, both distances, base_failed and kept."""
    refs = shared.written(references(docs), "references")
    small = refs.count() <= BROADCAST_LANGUAGES
    rows = measured(docs).join(F.broadcast(refs) if small else refs, F.col("r.lang").eqNullSafe(F.col("ref_lang")), "left")
    rows = rows.withColumn("js_chars", F.nanvl(divergence("chars", "ref_chars"), F.lit(None))).withColumn("js_words", F.when(F.col("n_words") >= MIN_WORDS, F.nanvl(divergence("words", "ref_words"), F.lit(None))))
    good = ~F.col("base_failed") & F.coalesce(F.col("js_chars") <= char_limit, F.lit(True)) & F.coalesce(F.col("js_words") <= word_limit, F.lit(True)) & F.coalesce(F.col("js_chars") + F.col("js_words") <= sum_limit, F.lit(True))
    return rows.select("r", *FEATURES.names[:6], "js_chars", "js_words", good.alias("kept"))


def clean(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns."""
    return judged(docs).where("kept").select("r.*")

