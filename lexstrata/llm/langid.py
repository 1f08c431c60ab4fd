"""Operator 8: language identification by Bayesian evidence fusion.

Evidence for the language of a page, combined as log-probabilities:
  text      likelihood of the visible text under character trigram models (hashed into BUCKETS, smoothed), tempered by
            TEMPER since neighbouring trigrams aren't independent
  declared  the language of the page's markup (<html lang>), P(declared | language)
  suffix    the last label of the host, P(suffix | language)
  host      P(language | host), smoothed towards its domain, which is smoothed towards all pages

The tables of the last three are grouped counts over all pages, labelled by the text alone where the text is decisive. The
trigram models are fitted to about TRAIN_ROWS labelled documents, an even part from each language, chosen by a hash (the bound is a
parameter); the languages are counted over all rows, and everything else uses every row.

Defined results: a page without text gets its language from the other evidence; a null html or url is empty; a null or unknown
declared language is evidence like any other value; without any labelled document the language is null; repeated rows get a row
each; an empty table gives an empty result; extra columns are dropped.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .linkgraph import host_and_path

TRAIN_ROWS = 3000
#: Of each language, whatever its share.
LEAST_ROWS = 64
BUCKETS = 1 << 13
TEMPER = 0.05
#: A text decides alone if the best language leads by so much (log-odds, tempered).
DECISIVE = 3.0
#: Pseudo-counts towards the next higher level.
STRENGTH = 5.0

_HIDDEN = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>", re.S | re.I)
_TAG = re.compile(r"<[^>]*>?")
_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)


def visible(page: str | None) -> str:
    return html.unescape(_TAG.sub(" ", _HIDDEN.sub(" ", page or "")))


def trigrams(text: str) -> np.ndarray:
    """Buckets of the trigrams of letters; runs of anything else count as one space."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    letter = ((code >= 97) & (code <= 122)) | (code >= 0xC0)
    code = np.where(letter, code, 32)
    code = code[letter | np.concatenate(([True], letter[:-1]))] if len(code) else code
    if len(code) < 3:
        return np.zeros(0, np.int64)
    return ((code[:-2] * 0x9E3779B1 + code[1:-1] * 0x85EBCA77 + code[2:] * 0xC2B2AE3D) >> 7) % BUCKETS


class Models:
    def __init__(self, rows: list[tuple[str, str]]):
        self.langs = sorted({lang for _, lang in rows})
        counts = np.full((len(self.langs), BUCKETS), 0.1)
        for text, lang in rows:
            counts[self.langs.index(lang)] += np.bincount(trigrams(text), minlength=BUCKETS)
        self.log = np.log(counts / counts.sum(axis=1, keepdims=True)) if rows else counts

    def likelihood(self, text: str) -> np.ndarray:
        """Log-likelihood of a text in each language, with the largest at 0, tempered."""
        x = self.log[:, trigrams(text)].sum(axis=1) * TEMPER
        return x - x.max() if len(x) else x


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> Models:
    """Fitted to labelled texts of every language there is: of each about its even part of `rows`, LEAST_ROWS if that is more, and
    two times as many at most. They are those of the smallest hashes; the smallest one is always among them."""
    steps = 1 << 30
    known = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(steps)).alias("h"))
    langs = known.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("least")).collect()
    if not langs:
        return Models([])
    part = max(LEAST_ROWS, rows // len(langs))
    bounds = docs.sparkSession.createDataFrame([(r.lang, max(r.least, part * steps // r.n)) for r in langs], "lang string, bound long")
    first = Window.partitionBy("lang").orderBy("h", "text")
    sample = known.join(F.broadcast(bounds), "lang").where("h <= bound").withColumn("k", F.row_number().over(first)).where(F.col("k") <= 2 * part).select("text", "lang")
    return Models(sorted((r.text, r.lang) for r in sample.collect()))


def _read(models: Models):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            pages = batch.column(1).to_pylist()
            declared = [(m[1].lower().partition("-")[0] if (m := _LANG.search(p or "")) else "") for p in pages]
            scores = [models.likelihood(visible(p)).tolist() for p in pages]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(declared, pa.string()), pa.array(scores, pa.list_(pa.float64()))], ["page_id", "host", "declared", "text"])

    return run


def identified(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, host, declared, lang, confidence and text_lang (the language by the text alone)."""
    models = train(docs)
    langs = models.langs
    host, _ = host_and_path(F.col("url"))
    read = shared.text_batches(pages).select("page_id", "html", host.alias("host")).mapInArrow(_read(models), "page_id long, host string, declared string, text array<double>")
    if not langs:
        none = F.lit(None)
        return read.select("page_id", "host", "declared", none.cast("string").alias("lang"), none.cast("double").alias("confidence"), none.cast("string").alias("text_lang"))
    top = F.sort_array("text", asc=False)
    names = F.array(*map(F.lit, langs))
    best = F.get(names, F.array_position("text", F.array_max("text")).cast("int") - 1)
    sure = F.get(top, 0) - F.coalesce(F.get(top, 1), F.lit(-1e9)) >= DECISIVE
    parts = F.split("host", r"\.")
    read = read.withColumn("text_lang", F.when(sure, best)).withColumn("suffix", F.element_at(parts, -1)).withColumn("domain", F.concat_ws(".", F.slice(F.concat(F.array(F.lit(""), F.lit("")), parts), -2, 2)))
    read = shared.written(read, "page-evidence")
    sums = [F.sum((F.col("text_lang") == x).cast("double")).alias(f"n{i}") for i, x in enumerate(langs)]
    n = [F.coalesce(F.col(f"n{i}"), F.lit(0.0)) for i in range(len(langs))]
    total = sum(n[1:], n[0])
    known = read.where("text_lang IS NOT NULL")
    every = [float(x or 0) for x in known.agg(*sums).first()]
    prior = [(x + 1) / (sum(every) + len(langs)) for x in every]

    def given(column: str, name: str) -> DataFrame:
        """P(value | language) of a column with few values, as logs."""
        return known.groupBy(column).agg(*sums).select(column, F.array(*(F.log((n[i] + 0.5) / (every[i] + STRENGTH)) for i in range(len(langs)))).alias(name))

    def smoothed(level: DataFrame, above: list, name: str, key: str) -> DataFrame:
        return level.select(key, F.array(*((n[i] + STRENGTH * above[i]) / (total + STRENGTH) for i in range(len(langs)))).alias(name))

    domain = smoothed(known.groupBy("domain").agg(*sums), [F.lit(p) for p in prior], "domain_prior", "domain")
    hosts = known.groupBy("host", "domain").agg(*sums).join(domain, "domain")
    hosts = smoothed(hosts, [F.col("domain_prior")[i] for i in range(len(langs))], "host_prior", "host")
    rows = read.join(given("declared", "p_declared"), "declared", "left").join(given("suffix", "p_suffix"), "suffix", "left").join(domain, "domain", "left").join(hosts, "host", "left")
    evidence = []
    for i in range(len(langs)):
        own = F.log(F.coalesce(F.get("host_prior", F.lit(i)), F.get("domain_prior", F.lit(i)), F.lit(prior[i])))
        evidence.append(F.coalesce(F.get("text", F.lit(i)), F.lit(0.0)) + F.coalesce(F.get("p_declared", F.lit(i)), F.lit(0.0)) + F.coalesce(F.get("p_suffix", F.lit(i)), F.lit(0.0)) + own)
    rows = rows.withColumn("evidence", F.array(*evidence)).withColumn("most", F.array_max("evidence"))
    mass = sum((F.exp(F.col("evidence")[i] - F.col("most")) for i in range(1, len(langs))), F.exp(F.col("evidence")[0] - F.col("most")))
    return rows.select("page_id", "host", "declared", F.get(names, F.array_position("evidence", F.col("most")).cast("int") - 1).alias("lang"), F.round(1 / mass, 6).alias("confidence"), "text_lang")
