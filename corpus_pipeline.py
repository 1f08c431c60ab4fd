"""The corpus pipeline: quality rules, line dedup, n-gram Jaccard join, benchmark decontamination, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; a caller may write it as Parquet and hand what it reads back to
the next. All but the last return the columns of documents. Every stage works on all rows that it is given, and takes nulls,
empty tables, repeated rows and further columns as its operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexstrata.llm import encode, jaccard, linededup, packing, quality, shared, winnow


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or diverge from their language go."""
    return quality.clean(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines that are nearly equal one occurrence stays; n_chars is as long as what is left, where documents have it."""
    out = linededup.deduplicated(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity of 0.8 or more) stays."""
    return jaccard.deduplicated(docs, shingle=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return winnow.decontaminated(docs, shared.documents(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document, with its sequence and place."""
    return packing.packed(docs, encode.public_path("byte_bpe_50k.json"), end=0)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", best_fit_packing),
]

#: SQL can express neither the tokenizer nor the divergences of the quality rules; tests/llm/test_pipeline.py has brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written and read again; a stage's input goes when its result is there."""
    tmp = shared.Scratch(spark)
    docs, before = shared.documents(spark, sf_dir), []
    for name, stage in STAGES[:-1]:
        docs = tmp.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        tmp.drop(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
