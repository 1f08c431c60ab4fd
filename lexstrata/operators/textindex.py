"""Trigrams of stored texts by file, to find the files that may hold a piece of text.

A text that contains a query contains all of the query's runs of three characters; so a file is read only if each of them is in some
text of it, and the exact test comes after. Both sides are lower-cased as the test does it. Queries of fewer than three characters have no
runs and read everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import SEARCH_FIELDS

POSTINGS = "file string, gram string"


def grams(text: Column) -> Column:
    """The different runs of three characters of a text, lower-cased; null has none."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("(?s)(?=(...))"), F.lit(1)))  # one pass; matches are empty, so runs overlap


def postings(rows: DataFrame) -> DataFrame:
    """(file, gram) of rows read from files, in order of grams. Repeats go within a row, then within a task, before they are shuffled."""
    each = F.array_distinct(F.concat(*(grams(F.col(f)) for f in SEARCH_FIELDS)))
    return rows.select(F.col("_metadata.file_name").alias("file"), F.explode(each).alias("gram")).distinct().repartitionByRange("gram").sortWithinPartitions("gram", "file")


def needed(spark: SparkSession, queries: list[str]) -> list[str]:
    """The runs that a text with all queries has."""
    rows = spark.createDataFrame([(q,) for q in queries], "q string").select(F.explode(grams(F.col("q"))).alias("gram")).distinct().collect()  # of the queries alone
    return sorted(r.gram for r in rows)


def files_with(found: DataFrame, runs: list[str]) -> DataFrame:
    """Files of postings that have all runs."""
    return found.where(F.col("gram").isin(*runs)).groupBy("file").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(runs)).select("file")
