"""Snapshots in order of date, then of insertion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def navigation(versions: DataFrame) -> DataFrame:
    """Each snapshot with the dates before and after it. The table has a row per snapshot, so one task sorts it."""
    order = Window.orderBy("snapshot_date", "seq")
    return versions.select("*", F.lag("snapshot_date").over(order).alias("prev_date"), F.lead("snapshot_date").over(order).alias("next_date"))


def by_date(versions: DataFrame, date: str) -> DataFrame:
    return versions.where(F.col("snapshot_date") == date).orderBy("seq").limit(1)


def elements_at(elements: DataFrame, versions: DataFrame, date: str) -> DataFrame:
    """Elements (version, seq, ...) of the snapshot that was added first of those with this date."""
    own = by_date(versions, date).select(F.col("snapshot_date").alias("version"), "seq")
    return elements.where(F.col("version") == date).join(F.broadcast(own), ["version", "seq"], "left_semi")  # one row


def by_label(versions: DataFrame, label: str) -> DataFrame:
    return versions.where(F.col("label") == label).orderBy("snapshot_date", "seq").limit(1)


def next_version(versions: DataFrame, date: str) -> DataFrame:
    order = Window.orderBy("snapshot_date", "seq")
    found = versions.withColumn("_p", F.lag("snapshot_date").over(order))
    return found.where(F.col("_p") == date).orderBy("seq").limit(1).drop("_p")


def prev_version(versions: DataFrame, date: str) -> DataFrame:
    order = Window.orderBy("snapshot_date", "seq")
    found = versions.withColumn("_n", F.lead("snapshot_date").over(order))
    return found.where(F.col("_n") == date).orderBy(F.desc("seq")).limit(1).drop("_n")


def first_two(versions: DataFrame) -> tuple[str, str]:
    rows = versions.orderBy("snapshot_date", "seq").limit(2).collect()
    if len(rows) < 2:
        raise ValueError("fewer than two versions")
    return rows[0].snapshot_date, rows[1].snapshot_date
