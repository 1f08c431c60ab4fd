"""Navigation and construction of trees that are kept as rows with paths."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import SEARCH_FIELDS


def under(path: Column, top: str) -> Column:
    return (path == top) | path.startswith(f"{top}/")


def subtree(rows: DataFrame, path: str) -> DataFrame:
    """The node of a path and all below it; no rows for an unknown or empty path. The filter reaches the Parquet scan."""
    return rows.where(under(F.col("path"), path)) if path else rows.limit(0)


def node(rows: DataFrame, path: str) -> DataFrame:
    """The node alone."""
    return rows.where(F.col("path") == path)


def children(rows: DataFrame, path: str) -> DataFrame:
    return rows.where(F.col("parent_path") == path).orderBy("ordinal")


def element_versions(rows: DataFrame, path: str) -> DataFrame:
    """The node in every snapshot that has it."""
    return rows.where(F.col("path") == path).orderBy("snapshot_date")


def reshadowed(rows: DataFrame) -> DataFrame:
    """Set `shadowed` anew: of siblings with one path the last wins, the others and all below them are shadowed.

    Losers are few; each row is held against them by the ordinal paths of its ancestors, so one equi-join does it.
    """
    last = Window.partitionBy("snapshot_date", "parent_path", "path", "_parent")
    marked = rows.withColumn("_parent", F.slice("ord_path", 1, F.greatest(F.size("ord_path") - 1, F.lit(0)))).withColumn("_lost", F.col("ordinal") < F.max("ordinal").over(last))
    lost = marked.where("_lost").select(F.col("snapshot_date").alias("_date"), F.col("ord_path").alias("_of")).distinct()
    above = F.transform(F.sequence(F.lit(0), F.size("ord_path")), lambda n: F.slice("ord_path", F.lit(1), n))
    hit = rows.select("snapshot_date", "ord_path", F.explode(above).alias("_of")).withColumnRenamed("snapshot_date", "_date").join(lost, ["_date", "_of"], "left_semi").select("_date", F.col("ord_path").alias("_path")).distinct().withColumn("_hit", F.lit(True))
    out = rows.join(hit, (F.col("snapshot_date") == F.col("_date")) & (F.col("ord_path") == F.col("_path")), "left")
    return out.withColumn("shadowed", F.coalesce("_hit", F.lit(False))).select(*rows.columns)


def merged(first: DataFrame, second: DataFrame) -> DataFrame:
    """The first tree with the children of the second one's root after its own; paths may collide."""
    top = first.where("depth = 1").agg((F.coalesce(F.max("ordinal"), F.lit(-1)) + 1).alias("shift"))
    moved = second.where("depth > 0").join(F.broadcast(top))  # one row
    moved = moved.withColumn("ord_path", F.concat(F.array(F.get("ord_path", F.lit(0)) + F.col("shift")), F.slice("ord_path", 2, 1 << 20)))
    return reshadowed(first.unionByName(moved.withColumn("ordinal", F.element_at("ord_path", -1)).select(*first.columns)))


def text_rows(rows: DataFrame, fields: tuple[str, ...] = SEARCH_FIELDS) -> DataFrame:
    """A row per text field that is there, with its place among the fields."""
    pairs = F.array(*(F.struct(F.lit(i).alias("field_order"), F.lit(f).alias("field_name"), F.col(f).alias("text")) for i, f in enumerate(fields)))
    return rows.select("*", F.inline(pairs)).where("text IS NOT NULL")


def search_text(rows: DataFrame, query: str) -> DataFrame:
    """Fields of all snapshots that contain the query in any case, in order of date, document and field."""
    found = text_rows(rows).where(F.contains(F.lower("text"), F.lower(F.lit(query))))
    return found.orderBy("snapshot_date", "ord_path", "field_order").select("snapshot_date", "path", "field_name", F.col("text").alias("snippet"))


def containing_all(rows: DataFrame, column: str, terms: list[str]) -> DataFrame:
    """Rows whose text contains every term, in any case."""
    return rows.where(reduce(and_, (F.contains(F.lower(column), F.lower(F.lit(t))) for t in terms), F.lit(True)))
