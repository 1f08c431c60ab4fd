"""Differences of two snapshots: both sides meet once per path, in a narrow table that all parts of the result read.

That table is persisted (memory, then disk): without it every part would join both snapshots again. Call `release` when done.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.worddiff import word_changes
from ..schema import TEXT_FIELDS

#: What of an element takes part in a comparison.
COMPARED = ("snapshot_date", "parent_path", "ancestor_paths", "ord_path", "element_type", *TEXT_FIELDS)
#: Columns of stored elements, by which whole parts are known to be equal.
HASHES = "top string, tree_hash struct<a: long, b: long, n: long>"
#: Tops that may differ by name in a filter; beyond, everything is read.
MOST_TOPS = 2_000


class PathMismatch(ValueError):
    """The snapshots don't have the same root paths."""


@dataclass(frozen=True)
class TreeDiff:
    """nodes: matched paths that are kept; field_changes; added and removed: children that only one side has, below kept nodes;
    errors: paths whose element type changed."""

    nodes: DataFrame
    field_changes: DataFrame
    added: DataFrame
    removed: DataFrame
    errors: DataFrame
    compared: DataFrame

    def find(self, path: str) -> DataFrame:
        """The node of a path and all below it."""
        return self.nodes.where((F.col("path") == path) | F.col("path").startswith(f"{path}/")) if path else self.nodes.limit(0)

    def shallow(self, path: str) -> DataFrame:
        return self.nodes.where(F.col("path") == path)

    def changed_nodes(self) -> DataFrame:
        """Nodes with changed fields or with added or removed children, and how many of each."""
        parts = (self.field_changes, "path", "n_changes"), (self.added, "parent_path", "n_added"), (self.removed, "parent_path", "n_removed")
        one = lambda df, by, name: df.select(F.col(by).alias("path"), *(F.lit(int(n == name)).alias(n) for *_, n in parts))
        each = one(*parts[0]).unionByName(one(*parts[1])).unionByName(one(*parts[2]))
        return self.nodes.join(each.groupBy("path").agg(*(F.sum(n).alias(n) for *_, n in parts)), "path")

    def release(self) -> None:
        self.compared.unpersist()

    def __enter__(self) -> TreeDiff:
        return self

    def __exit__(self, *_) -> None:
        self.release()


def containing(nodes: DataFrame, text: str) -> DataFrame:
    """Nodes whose path contains the trimmed text; all of them for a blank one."""
    return nodes.where(F.contains("path", F.lit(text.strip()))) if text.strip() else nodes


def matched(old: DataFrame, new: DataFrame) -> DataFrame:
    """Structs o and n per path; one of them is null where only one side has the path. Shadowed rows take no part."""
    side = lambda df, name: df.where(~F.col("shadowed")).select("path", F.struct(*COMPARED).alias(name))
    return side(old, "o").join(side(new, "n"), "path", "full_outer")


def _differences():
    each = F.array(*(F.struct(F.lit(i).alias("field_order"), F.lit(f).alias("field_name"), F.coalesce(F.col(f"o.{f}"), F.lit("")).alias("old_value"), F.coalesce(F.col(f"n.{f}"), F.lit("")).alias("new_value")) for i, f in enumerate(TEXT_FIELDS)))
    both = F.col("o").isNotNull() & F.col("n").isNotNull() & (F.col("o.element_type") == F.col("n.element_type"))
    return F.when(both, F.filter(each, lambda x: x["old_value"] != x["new_value"]))


def changed_fields(pairs: DataFrame) -> DataFrame:
    """A row per field whose text differs; a missing text equals an empty one."""
    return pairs.select("path", F.col("o.snapshot_date").alias("from_date"), F.col("n.snapshot_date").alias("to_date"), F.inline(_differences()))


def compared(old: DataFrame, new: DataFrame) -> DataFrame:
    """A row per path: which sides have it, its place in the tree, and the fields that differ."""
    either = [F.coalesce(f"o.{c}", f"n.{c}").alias(c) for c in ("parent_path", "ancestor_paths", "ord_path")]
    return matched(old, new).select("path", *either, F.col("o.element_type").alias("old_type"), F.col("n.element_type").alias("new_type"), F.col("o.snapshot_date").alias("from_date"), F.col("n.snapshot_date").alias("to_date"), _differences().alias("fields"))


def check_roots(old: DataFrame, new: DataFrame) -> None:
    roots = [df.where("parent_path IS NULL AND NOT shadowed").select("path", F.lit(k).alias("side")) for k, df in enumerate((old, new))]
    odd = roots[0].unionByName(roots[1]).groupBy("path").agg(F.min("side").alias("lo"), F.max("side").alias("hi")).where("lo = hi").first()
    if odd:
        raise PathMismatch(f"only the {('older', 'newer')[odd.lo]} snapshot has the root {odd.path}")


def hashed(rows: DataFrame) -> DataFrame:
    """Adds `top` and `tree_hash`: two 64-bit hashes of what a comparison looks at, and the number of rows, from each row down.

    Paths of rows that count are different, so hashes of rows can be combined in any order, before they are shuffled. Shadowed rows
    have none of their own.
    """
    seen = [F.col("path"), F.col("element_type"), *(F.coalesce(F.col(f), F.lit("")) for f in TEXT_FIELDS)]
    one = rows.where(~F.col("shadowed")).select(F.explode(F.concat("ancestor_paths", F.array("path"))).alias("path"), F.xxhash64(*seen).alias("x"), F.xxhash64(F.lit("second"), *seen).alias("y"))
    whole = one.groupBy("path").agg(F.struct(F.bit_xor("x").alias("a"), F.bit_xor("y").alias("b"), F.count("*").alias("n")).alias("tree_hash"))
    top = F.when(F.col("depth") > 0, F.coalesce(F.get("ancestor_paths", F.lit(1)), "path")).otherwise(F.lit(""))
    return rows.drop("top", "tree_hash").withColumn("top", top).join(whole, "path", "left").select(*rows.drop("top", "tree_hash").columns, "top", "tree_hash")


def differing_tops(old: DataFrame, new: DataFrame) -> list[str] | None:
    """Tops (nodes of depth 1) whose hashes differ or that one side lacks; None if they are more than MOST_TOPS. Reads no texts."""
    side = lambda df, name: df.where(~F.col("shadowed") & (F.col("depth") == 1)).select("path", F.col("tree_hash").alias(name))
    both = side(old, "x").join(side(new, "y"), "path", "full_outer").where(~F.col("x").eqNullSafe(F.col("y")))
    found = [r.path for r in both.select("path").limit(MOST_TOPS + 1).collect()]
    return found if len(found) <= MOST_TOPS else None


def compute_diff(old: DataFrame, new: DataFrame, prune: str = "reference") -> TreeDiff:
    """prune="reference" keeps the root and what lies on the way to a changed field; "complete" also keeps what lies on the way
    to an added or removed child. Snapshots with other root paths are a PathMismatch."""
    if prune not in ("reference", "complete"):
        raise ValueError(prune)
    check_roots(old, new)
    if "tree_hash" in old.columns and "tree_hash" in new.columns:  # the parts that are equal are not compared
        tops = differing_tops(old, new)
        if tops is not None:
            old, new = (df.where(F.col("top").isin("", *tops)) for df in (old, new))
    rows = compared(old, new).persist()
    both = rows.where("old_type IS NOT NULL AND new_type IS NOT NULL")
    one = lambda side, kind: rows.where(f"{side} IS NULL").select("path", "parent_path", "ancestor_paths", F.col(kind).alias("element_type"), "ord_path")
    added, removed = one("old_type", "new_type"), one("new_type", "old_type")
    keep = both.where("size(fields) > 0").select(F.explode(F.concat("ancestor_paths", F.array("path"))).alias("path")).unionByName(both.where("parent_path IS NULL").select("path"))
    if prune == "complete":
        here = both.select(F.col("path").alias("parent_path"))
        for df in (added, removed):
            keep = keep.unionByName(df.join(here, "parent_path", "left_semi").select(F.explode("ancestor_paths").alias("path")))
    keep = keep.distinct()  # all of them matched: what lies above a matched path is matched
    kept = keep.withColumnRenamed("path", "parent_path")
    nodes = both.join(keep, "path", "left_semi").select("path", "ancestor_paths", "ord_path", "parent_path", F.col("old_type").alias("element_type"))
    errors = both.where("old_type <> new_type").select("path", "old_type", "new_type")
    fields = both.select("path", "from_date", "to_date", F.inline("fields"))
    changes = fields.withColumn("changes", word_changes("old_value", "new_value")).select("from_date", "to_date", "path", "field_name", "old_value", "new_value", "changes")
    return TreeDiff(nodes, changes, added.join(kept, "parent_path", "left_semi"), removed.join(kept, "parent_path", "left_semi"), errors, rows)
