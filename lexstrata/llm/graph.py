"""Connected components of an edge table, by large-star and small-star rounds (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from . import shared


def _written(tmp: shared.Scratch, edges: DataFrame, name: str) -> tuple[DataFrame, dict]:
    """edges as a written table, and what tells them from others; one job gives both."""
    state = Observation()
    seen = edges.observe(state, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum"))
    return tmp.written(seen, name), state.get


def components(tmp: shared.Scratch, edges: DataFrame, name: str = "edges") -> DataFrame:
    """(node, label) for every node of the edges (a, b): label is the smallest node that edges lead to.

    Each round moves every neighbour of a node to the node's smallest neighbour, larger ones first, then smaller ones; it ends
    when a round changes nothing. The number of rounds grows with the logarithm of the longest chain. Edges are written to
    the shared folder after each round, and the round's before deleted. A node that very many edges share only has its minimum
    taken (combined before the shuffle) and is joined, never gathered. Null ends are ignored.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).distinct()
    now, state = _written(tmp, now, name)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a").where("b != m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        before = now
        now, after = _written(tmp, moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), name)
        tmp.drop(before)
        if after == state:
            break
        state = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
