"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import Tables


def _sum(edges: DataFrame) -> tuple:
    """Equal for equal edge sets: rows are distinct."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of at least one edge; root is the component's smallest node.

    Nodes are longs; edges may repeat, point either way or be loops (a loop alone makes no
    node). Each half round is one pre-aggregated minimum per node and one join with it, both
    read from tables in the shared folder, so a hub's edges can be split by the engine and no
    component is ever gathered in one place. Rounds grow with the logarithm of the longest
    path. No edges: no rows.
    """
    t = Tables(edges.sparkSession)
    pair = edges.select(F.greatest(a, b).cast("long").alias("a"), F.least(a, b).cast("long").alias("b")).where("a <> b").distinct()
    now = t.put(pair, "edges")
    before = _sum(now)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = t.put(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "low")
        # every neighbour above a node is hung onto the node's minimum
        large = t.put(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large")
        t.drop(now, low)
        low = t.put(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        # every neighbour below a node, and the node itself, is hung onto the smallest of them
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        now = t.put(small, "edges")
        t.drop(large, low)
        after = _sum(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
