"""Connected components of an edge table by joins, for graphs too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of `edges` (a, b), root the smallest node reachable.

    Rounds of large-star and small-star (Kiveris et al., 2014): each keeps the graph's components and ends in stars around
    the smallest nodes. A round aggregates by node with partial sums, and its table is written out, so lineage stays short.
    Self loops and repeated edges are harmless; an empty table gives no rows.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(F.col("u") != F.col("v")).distinct()
    now = cut(now, "edges")
    if now.isEmpty():
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    before = None
    for _ in range(max_rounds):
        # Large star: every larger neighbour of a node is linked to the node's smallest neighbour (itself counts).
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        low = low.select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        # Small star: a node and its smaller neighbours are linked to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = cut(small.distinct(), "edges")
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == tuple(mark):
            break
        before = tuple(mark)
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
