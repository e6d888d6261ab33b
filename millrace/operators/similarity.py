"""Joins by similarity: all pairs above a threshold, nearest neighbours, nearest match in another table, adjacency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.staging import cut
from .components import components


def pairs_above(vectors: DataFrame, threshold: float, block: int | None = None) -> DataFrame:
    """(i, j, sim), i < j, of all pairs with a cosine of at least `threshold`; `vectors` has id and vec."""
    return V.meet(vectors.select("id", "vec"), V.blocks(vectors.select("id", "vec"), block), V.Above(threshold, "after")).select("i", "j", "sim")


def matches_above(left: DataFrame, right: DataFrame, threshold: float, block: int | None = None) -> DataFrame:
    """(i, j, sim) of rows of two tables with a cosine of at least `threshold`."""
    return V.meet(left.select("id", "vec"), V.blocks(right.select("id", "vec"), block), V.Above(threshold)).select("i", "j", "sim")


def greatest_cosine(left: DataFrame, right: DataFrame, block: int | None = None) -> DataFrame:
    """One row (sim): the greatest cosine of a row of `left` and one of `right`."""
    return nearest_in(left, right, 1, block).agg(F.max("sim").alias("sim"))


def top_k(vectors: DataFrame, k: int, block: int | None = None) -> DataFrame:
    """(i, rank, j, sim): the k nearest others of each row by cosine, ties to the smaller id."""
    return V.meet(vectors.select("id", "vec"), V.blocks(vectors.select("id", "vec"), block), V.Best(k, "other"))


def nearest_in(left: DataFrame, right: DataFrame, k: int = 1, block: int | None = None) -> DataFrame:
    """(i, rank, j, sim): the k nearest rows of `right` for each row of `left`."""
    return V.meet(left.select("id", "vec"), V.blocks(right.select("id", "vec"), block), V.Best(k))


#: Rows that all others meet first, so that most of a large graph's pairs lie within groups already found.
FIRST = 8_192


def near_groups(vectors: DataFrame, threshold: float, block: int | None = None, first: int = FIRST) -> DataFrame:
    """(id, group_id): components of all pairs with a cosine of at least `threshold`, named by their smallest id.

    All pairs are compared, but not all are sent: groups are found from the pairs with about `first` rows, then of all pairs only those
    of different groups count, each pair of groups once a product. So what is shuffled grows with the rows and not with the pairs."""
    held = cut(vectors.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec")), "vectors")
    parts = held.count() // first
    marked = held.withColumn("mark", F.col("id"))
    if parts > 1:
        some = V.blocks(marked.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == 0), block)
        marked = cut(held.join(_grouped(held, V.meet(marked, some, V.Links(threshold))).withColumnRenamed("group_id", "mark"), "id"), "marked")
    found = components(V.meet(marked, V.blocks(marked, block), V.Links(threshold, "after")))
    return marked.join(found, F.col("mark") == F.col("node"), "left").select("id", F.coalesce("root", "mark").alias("group_id"))


def _grouped(ids: DataFrame, edges: DataFrame) -> DataFrame:
    found = components(edges)
    return ids.select("id").join(found, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("group_id"))


def ranked(pairs: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("i").orderBy(F.col("sim").desc(), "j")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("i", "rank", "j", "sim")


def exact_cosines(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(i, j, sim): the cosines of given pairs."""
    u = vectors.select("id", V.unit(F.col("vec")).alias("u"))
    joined = pairs.join(u.select(F.col("id").alias("i"), F.col("u").alias("ui")), "i").join(u.select(F.col("id").alias("j"), F.col("u").alias("uj")), "j")
    return joined.select("i", "j", V.cosine_of_units(F.col("ui"), F.col("uj")).alias("sim"))


def verify(pairs: DataFrame, vectors: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The pairs at or above `threshold`, and one row (candidates, verified, rejected)."""
    if not 0 <= threshold <= 1:
        raise ValueError(f"threshold must lie in [0, 1], not {threshold}")
    scored = exact_cosines(pairs, vectors)
    good = (F.col("sim") >= threshold).cast("long")
    counts = scored.agg(F.count(F.lit(1)).alias("candidates"), F.coalesce(F.sum(good), F.lit(0)).alias("verified"), F.coalesce(F.sum(1 - good), F.lit(0)).alias("rejected"))
    return scored.where(F.col("sim") >= threshold), counts


def adjacency(pairs: DataFrame) -> DataFrame:
    """(i, neighbours): sorted ids that share a pair with i."""
    both = pairs.select("i", "j").unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"))).where("i <> j")
    return both.groupBy("i").agg(F.array_sort(F.collect_set("j")).alias("neighbours"))


def pair_recall(truth: DataFrame, got: DataFrame) -> DataFrame:
    """One row (n_truth, n_got, n_hit, recall, precision, f1) over pairs (i, j); no truth is recall 1, nothing got is precision 0."""
    t, g = truth.select("i", "j").distinct(), got.select("i", "j").where("j >= 0").distinct()
    both = t.withColumn("t", F.lit(1)).join(g.withColumn("g", F.lit(1)), ["i", "j"], "full")
    n = both.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("n_truth"), F.coalesce(F.sum("g"), F.lit(0)).alias("n_got"), F.coalesce(F.sum(F.col("t") * F.col("g")), F.lit(0)).alias("n_hit"))
    n = n.withColumn("recall", F.when(F.col("n_truth") == 0, 1.0).otherwise(F.col("n_hit") / F.nullif(F.col("n_truth"), F.lit(0))))
    n = n.withColumn("precision", F.when(F.col("n_got") == 0, 0.0).otherwise(F.col("n_hit") / F.nullif(F.col("n_got"), F.lit(0))))
    total = F.col("recall") + F.col("precision")
    return n.withColumn("f1", F.when(total == 0, 0.0).otherwise(2 * F.col("recall") * F.col("precision") / F.nullif(total, F.lit(0.0))))
