"""Operator 7: mix sources to target weights by subset-sum budget fitting.

Per source: whole passes over all its documents as far as the target allows; what is left is fitted with
documents taken once more. For that, documents are counted by exact length; every length first gives its share,
then longer lengths fill up, and a bounded-knapsack dynamic programme over the lengths meets the last
`window` words. Which documents of a length are taken follows a seeded hash of doc_id.

Cases: null and empty texts have size 0 and are taken with 0 words; a null source is a source of its own, last
in order; sources without words have target 0; repeated rows count one by one; other columns are left
out; an empty table gives no rows. One row per source goes to the driver, nothing per document.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, n_words, salted_rank

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
SEED = 20
#: Words that the dynamic programme meets exactly; larger remainders are first cut down by whole documents.
WINDOW = 8192
SALTS = 64


def targets(sizes: dict[str | None, int], weights=WEIGHTS, most: int = MOST, budget: float | None = None) -> dict[str | None, float]:
    """Each source's words: `budget` (all words) by weight in code-point order, null last, none above `most` times its size."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left = float(sum(sizes.values())) if budget is None else float(budget)
    out, free = {}, list(order)
    while free:
        total = sum(weight[s] for s in free)
        share = {s: left * weight[s] / total for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
        left = max(left, 0.0)
        free = [s for s in free if s not in out]
    return out


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, window: int = WINDOW) -> np.ndarray:
    """How many documents of each length to take, at most `counts`, so that their words come as near `budget` as can be found."""
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    total = int((lengths * counts).sum())
    take = np.zeros(len(lengths), np.int64)
    if budget <= 0 or not total:
        return take
    if budget >= total:
        return counts.copy()
    # A share a little below the budget, so that the programme below has a choice of all lengths.
    take = np.floor(counts * (max(0, budget - window // 2) / total)).astype(np.int64)
    left = budget - int((lengths * take).sum())
    for k in np.argsort(-lengths, kind="stable"):
        if left <= window:
            break
        if lengths[k]:
            more = min(int(counts[k] - take[k]), (left - window // 2) // int(lengths[k]))
            if more > 0:
                take[k] += more
                left -= more * int(lengths[k])
    top = int(min(left + lengths.max(), 2 * window + lengths.max()))
    if left <= 0:
        return take
    reached = np.zeros(top + 1, bool)
    reached[0] = True
    by = np.full(top + 1, -1, np.int64)
    step = np.zeros(top + 1, np.int64)
    for k in np.argsort(-lengths, kind="stable"):
        size, free, chunk = int(lengths[k]), int(counts[k] - take[k]), 1
        while size and free and size * min(chunk, free) <= top and not reached[min(left, top)]:
            n = min(chunk, free)
            new = np.zeros_like(reached)
            new[size * n :] = reached[: top + 1 - size * n]
            new &= ~reached
            by[new], step[new] = k, n
            reached |= new
            free -= n
            chunk *= 2
    sums = np.flatnonzero(reached)
    at = int(sums[np.argmin(np.abs(sums - left))])
    while at:
        take[by[at]] += step[at]
        at -= int(lengths[by[at]] * step[at])
    return take


def mix(docs: DataFrame, seed: int = SEED, salts: int = SALTS, budget: float | None = None) -> DataFrame:
    """`docs` (doc_id, text, source, ...) with size, source_size, target and times (how often the mix takes the row)."""
    spark = docs.sparkSession
    held = docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"))
    held = cut(held, "sizes")
    totals = {r["source"]: int(r["n"] or 0) for r in held.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    goal = targets(totals, budget=budget)
    plan = []
    for s, n in totals.items():
        words = min(int(round(goal[s])), MOST * n)
        plan.append((s, n, float(goal[s]), words // n if n else 0, words % n if n else 0))
    plan = spark.createDataFrame(plan, "_source string, source_size long, target double, epochs long, rest long")

    def fitted(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_size", kind="stable")
        return pd.DataFrame({"_s": group["source"], "_size": group["_size"], "take": fit(group["_size"].to_numpy(), group["n"].to_numpy(), int(group["rest"].iloc[0]))})

    lengths = held.groupBy("source", F.col("size").alias("_size")).agg(F.count(F.lit(1)).alias("n"))
    chosen = lengths.join(plan, F.col("source").eqNullSafe(F.col("_source")), "inner").groupBy("source").applyInPandas(fitted, "_s string, _size long, take long")
    ranked = salted_rank(held.withColumn("_order", F.xxhash64(F.lit(seed), "doc_id")), ["source", "size"], ["_order", "doc_id"], "_rank", "_order", salts)
    out = ranked.join(chosen, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_size")), "left")
    out = out.join(plan, F.col("source").eqNullSafe(F.col("_source")), "left")
    times = F.col("epochs") + F.when(F.col("_rank") < F.col("take"), 1).otherwise(0)
    return out.select("doc_id", "source", "size", "source_size", "target", times.cast("long").alias("times"))


def mixing_query(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))
