"""Candidate pairs by strategy, and a comparison of the strategies with the exact answer."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.staging import cut
from . import ivf, lsh, similarity

STRATEGIES = ("exact", "lsh", "ivf", "hybrid")
EXACT_BELOW = 256


def candidate_pairs(vectors: DataFrame, sets: DataFrame | None, threshold: float = 0.9, strategy: str = "lsh", num_perm: int = 128, n_probe: int = 4, n_lists: int | None = None, seed: int = 13) -> tuple[DataFrame, dict]:
    """(i, j) that may reach `threshold`, and how they were found. Small tables are compared exactly. `sets`: (id, features), or (id, text) for all features of texts."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    n = vectors.count()
    if strategy == "exact" or n <= EXACT_BELOW:
        return similarity.pairs_above(vectors, threshold).select("i", "j"), {"strategy": strategy, "n": n, "used_exact_fallback": strategy != "exact"}
    found, facts = None, {"strategy": strategy, "n": n, "used_exact_fallback": False}
    if strategy in ("lsh", "hybrid"):
        if sets is None:
            raise ValueError(f"strategy {strategy!r} needs feature sets")
        bands, rows = lsh.band_parameters(num_perm, lsh.jaccard_of_cosine(threshold))
        signed = lsh.signatures(sets, "features", num_perm, seed) if "features" in sets.columns else lsh.text_signatures(sets, num_perm, seed)
        found = lsh.candidate_pairs(lsh.band_keys(signed, bands, rows))
        facts |= {"bands": bands, "rows": rows}
    if strategy in ("ivf", "hybrid"):
        lists = n_lists or ivf.default_lists(n)
        more = ivf.candidate_pairs(vectors, ivf.train_centroids(vectors, lists, seed), n_probe)
        found = more if found is None else found.unionByName(more).distinct()
        facts |= {"n_lists": lists, "n_probe": n_probe}
    return found, facts


def verified_pairs(vectors: DataFrame, sets: DataFrame | None, threshold: float = 0.9, strategy: str = "lsh", num_perm: int = 128, n_probe: int = 4, n_lists: int | None = None, seed: int = 13) -> tuple[DataFrame, DataFrame, dict, Callable[[DataFrame], DataFrame]]:
    """Of the candidate pairs of `candidate_pairs`: those that hold, one row of counts as `verify` has it, how they were found, and which of given
    pairs are candidates. Where lists or all pairs make the candidates, no table of them is written; text candidates are, once."""
    n = vectors.count()
    within = lambda table: lambda pairs: pairs.join(table.select(F.col("i").alias("low"), F.col("j").alias("high")), (F.least("i", "j") == F.col("low")) & (F.greatest("i", "j") == F.col("high")), "left_semi")
    if strategy in STRATEGIES and (strategy == "exact" or n <= EXACT_BELOW):
        good = cut(similarity.pairs_above(vectors, threshold), "verified")
        counts = good.agg(F.count(F.lit(1)).alias("candidates"), F.count(F.lit(1)).alias("verified"), F.lit(0).cast("long").alias("rejected"))
        return good, counts, {"strategy": strategy, "n": n, "used_exact_fallback": strategy != "exact"}, within(good)
    if strategy == "ivf":
        lists = n_lists or ivf.default_lists(n)
        centroids = ivf.train_centroids(vectors, lists, seed)
        good, counts = ivf.verified_pairs(vectors, centroids, n_probe, threshold)
        return cut(good, "verified"), counts, {"strategy": strategy, "n": n, "used_exact_fallback": False, "n_lists": lists, "n_probe": n_probe}, lambda pairs: ivf.covered(pairs, vectors, centroids, n_probe)
    pairs, facts = candidate_pairs(vectors, sets, threshold, strategy, num_perm, n_probe, n_lists, seed)
    pairs = cut(pairs, "candidates")
    good, counts = similarity.verify(pairs, vectors, threshold)
    return cut(good, "verified"), counts, facts, within(pairs)


def benchmark(vectors: DataFrame, sets: DataFrame | None, strategies=STRATEGIES, k: int = 10, threshold: float = 0.9, n_lists: int = 16, n_probe: int = 6) -> list[dict]:
    """Per strategy: recall and precision of pairs, recall of the k nearest, candidates per row, seconds and speed-up."""
    n = vectors.count()
    began = time.perf_counter()
    top = cut(similarity.top_k(vectors, k).select("i", "j"), "top")
    truth = cut(similarity.pairs_above(vectors, threshold), "truth")
    n_top = top.count()
    exact_s = time.perf_counter() - began
    out = []
    for strategy in strategies:
        began = time.perf_counter()
        # Of the k nearest, those that are candidates are nearest among the candidates too, so they are what a search of the pools finds.
        if strategy == "exact":
            found, candidates, hit = truth, truth.count(), n_top
        else:
            found, counts, _, among = verified_pairs(vectors, sets, threshold, strategy, n_probe=n_probe, n_lists=n_lists)
            candidates, hit = counts.first()["candidates"], None
        seconds = time.perf_counter() - began
        scores = similarity.pair_recall(truth, found).first()
        hit = among(top).count() if hit is None else hit
        out.append({"strategy": strategy, "n": n, "recall_at_k": hit / n_top if n_top else 1.0, "pair_recall": scores["recall"], "pair_precision": scores["precision"], "f1": scores["f1"], "candidates_per_row": candidates / n if n else 0.0, "exact_ms": 1000 * exact_s, "ann_ms": 1000 * seconds, "speedup": exact_s / seconds if seconds else None})
    return out
