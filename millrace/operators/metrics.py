"""Reports on a corpus: diversity, lengths, label drift, crowding, memorisation."""

from __future__ import annotations

import functools
import json
import math
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grams as G
from ..functions import text as T
from . import similarity

PERCENTILES = (50, 90, 95, 99)
LEAK_THRESHOLD = 0.92
UNTAGGED = "_untagged"


def tag_of(tag: Column) -> Column:
    return F.when(tag.isNull() | (tag == ""), F.lit(UNTAGGED)).otherwise(tag)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.nullif(b, F.lit(0)))


def _counts(df: DataFrame, toks: str, sizes: tuple[int, ...], by: tuple[str, ...]) -> DataFrame:
    """(by..., size, ngram, n) of a column of texts, read once for all sizes, or of tokens."""
    if dict(df.dtypes)[toks] == "string":
        return G.gram_counts(df, toks, sizes, *by).groupBy(*by, "size", "ngram").agg(F.sum("n").alias("n"))
    found = [T.ngram_counts(df, toks, n, *by).withColumn("size", F.lit(n)) for n in sizes]
    return functools.reduce(DataFrame.unionByName, found)


def distinct_share(df: DataFrame, toks: str, n: int, *by: str) -> DataFrame:
    """(by..., total, distinct, share) of runs of n tokens; `toks` has texts (n up to 2) or tokens."""
    counts = _counts(df, toks, (n,), by)
    return counts.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("distinct")).withColumn("share", _ratio(F.col("distinct"), F.col("total")))


def type_token_ratio(df: DataFrame, toks: str = "toks") -> DataFrame:
    return distinct_share(df, toks, 1).select(F.col("share").alias("type_token_ratio"))


def diversity(df: DataFrame, toks: str, *by: str) -> DataFrame:
    """(by..., type_token_ratio, distinct_1, distinct_2, n_tokens, n_types); `toks` has texts or tokens."""
    of = lambda n, c: F.when(F.col("size") == n, c)
    sums = [F.coalesce(F.sum(of(n, F.col("n"))), F.lit(0)).alias(f"total_{n}") for n in (1, 2)] + [F.count(of(n, F.lit(1))).alias(f"types_{n}") for n in (1, 2)]
    found = _counts(df, toks, (1, 2), by).groupBy(*by).agg(*sums)
    one, two = (_ratio(F.col(f"types_{n}"), F.col(f"total_{n}")) for n in (1, 2))
    return found.select(*by, one.alias("type_token_ratio"), one.alias("distinct_1"), two.alias("distinct_2"), F.col("total_1").alias("n_tokens"), F.col("types_1").alias("n_types"))


def statistics(value: Column, prefix: str, percentiles=PERCENTILES) -> list[Column]:
    """Aggregates of a value; percentiles are exact and linearly interpolated, null without rows."""
    q = F.percentile(value, [p / 100 for p in percentiles])
    v = value.cast("double")
    return [F.avg(v).alias(f"{prefix}_mean"), F.min(v).alias(f"{prefix}_min"), F.max(v).alias(f"{prefix}_max"), *(F.get(q, F.lit(k)).alias(f"{prefix}_p{p}") for k, p in enumerate(percentiles))]


def length_profile(texts: DataFrame, text: str = "text", *by: str) -> DataFrame:
    """(by..., n_examples, words_*, chars_*, empty_count)."""
    normal = T.normalize(F.col(text))
    sized = texts.select(*by, F.size(T.tokens(normal)).alias("w"), F.length(normal).alias("c"))
    return sized.groupBy(*by).agg(F.count(F.lit(1)).alias("n_examples"), *statistics(F.col("w"), "words"), *statistics(F.col("c"), "chars"), F.coalesce(F.sum((F.col("w") == 0).cast("long")), F.lit(0)).alias("empty_count"))


def tag_distribution(df: DataFrame, tag: str = "tag") -> DataFrame:
    return df.groupBy(tag_of(F.col(tag)).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def proportions(counts: DataFrame) -> DataFrame:
    """(label, n, share), without a window over all rows."""
    total = counts.agg(F.sum("n").alias("t"))
    return counts.join(F.broadcast(total)).select("label", "n", (F.col("n") / F.col("t")).alias("share"))


def drift_table(observed: DataFrame, reference: DataFrame) -> DataFrame:
    """(label, observed, reference) over the union of labels of two tag distributions."""
    return observed.select("label", F.col("n").alias("observed")).join(reference.select("label", F.col("n").alias("reference")), "label", "full").select("label", F.coalesce("observed", F.lit(0)).alias("observed"), F.coalesce("reference", F.lit(0)).alias("reference"))


def drift_statistics(table: DataFrame) -> DataFrame:
    """One row (max_proportion_gap, n_new_labels, n_lost_labels, chi_square, chi2_dof, js_distance) of a drift table.

    Labels lost from the observed side enter the test with a count of 0; js_distance is the root of the base-2 divergence."""
    fit = F.col("reference") > 0
    sums = table.agg(F.sum("observed").alias("o"), F.sum("reference").alias("r"), F.sum(F.when(fit, F.col("observed"))).alias("fo"), F.sum(fit.cast("int")).alias("labels"))
    t = table.join(F.broadcast(sums))
    p, q = F.col("observed") / F.nullif(F.col("o"), F.lit(0)), F.col("reference") / F.nullif(F.col("r"), F.lit(0))
    expected = q * F.col("fo")
    term = lambda x: F.when(x > 0, x * F.log2(x / ((p + q) / 2))).otherwise(0.0)
    chi = F.sum(F.when(fit & (F.col("labels") >= 2) & (F.col("o") > 0), F.pow(F.col("observed") - expected, F.lit(2.0)) / F.nullif(expected, F.lit(0.0))))
    return t.agg(
        F.max(F.abs(p - q)).alias("max_proportion_gap"),
        F.sum(((F.col("reference") == 0) & (F.col("observed") > 0)).cast("long")).alias("n_new_labels"),
        F.sum(((F.col("observed") == 0) & fit).cast("long")).alias("n_lost_labels"),
        chi.alias("chi_square"),
        F.when(F.max("labels") >= 2, F.max("labels") - 1).alias("chi2_dof"),
        F.sqrt(F.greatest(F.lit(0.0), F.sum(term(p)) / 2 + F.sum(term(q)) / 2)).alias("js_distance"),
    )


def chi2_p(statistic: float, dof: int) -> float:
    """Upper tail of the chi-square distribution: the regularised incomplete gamma function by series or continued fraction."""
    a, x = dof / 2, statistic / 2
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1 - total * scale
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * scale


def distribution_drift(observed: DataFrame, reference: DataFrame, alpha: float = 0.05) -> dict:
    """Drift statistics with the test's p-value; `drifted` is None where the test can't be made."""
    row = drift_statistics(drift_table(observed, reference)).first().asDict()
    ok = row["chi_square"] is not None
    p = chi2_p(row["chi_square"], row["chi2_dof"]) if ok else None
    return row | {"chi2_p_value": p, "chi2_available": ok, "drifted": p < alpha if ok else None}


def neighbour_distances(vectors: DataFrame) -> DataFrame:
    """One row (n_examples, mean, median, min, max, p10, p90, frac_below_0_10) of distances to the nearest other row."""
    d = similarity.top_k(vectors, 1).select((1 - F.col("sim")).alias("d"))
    q = F.percentile("d", [0.5, 0.1, 0.9])
    return d.agg(F.count(F.lit(1)).alias("n_examples"), F.avg("d").alias("mean"), F.get(q, F.lit(0)).alias("median"), F.min("d").alias("min"), F.max("d").alias("max"), F.get(q, F.lit(1)).alias("p10"), F.get(q, F.lit(2)).alias("p90"), F.avg((F.col("d") < 0.10).cast("double")).alias("frac_below_0_10"))


def closest_seed(generated: DataFrame, seeds: DataFrame) -> DataFrame:
    """(i, j, sim, identical): each generated row's nearest seed; both have id, vec and norm (normalised text)."""
    best = similarity.nearest_in(generated.select("id", "vec"), seeds.select("id", "vec"), 1).select("i", "j", "sim")
    same = generated.select("id", "norm").join(seeds.select("norm").distinct(), "norm", "left_semi").select(F.col("id").alias("i"), F.lit(True).alias("identical"))
    return best.join(same, "i", "left").withColumn("identical", F.coalesce("identical", F.lit(False)))


def memorisation(best: DataFrame, threshold: float = LEAK_THRESHOLD) -> DataFrame:
    """One row of leak rates from `closest_seed`."""
    leak = F.col("sim") >= threshold
    rate = lambda c: F.avg(c.cast("double"))
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    q = F.percentile("sim", [0.5, 0.9])
    same = F.col("identical")
    return best.agg(F.count(F.lit(1)).alias("n_generated"), rate(leak).alias("leak_rate"), count(leak).alias("n_leaks"), rate(leak & ~same).alias("paraphrase_leak_rate"), count(leak & ~same).alias("n_paraphrase_leaks"), rate(same).alias("exact_carryover_rate"), count(same).alias("n_exact_carryover"), F.avg("sim").alias("max_sim_mean"), F.get(q, F.lit(0)).alias("max_sim_median"), F.get(q, F.lit(1)).alias("max_sim_p90"))


def offenders(best: DataFrame, top: int = 5) -> DataFrame:
    return best.orderBy(F.col("sim").desc(), "i").limit(top)


@dataclass
class DataReport:
    n_seeds: int = 0
    n_generated: int = 0
    leak_threshold: float = LEAK_THRESHOLD
    diversity: dict = field(default_factory=dict)
    seed_diversity: dict = field(default_factory=dict)
    length: dict = field(default_factory=dict)
    labels: dict = field(default_factory=dict)
    nearest_neighbour: dict = field(default_factory=dict)
    privacy: dict = field(default_factory=dict)
    warnings: list = field(default_factory=list)

    def as_dict(self) -> dict:
        def clean(x):
            if isinstance(x, dict):
                return {k: clean(v) for k, v in x.items()}
            if isinstance(x, (list, tuple)):
                return [clean(v) for v in x]
            return None if isinstance(x, float) and not math.isfinite(x) else x

        return json.loads(json.dumps(clean(asdict(self)), default=str))

    @classmethod
    def from_dict(cls, d: dict) -> DataReport:
        return cls(**{k: v for k, v in d.items() if k in cls.__dataclass_fields__})

    def summary(self) -> str:
        return f"{self.n_generated} examples from {self.n_seeds} seeds, distinct-2 {self.diversity.get('distinct_2')}, leak rate {self.privacy.get('leak_rate')}, {len(self.warnings)} warnings"


def warnings_of(r: DataReport) -> list[str]:
    out = []
    d2, s2 = r.diversity.get("distinct_2"), r.seed_diversity.get("distinct_2")
    if d2 is not None and s2 and d2 < 0.6 * s2:
        out.append(f"distinct-2 fell from {s2:.4f} to {d2:.4f}")
    if (leak := r.privacy.get("leak_rate")) is not None and leak > 0.2:
        out.append(f"{leak:.4f} of the examples are near a seed")
    if (same := r.privacy.get("exact_carryover_rate")) is not None and same > 0:
        out.append(f"{same:.4f} of the examples equal a seed")
    if r.labels.get("drifted"):
        out.append(f"labels drifted: chi-square {r.labels['chi_square']:.4f}")
    if (near := r.nearest_neighbour.get("mean")) is not None and near < 0.05:
        out.append(f"crowded: mean distance to the nearest neighbour {near:.4f}")
    if r.length.get("empty_count"):
        out.append(f"{r.length['empty_count']} examples are empty once normalised")
    if r.n_generated and r.diversity.get("n_tokens") == 0:
        out.append("no tokens in the examples")
    return out


def quality_report(seeds: DataFrame, generated: DataFrame, embedder=None, threshold: float = LEAK_THRESHOLD) -> DataReport:
    """Of examples (id, input, output, tag)."""
    from .embed import build_embedder

    text = lambda df: df.select("id", "tag", T.example_text(F.col("input"), F.col("output")).alias("text")).withColumn("norm", T.normalize(F.col("text"))).withColumn("toks", T.tokens(F.col("norm")))
    s, g = text(seeds).persist(), text(generated).persist()
    one = lambda df: (df.first() or {}) and df.first().asDict()
    r = DataReport(s.count(), g.count(), threshold, diversity=one(diversity(g, "toks")), seed_diversity=one(diversity(s, "toks")), length=one(length_profile(g)), labels=distribution_drift(tag_distribution(g), tag_distribution(s)))
    if r.n_generated and r.n_seeds:
        embedder = embedder or build_embedder(None, g.select("id", "text").unionByName(s.select((-F.col("id") - 1).alias("id"), "text")))
        vec = lambda df: embedder.embed(df.select("id", "text")).join(df.select("id", "norm"), "id").persist()
        gv, sv = vec(g), vec(s)
        best = closest_seed(gv, sv).persist()
        r.nearest_neighbour = one(neighbour_distances(gv))
        r.privacy = one(memorisation(best, threshold)) | {"n_seeds": r.n_seeds, "threshold": threshold, "offenders": [x.asDict() for x in offenders(best).collect()]}
        for held in (gv, sv, best):
            held.unpersist()
    s.unpersist()
    g.unpersist()
    r.warnings = warnings_of(r)
    return r
