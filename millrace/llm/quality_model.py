"""Operator 10: quality score by regularised quadratic discriminant analysis.

Statistics of the whole text are transformed to be roughly normal; each class gets a mean and a covariance,
shrunk towards the pooled one and towards a multiple of the identity. The score is the logistic of the difference of the
two log densities, taken as Mahalanobis distances through Cholesky factors that are computed once.

Means and covariances are sums over all labelled rows of the training fold, of which
two rows of sums reach the driver; only the logistic's two numbers rest on a bounded sample. Cases: null and empty texts have statistics of their own (zeros) and a score; where a
class has fewer than two labelled rows, every score is the smoothed share of label 1; null labels are ignored;
repeated rows count one by one; other columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let, shingles_of, words_of

FEATURES = ("log_words", "word_length", "distinct_words", "repeated_runs", "repeated_lines", "line_words", "symbols", "capitals", "stops", "commas", "marks")
#: Shares of the pooled covariance and of the identity in each class covariance.
TO_POOLED, TO_IDENTITY = 0.05, 0.05
THRESHOLD = 0.3
#: About so many labelled rows of the training fold, a seeded share of all, calibrate the logistic.
CALIBRATION_ROWS = 20_000
SEED = 13


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def features(text: Column) -> Column:
    """A struct of FEATURES for a text."""
    t = F.coalesce(text, F.lit(""))
    count = lambda chars: F.length(t) - F.length(F.translate(t, chars, "")) if len(chars) == 1 else F.regexp_count(t, F.lit(chars))
    share = lambda a, b: a / F.greatest(b, F.lit(1))
    root = lambda x: F.sqrt(x)

    def of_words(w: Column) -> Column:
        runs = let(shingles_of(w), lambda r: F.struct(F.size(r).alias("n"), F.size(F.array_distinct(r)).alias("d")))
        return F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d"), F.length(F.array_join(w, "")).alias("chars"), runs.alias("runs"))

    w = let(words_of(text), of_words)
    lines = let(F.filter(F.split(t, "\n"), lambda x: x != ""), lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))
    raw = F.struct(w.alias("w"), lines.alias("l"), count("[#*$%&|<>{}]").alias("sym"), count(r"\p{Lu}").alias("up"), count(r"[.]").alias("stops"), count(",").alias("commas"), count("[!?]").alias("marks"))

    def of(r: Column) -> Column:
        n, chars = r["w"]["n"], r["w"]["chars"]
        return F.struct(
            F.log1p(n.cast("double")).alias("log_words"),
            F.log1p(share(chars, n)).alias("word_length"),
            (F.log1p(r["w"]["d"].cast("double")) - F.log1p(n.cast("double"))).alias("distinct_words"),
            root(1 - share(r["w"]["runs"]["d"], r["w"]["runs"]["n"])).alias("repeated_runs"),
            root(1 - share(r["l"]["d"], r["l"]["n"])).alias("repeated_lines"),
            F.log1p(share(n, r["l"]["n"])).alias("line_words"),
            root(share(r["sym"], n)).alias("symbols"),
            root(share(r["up"], chars)).alias("capitals"),
            root(share(r["stops"], n)).alias("stops"),
            root(share(r["commas"], n)).alias("commas"),
            root(share(r["marks"], n)).alias("marks"),
        )

    return let(raw, of)


@dataclass(frozen=True)
class Model:
    """Standardised features; per class a mean, the inverse Cholesky factor and the log determinant."""

    center: np.ndarray
    scale: np.ndarray
    means: tuple[np.ndarray, np.ndarray]
    factors: tuple[np.ndarray, np.ndarray]
    log_dets: tuple[float, float]
    log_prior: float
    constant: float | None = None
    slope: float = 1.0
    offset: float = 0.0


def fit_sums(n: np.ndarray, s: np.ndarray, ss: np.ndarray, to_pooled: float = TO_POOLED, to_identity: float = TO_IDENTITY) -> Model:
    """From per-class counts n[2], sums s[2,d] and sums of products ss[2,d,d]."""
    d = s.shape[1]
    zero = np.zeros(d)
    if n.min() < 2:
        share = (n[1] + 1) / (n.sum() + 2)
        return Model(zero, zero + 1, (zero, zero), (np.eye(d), np.eye(d)), (0.0, 0.0), 0.0, float(share))
    total = n.sum()
    center = s.sum(0) / total
    scale = np.sqrt(np.maximum(np.diag(ss.sum(0)) / total - center**2, 1e-8))
    means, covs = [], []
    for c in (0, 1):
        m = s[c] / n[c]
        covs.append((ss[c] / n[c] - np.outer(m, m)) / np.outer(scale, scale))
        means.append((m - center) / scale)
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / total
    factors, dets = [], []
    for c in (0, 1):
        own = (1 - to_pooled - to_identity) * covs[c] + to_pooled * pooled + to_identity * np.eye(d) * max(np.trace(covs[c]) / d, 1e-3)
        low = np.linalg.cholesky(own)
        factors.append(np.linalg.inv(low))
        dets.append(float(2 * np.log(np.diag(low)).sum()))
    return Model(center, scale, tuple(means), tuple(factors), tuple(dets), float(np.log(n[1] / n[0])))


def fit(featured: DataFrame, label: str = "quality") -> Model:
    """`featured` has the struct column f and a label of 0 or 1; others and nulls are ignored."""
    d = len(FEATURES)
    x = [F.col("f")[k] for k in FEATURES]
    sums = [F.sum(x[i]).alias(f"s{i}") for i in range(d)] + [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(d) for j in range(i + 1)]
    n, s, ss = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for r in featured.where(F.col(label).isin(0, 1)).groupBy(label).agg(F.count(F.lit(1)).alias("n"), *sums).collect():
        c = int(r[label])
        n[c] = r["n"]
        for i in range(d):
            s[c, i] = r[f"s{i}"]
            for j in range(i + 1):
                ss[c, i, j] = ss[c, j, i] = r[f"p{i}_{j}"]
    return fit_sums(n, s, ss)


def calibrated(gaps: np.ndarray, labels: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and offset of the logistic over the log-density gap, by Newton's method on balanced classes."""
    if not len(gaps) or len(set(labels.tolist())) < 2:
        return 1.0, 0.0
    size = max(1.0, float(np.median(np.abs(gaps))))
    x = np.column_stack([np.clip(gaps / size, -3, 3), np.ones(len(gaps))])
    weight = np.where(labels == 1, 0.5 / (labels == 1).sum(), 0.5 / (labels == 0).sum()) * 100
    b = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(2), x.T @ (weight * (labels - p)) - ridge * b)
        b = b + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(b[0], 1e-3) / size), float(b[1])


def score_column(model: Model) -> Column:
    """The score of the struct column f, as one arithmetic expression."""
    if model.constant is not None:
        return F.lit(model.constant)
    return 1 / (1 + F.exp(-F.least(F.greatest(F.lit(model.slope) * gap_column(model) + F.lit(model.offset), F.lit(-60.0)), F.lit(60.0))))


def gap_column(model: Model) -> Column:
    """Log density of label 1 less that of label 0, of the struct column f."""
    z = [(F.col("f")[k] - F.lit(float(model.center[i]))) / F.lit(float(model.scale[i])) for i, k in enumerate(FEATURES)]

    def of(zs: Column) -> Column:
        logs = []
        for mean, factor, det in zip(model.means, model.factors, model.log_dets, strict=True):
            distance = F.lit(det)
            for k in range(len(FEATURES)):
                row = F.lit(0.0)
                for j in range(k + 1):
                    row = row + F.lit(float(factor[k, j])) * (F.get(zs, F.lit(j)) - F.lit(float(mean[j])))
                distance = distance + F.pow(row, F.lit(2.0))
            logs.append(-0.5 * distance)
        return logs[1] - logs[0] + F.lit(model.log_prior)

    return let(F.array(*z), of)


def calibrate(model: Model, featured: DataFrame, label: str = "quality", rows: int = CALIBRATION_ROWS) -> Model:
    if model.constant is not None:
        return model
    known = featured.where(F.col(label).isin(0, 1))
    # A seeded share of the rows, so that about `rows` come, from all tasks together.
    share = min(1.0, rows / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    seen = chosen.select(gap_column(model).alias("gap"), F.col(label).cast("int").alias("label")).toPandas()
    slope, offset = calibrated(seen["gap"].to_numpy(float), seen["label"].to_numpy(int))
    return replace(model, slope=slope, offset=offset)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of `docs`; `labels` has doc_id and quality."""
    featured = cut(docs.select("doc_id", features(F.col("text")).alias("f")), "features")
    known = labels.select(F.col("doc_id").alias("_id"), "quality").where(F.col("quality").isNotNull())
    model = calibrate(fit(known_rows := cut(featured.where(~held_out(F.col("doc_id"))).join(known, F.col("doc_id") == F.col("_id")).select("doc_id", "f", "quality"), "labelled")), known_rows)
    out = featured.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(model).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int"))
