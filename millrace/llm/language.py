"""Operator 8: language identification by Bayesian evidence fusion.

Four kinds of evidence multiply: the text's likelihood under byte-trigram models, the language that markup declares, the country
suffix of the address, and a host prior. Host priors are counts of the other evidence by host, smoothed towards
the host's domain and that towards the whole, all by grouped aggregation. One more hypothesis, "other", has the
likelihood of unstructured text; a text whose best hypothesis is "other", or whose posterior is below MIN_POSTERIOR,
or which has no letter, is rejected.

Cases: null, empty and letterless texts are rejected with a null language; a null host counts as a host of its own; without any labelled
row the models rest on built-in function words; repeated rows count one by one; columns that aren't read pass by;
an empty table gives no rows. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: About so many labelled rows fit the text models (a seeded share of all).
FIT_ROWS = 2000
BUCKETS = 1 << 16
#: The text's mean log likelihood counts as so many independent trigrams at most.
TEMPER = 60
MIN_POSTERIOR = 0.5
#: Pseudo-documents by which a host leans on its domain, and a domain on the whole.
HOST_STRENGTH, DOMAIN_STRENGTH = 20.0, 50.0
DECLARED_RIGHT, SUFFIX_RIGHT = 0.9, 0.8
#: Mean log likelihood of a trigram of unstructured text: all buckets alike.
OTHER = float(-np.log(BUCKETS))
#: Bytes of letters (all beyond ASCII count) and the space; trigrams of anything else say nothing of a language.
LETTERS = np.array([b >= 128 or 97 <= b <= 122 or b == 32 for b in range(256)])
OTHER_PRIOR = 1e-3
#: Up to so many hosts their priors are broadcast (a few MB); beyond, they are joined by a shuffle.
BROADCAST_HOSTS = 20_000
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl"}
SEEDS = {
    "en": "the of and to in is that it was for on with as be at by this from or are not have an they which one you were all her there been their has would when who more said",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über",
    "fr": "le de la et les des en un une du dans qui que est pour il par sur pas plus au avec ce ne se sont aux cette ou son sa être ont mais comme nous vous",
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también",
}


def trigrams(text: str) -> np.ndarray:
    """Bucket numbers of the byte trigrams of letters and spaces in the lower-cased text between two spaces."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)
    if len(raw) < 3:
        return np.zeros(0, np.int64)
    ok = LETTERS[raw]
    b = raw.astype(np.uint32)
    code = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
    return (code * np.uint32(2654435761) >> np.uint32(16))[ok[:-2] & ok[1:-1] & ok[2:]].astype(np.int64)


def fit(rows: Iterable[tuple[str, str]]) -> tuple[list[str], np.ndarray]:
    """Languages and their log likelihoods by bucket, from (text, language) rows and the built-in words."""
    counts: dict[str, np.ndarray] = {}
    for text, lang in [*((w, k) for k, w in SEEDS.items()), *rows]:
        if text and lang:
            counts.setdefault(lang, np.zeros(BUCKETS))
            counts[lang] += np.bincount(trigrams(text), minlength=BUCKETS)
    langs = sorted(counts)
    return langs, np.stack([np.log((c := counts[k]) + 0.02) - np.log(c.sum() + 0.02 * BUCKETS) for k in langs]).astype(np.float32)


def text_likelihoods(docs: DataFrame, langs: list[str], table: np.ndarray, text: str = "text") -> DataFrame:
    """`docs` (without `text`) with n (trigrams) and ll (per language, the mean log likelihood of a trigram)."""
    shared = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(table.T))
    keep = [c for c in docs.columns if c != text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = shared.value
        for batch in batches:
            n, ll, letters = [], [], []
            for x in batch.column(batch.schema.names.index(text)):
                t = x.as_py() or ""
                codes = trigrams(t) if t else np.zeros(0, np.int64)
                total = np.zeros(len(langs))
                for a in range(0, len(codes), 1 << 18):
                    total += logs[codes[a : a + (1 << 18)]].sum(0, dtype=np.float64)
                n.append(len(codes))
                letters.append(any(map(str.isalpha, t)))
                ll.append((total / max(1, len(codes))).tolist())
            arrays = [batch.column(batch.schema.names.index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(n, pa.int64()), pa.array(letters, pa.bool_()), pa.array(ll, pa.list_(pa.float64()))], [*keep, "n", "letters", "ll"])

    return docs.mapInArrow(run, f"{schema}, n long, letters boolean, ll array<double>")


def suffix_language(address: Column) -> Column:
    host = F.regexp_extract(F.lower(address), r"^(?:[a-z]+://)?([^/:?#]+)", 1)
    table = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])
    return table[F.regexp_extract(host, r"\.([a-z]{2})$", 1)]


def declared_language(markup: Column) -> Column:
    found = F.lower(F.regexp_extract(markup, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2})", 1))
    return F.when(found != "", found)


def identify(docs: DataFrame, labelled: DataFrame | None = None, fit_rows: int = FIT_ROWS) -> DataFrame:
    """`docs`: doc_id, text, and any of declared, suffix (languages), host, domain. Adds language, posterior, kept; leaves the text out.

    `labelled` (text, lang) fits the text models."""
    spark = docs.sparkSession
    rows: list[tuple[str, str]] = []
    if labelled is not None:
        held_ = "doc_id" if "doc_id" in labelled.columns else "text"
        known = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
        share = min(1.0, fit_rows / max(known.count(), 1))
        # Chosen by doc_id, so a text with many copies doesn't come whole; the limit is for tables with few ids.
        rows = [(r[0], r[1]) for r in known.where(F.pmod(F.xxhash64(held_), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("text", "lang").limit(2 * fit_rows).collect()]
    langs, table = fit(rows)
    all_langs = [*langs, "other"]
    for c in ("declared", "suffix", "host", "domain"):
        if c not in docs.columns:
            docs = docs.withColumn(c, F.lit(None).cast("string"))
    held = cut(text_likelihoods(docs.select("doc_id", "text", "declared", "suffix", "host", "domain"), langs, table), "likelihoods")

    said = lambda c, k, right: F.when(F.col(c).isNull() | ~F.col(c).isin(*langs), 0.0).when(F.col(c) == k, float(np.log(right))).otherwise(float(np.log((1 - right) / max(1, len(langs) - 1))))
    weight = F.least(F.col("n"), F.lit(TEMPER)).cast("double")
    evidence = []
    for i, k in enumerate(all_langs):
        ll = F.lit(OTHER) if k == "other" else F.get(F.col("ll"), F.lit(i))
        evidence.append(weight * ll + (F.lit(0.0) if k == "other" else said("declared", k, DECLARED_RIGHT) + said("suffix", k, SUFFIX_RIGHT)))
    held = held.withColumn("_e", F.array(*evidence)).withColumn("_first", F.when(F.col("letters"), F.array_position(F.col("_e"), F.array_max("_e")).cast("int") - 1))

    # Host priors: counts of the languages that the other evidence finds, by host, domain and in all.
    counts = [F.sum(F.when(F.col("_first") == i, 1.0).otherwise(0.0)).alias(f"h{i}") for i in range(len(langs))]
    hosts = cut(held.groupBy("host", "domain").agg(*counts), "hosts")
    total = hosts.agg(*[F.sum(f"h{i}").alias(f"h{i}") for i in range(len(langs))]).first()
    whole = np.array([float(total[i] or 0) for i in range(len(langs))]) + 1.0
    whole /= whole.sum()
    sums = [F.sum(f"h{i}").alias(f"d{i}") for i in range(len(langs))]
    domains = hosts.groupBy(F.col("domain").alias("_d")).agg(*sums)
    size_d = sum((F.coalesce(F.col(f"d{i}"), F.lit(0.0)) for i in range(len(langs))), F.lit(0.0))
    size_h = sum((F.col(f"h{i}") for i in range(len(langs))), F.lit(0.0))
    up = [F.when(F.col("domain").isNull(), float(whole[i])).otherwise((F.coalesce(F.col(f"d{i}"), F.lit(0.0)) + DOMAIN_STRENGTH * float(whole[i])) / (size_d + DOMAIN_STRENGTH)) for i in range(len(langs))]
    priors = hosts.join(domains, F.col("domain") == F.col("_d"), "left").select(
        F.col("host").alias("_host"), F.col("domain").alias("_domain"), F.array(*[F.log((F.col(f"h{i}") + HOST_STRENGTH * up[i]) / (size_h + HOST_STRENGTH)) for i in range(len(langs))]).alias("_prior")
    )
    if hosts.count() <= BROADCAST_HOSTS:
        priors = F.broadcast(priors)
    else:
        priors = cut(priors, "priors")
    joined = held.join(priors, F.col("host").eqNullSafe(F.col("_host")) & F.col("domain").eqNullSafe(F.col("_domain")), "left")
    post = F.array(*[F.get("_e", F.lit(i)) + (F.lit(float(np.log(OTHER_PRIOR))) if k == "other" else F.get("_prior", F.lit(i)) + float(np.log(1 - OTHER_PRIOR))) for i, k in enumerate(all_langs)])
    joined = joined.withColumn("_p", post).withColumn("_top", F.array_max("_p"))
    best = F.get(F.array(*map(F.lit, all_langs)), F.array_position("_p", F.col("_top")).cast("int") - 1)
    share = 1 / F.aggregate(F.transform("_p", lambda x: F.exp(x - F.col("_top"))), F.lit(0.0), lambda a, x: a + x)
    joined = joined.withColumn("_l", best).withColumn("_s", share)
    kept = F.col("letters") & (F.col("_l") != "other") & (F.col("_s") >= MIN_POSTERIOR)
    return joined.select("doc_id", F.when(F.col("letters") & (F.col("_l") != "other"), F.col("_l")).alias("language"), F.when(F.col("letters"), F.col("_s")).otherwise(0.0).alias("posterior"), kept.alias("kept"))


def of_documents(docs: DataFrame) -> DataFrame:
    """Documents: the source is the host; markup and addresses are looked for in the text itself."""
    address = F.regexp_extract(F.col("text"), r"https?://([A-Za-z0-9.-]+)", 1)
    return identify(docs.select("doc_id", "text", declared_language(F.col("text")).alias("declared"), suffix_language(address).alias("suffix"), F.col("source").cast("string").alias("host")), docs.select("doc_id", "text", "lang"))


def of_pages(pages: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """Pages (page_id as doc_id, url, html and their text): language by text, html lang, address suffix, host and domain."""
    host = F.regexp_extract(F.lower("url"), r"^(?:[a-z]+://)?([^/:?#]+)", 1)
    domain = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    return identify(pages.select(F.col("page_id").alias("doc_id"), "text", declared_language(F.col("html")).alias("declared"), suffix_language(F.col("url")).alias("suffix"), host.alias("host"), domain.alias("domain")), labelled)
