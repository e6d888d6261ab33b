"""The registered queries and, for each, the SQL that it must agree with. All run over whole tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import grams as G
from ..functions import text as T
from ..functions import vectors as V
from ..functions.staging import cut
from ..operators import candidates, dedup, embed, generate, ivf, lsh, metrics, similarity, split
from ..sources import examples as X
from ..sources import manifest as M

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The cosine that vector queries use: high enough to leave few pairs in the synthetic vectors, low enough to leave some.
NEAR = 0.4
N_PROBE = 3
PERMS, BANDS, BAND_ROWS = 32, 8, 4


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its own name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def normal_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = G.normalized(table(spark, sf_dir, "documents"))
    return d.withColumn("toks", T.tokens(F.col("norm")))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")


def label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, vec): the mean vector of each label, in place of trained centroids."""
    parts = vectors(spark, sf_dir).select(F.col("label").cast("long").alias("id"), F.posexplode("vec").alias("k", "x")).groupBy("id", "k").agg(F.avg("x").alias("x"))
    return parts.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda e: e["x"]).alias("vec"))


NORM = r"trim(regexp_replace(replace(strip_accents(lower(coalesce({0}, ''))), 'ß', 'ss'), '[^\p{{L}}\p{{N}}''-]+', ' ', 'g'))"
TOKENS = "CASE WHEN norm = '' THEN []::VARCHAR[] ELSE string_split(norm, ' ') END"
DOCS = f"n AS (SELECT *, {NORM.format('text')} AS norm FROM documents), d AS (SELECT *, {TOKENS} AS toks FROM n)"
WORDS = DOCS + ", w AS (SELECT doc_id, lang, unnest(toks) AS tok FROM d), b AS (SELECT doc_id, lang, toks[i] || '_' || toks[i+1] AS tok FROM (SELECT doc_id, lang, toks, unnest(range(1, len(toks))) AS i FROM d WHERE len(toks) >= 2))"
VECS = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec, label FROM embeddings), u AS (SELECT id, label, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) AS vec FROM v)"
PAIRS = VECS + ", p AS (SELECT a.id AS i, b.id AS j, greatest(-1.0, least(1.0, list_dot_product(a.vec, b.vec))) AS sim FROM u a JOIN u b ON a.id < b.id)"
BOTH = PAIRS + ", q AS (SELECT i, j, sim FROM p UNION ALL SELECT j, i, sim FROM p)"
CENTROIDS = VECS + ", ck AS (SELECT label::BIGINT AS c, k, avg(vec[k]) AS x FROM v, range(1, 65) r(k) GROUP BY 1, 2), cc AS (SELECT c, list(x ORDER BY k) AS cv FROM ck GROUP BY c), cu AS (SELECT c, list_transform(cv, lambda x: x / sqrt(list_dot_product(cv, cv))) AS cv FROM cc), pr AS (SELECT u.id, cu.c AS list, row_number() OVER (PARTITION BY u.id ORDER BY list_dot_product(u.vec, cu.cv) DESC, cu.c) AS r FROM u, cu)"
SHA = "sha256({0} || chr(31))"


# Text scalars


@query(f"WITH {DOCS} SELECT doc_id, sha256(norm) AS norm_hash, length(norm)::BIGINT AS norm_chars, len(toks)::BIGINT AS n_tokens FROM d")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normal_documents(spark, sf_dir).select("doc_id", F.sha2("norm", 256).alias("norm_hash"), F.length("norm").cast("long").alias("norm_chars"), F.size("toks").cast("long").alias("n_tokens"))


@query(f"WITH {WORDS} SELECT doc_id, count(*)::BIGINT AS n, count(DISTINCT tok)::BIGINT AS n_distinct FROM (SELECT doc_id, tok FROM w UNION ALL SELECT doc_id, tok FROM b) GROUP BY doc_id")
def word_shingle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.shingle_sizes(table(spark, sf_dir, "documents"), "doc_id", "text")


_CHARS = " UNION ALL ".join(f"SELECT p_partkey, substr(s, i::INT, {n}) AS g FROM (SELECT p_partkey, s, unnest(range(1, length(s) - {n - 2})) AS i FROM c WHERE length(s) >= {n})" for n in (3, 4, 5))


@query(f"WITH c AS (SELECT p_partkey, ' ' || {NORM.format('p_name')} || ' ' AS s FROM part), g AS ({_CHARS}) SELECT p_partkey, count(*)::BIGINT AS n, count(DISTINCT g)::BIGINT AS n_distinct FROM g GROUP BY p_partkey")
def char_shingle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "part").select("p_partkey", T.char_shingles(T.normalize(F.col("p_name"))).alias("s"))
    return s.select("p_partkey", F.size("s").cast("long").alias("n"), F.size(F.array_distinct("s")).cast("long").alias("n_distinct"))


@query(f"WITH c AS (SELECT p_partkey, {NORM.format('p_name')} AS norm FROM part), t AS (SELECT p_partkey, {TOKENS} AS toks FROM c), w AS (SELECT p_partkey, 'w:' || unnest(toks) AS f FROM t UNION ALL SELECT p_partkey, 'w:' || toks[i] || '_' || toks[i+1] FROM (SELECT p_partkey, toks, unnest(range(1, len(toks))) AS i FROM t)), cc AS (SELECT p_partkey, ' ' || norm || ' ' AS s FROM c), g AS ({_CHARS.replace('FROM c WHERE', 'FROM cc WHERE')}) SELECT p_partkey, count(DISTINCT f)::BIGINT AS n_features FROM (SELECT * FROM w UNION ALL SELECT p_partkey, 'c:' || g FROM g) GROUP BY p_partkey")
def shingle_set_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.size(T.shingle_set(T.normalize(F.col("p_name")))).cast("long").alias("n_features"))


@query(f"WITH {WORDS} SELECT tok AS ngram, count(*)::BIGINT AS n FROM b GROUP BY tok HAVING count(*) > 2")
def ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.gram_counts(table(spark, sf_dir, "documents"), "text", (2,)).groupBy("ngram").agg(F.sum("n").alias("n")).where("n > 2")


@query(f"WITH {DOCS} SELECT doc_id, {SHA.format('norm')} AS content_hash FROM d")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normal_documents(spark, sf_dir).select("doc_id", T.content_hash(F.col("norm")).alias("content_hash"))


@query("SELECT p_partkey, ('0x' || substr(md5(p_name), 1, 8))::BIGINT AS h FROM part")
def portable_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.portable_hash(F.col("p_name")).alias("h"))


# Exact duplicates and lineage hashes


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS content_hash, count(*)::BIGINT AS n_copies FROM documents GROUP BY sha256(text)")
def exact_dedup_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_copies"))


@query(f"WITH {DOCS}, k AS (SELECT doc_id, text, min(doc_id) OVER (PARTITION BY norm) AS kept FROM d) SELECT doc_id, kept AS kept_index, {SHA.format('text')} AS input_hash, substr(text, 1, 80) AS preview FROM k WHERE doc_id <> kept")
def exact_dedup_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return dedup.exact_audit(docs).withColumnRenamed("id", "doc_id")


@query("SELECT sha256(string_agg(h, '' ORDER BY h)) AS corpus_hash FROM (SELECT sha256(text) AS h FROM benchmark)")
def corpus_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.corpus_hash(table(spark, sf_dir, "benchmark"))


@query(f"SELECT sha256(string_agg({NORM.format('text')}, chr(31) ORDER BY item_id)) AS corpus_hash FROM benchmark")
def order_dependent_corpus_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.ordered_corpus_hash(table(spark, sf_dir, "benchmark"), "item_id")


# Reports


@query(f"WITH {WORDS} SELECT count(DISTINCT tok) / count(*) AS type_token_ratio FROM w")
def type_token_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.type_token_ratio(table(spark, sf_dir, "documents"), "text")


@query(f"WITH {WORDS} SELECT count(*)::BIGINT AS total, count(DISTINCT tok)::BIGINT AS \"distinct\", count(DISTINCT tok) / count(*) AS share FROM b")
def distinct_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.distinct_share(table(spark, sf_dir, "documents"), "text", 2)


@query(f"WITH {WORDS}, o AS (SELECT lang, count(*)::BIGINT AS n_tokens, count(DISTINCT tok)::BIGINT AS n_types FROM w GROUP BY lang), t AS (SELECT lang, count(DISTINCT tok) / count(*) AS distinct_2 FROM b GROUP BY lang) SELECT lang, n_types / n_tokens AS type_token_ratio, n_types / n_tokens AS distinct_1, coalesce(distinct_2, 0.0) AS distinct_2, n_tokens, n_types FROM o LEFT JOIN t USING (lang)")
def diversity_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.diversity(table(spark, sf_dir, "documents"), "text", "lang")


def _profile(by: str) -> str:
    one = lambda c, p: f"round(avg({c}::DOUBLE), 4) AS {p}_mean, min({c})::DOUBLE AS {p}_min, max({c})::DOUBLE AS {p}_max, " + ", ".join(f"round(quantile_cont({c}::DOUBLE, {q / 100}), 4) AS {p}_p{q}" for q in metrics.PERCENTILES)
    return f"WITH {DOCS}, s AS (SELECT lang, len(toks) AS w, length(norm) AS c FROM d) SELECT {by}count(*)::BIGINT AS n_examples, {one('w', 'words')}, {one('c', 'chars')}, count(*) FILTER (w = 0)::BIGINT AS empty_count FROM s" + (" GROUP BY lang" if by else "")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(_profile(""))
def length_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.length_profile(table(spark, sf_dir, "documents")))


@query(_profile("lang, "))
def length_profile_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.length_profile(table(spark, sf_dir, "documents"), "text", "lang"))


@query("SELECT coalesce(nullif(c_mktsegment, ''), '_untagged') AS label, count(*)::BIGINT AS n, count(*) / (SELECT count(*) FROM customer) AS share FROM customer GROUP BY 1")
def tag_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.proportions(metrics.tag_distribution(table(spark, sf_dir, "customer"), "c_mktsegment"))


_DRIFT = "o AS (SELECT o_orderpriority AS label, count(*)::BIGINT AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), r AS (SELECT o_orderpriority AS label, count(*)::BIGINT AS n FROM orders GROUP BY 1), t AS (SELECT coalesce(o.label, r.label) AS label, coalesce(o.n, 0) AS observed, coalesce(r.n, 0) AS reference FROM o FULL JOIN r ON o.label = r.label)"


def _drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return metrics.drift_table(metrics.tag_distribution(orders.where("o_orderstatus = 'F'"), "o_orderpriority"), metrics.tag_distribution(orders, "o_orderpriority"))


@query(f"WITH {_DRIFT} SELECT label, observed, reference FROM t")
def distribution_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drift(spark, sf_dir)


@query(f"WITH {_DRIFT}, s AS (SELECT sum(observed) AS o, sum(reference) AS r FROM t), p AS (SELECT observed / o AS p, reference / r AS q, observed, reference, reference / r * o AS e FROM t, s) SELECT round(max(abs(p - q)), 9) AS max_proportion_gap, count(*) FILTER (reference = 0)::BIGINT AS n_new_labels, count(*) FILTER (observed = 0)::BIGINT AS n_lost_labels, round(sum((observed - e) ** 2 / e), 6) AS chi_square, (count(*) - 1)::BIGINT AS chi2_dof, round(sqrt(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END) / 2 + sum(q * log2(q / ((p + q) / 2))) / 2), 7) AS js_distance FROM p")
def drift_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = metrics.drift_statistics(_drift(spark, sf_dir))
    return s.select(F.round("max_proportion_gap", 9).alias("max_proportion_gap"), "n_new_labels", "n_lost_labels", F.round("chi_square", 6).alias("chi_square"), F.col("chi2_dof").cast("long").alias("chi2_dof"), F.round("js_distance", 7).alias("js_distance"))


# Vectors and similarity joins


@query("SELECT vec_id AS id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first FROM embeddings")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("id", F.round(V.norm(F.col("vec")), 6).alias("norm"), F.round(F.get(V.unit(F.col("vec")), F.lit(0)), 6).alias("first"))


@query(f"WITH {PAIRS} SELECT i, j, round(sim, 6) AS sim FROM p WHERE sim >= {NEAR}")
def exact_duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.pairs_above(vectors(spark, sf_dir), NEAR).select("i", "j", F.round("sim", 6).alias("sim"))


@query(f"WITH {BOTH}, r AS (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS rank FROM q) SELECT i, rank::INT AS rank, j FROM r WHERE rank <= 5")
def exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.top_k(vectors(spark, sf_dir), 5).select("i", "rank", "j")


@query(f"WITH {BOTH} SELECT i, string_agg(j::VARCHAR, ',' ORDER BY j) AS neighbours, count(*)::BIGINT AS degree FROM q WHERE sim >= {NEAR} GROUP BY i")
def adjacency_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = similarity.adjacency(similarity.pairs_above(vectors(spark, sf_dir), NEAR))
    return a.select("i", F.array_join(F.transform("neighbours", lambda x: x.cast("string")), ",").alias("neighbours"), F.size("neighbours").cast("long").alias("degree"))


@query(f"WITH {BOTH}, m AS (SELECT i, 1 - max(sim) AS d FROM q GROUP BY i) SELECT count(*)::BIGINT AS n_examples, round(avg(d), 6) AS mean, round(quantile_cont(d, 0.5), 6) AS median, round(min(d), 6) AS min, round(max(d), 6) AS max, round(quantile_cont(d, 0.1), 6) AS p10, round(quantile_cont(d, 0.9), 6) AS p90, avg((d < 0.1)::INT::DOUBLE) AS frac_below_0_10 FROM m")
def nn_cosine_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = metrics.neighbour_distances(vectors(spark, sf_dir))
    return s.select("n_examples", *[F.round(c, 6).alias(c) for c in ("mean", "median", "min", "max", "p10", "p90")], "frac_below_0_10")


@query(f"WITH {VECS} SELECT a.id AS i, arg_max(b.id, struct_pack(s := list_dot_product(a.vec, b.vec), m := -b.id)) AS j FROM u a JOIN u b ON a.label = 0 AND b.label <> 0 GROUP BY a.id")
def nearest_in_other_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return similarity.nearest_in(v.where("label = 0"), v.where("label <> 0")).select("i", "j")


# Hashed and weighted text vectors


def hashed_words(docs: DataFrame, dim: int = 64) -> DataFrame:
    """(doc_id, k, w): signed hashed token counts, w of unit length over k. Rows of an id that repeats are one document."""
    if not ivf.unique_ids(docs.select(F.col("doc_id").alias("id"))):
        docs = docs.groupBy("doc_id").agg(F.concat_ws(" ", F.collect_list("text")).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in G.slices(batches, 1):
            sums, hits = G.hashed(b.column(1).to_pylist(), dim, words=(1, 1), chars=None, marked=False)
            size = np.sqrt((sums * sums).sum(1))
            row, k = np.nonzero((hits > 0) & (size > 1e-9)[:, None])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(k), pa.array(sums[row, k] / size[row])], ["doc_id", "k", "w"])

    return docs.select("doc_id", "text").mapInArrow(run, docs.select("doc_id", F.lit(0).cast("long").alias("k"), F.lit(0.0).alias("w")).schema)


_HASHED = f"{WORDS}, tf AS (SELECT doc_id, md5(tok) AS h, count(*) AS n FROM w GROUP BY doc_id, tok), hw AS (SELECT doc_id, ('0x' || substr(h, 1, 8))::BIGINT % 64 AS k, sum(CASE WHEN ('0x' || substr(h, 9, 8))::BIGINT % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END * (1 + ln(n::DOUBLE))) AS w FROM tf GROUP BY 1, 2), hs AS (SELECT doc_id, sqrt(sum(w * w)) AS size FROM hw GROUP BY doc_id)"


@query(f"WITH {_HASHED} SELECT doc_id, k, round(w / size, 5) + 0.0 AS w FROM hw JOIN hs USING (doc_id) WHERE size > 1e-9")
def hashing_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashed_words(table(spark, sf_dir, "documents")).select("doc_id", "k", (F.round("w", 5) + 0.0).alias("w"))


def word_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, tok, w): smooth TF-IDF of tokens, w of unit length over tok."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = docs.count()
    if not ivf.unique_ids(docs.select(F.col("doc_id").alias("id"))):
        docs = docs.groupBy("doc_id").agg(F.concat_ws(" ", F.collect_list("text")).alias("text"))
    w = G.row_counts(docs, "doc_id", "text").join(G.row_frequencies(docs, "text"), "tok").select("doc_id", "tok", ((1 + F.log(F.col("n").cast("double"))) * (F.log((1.0 + n) / (1 + F.col("df"))) + 1)).alias("w"))
    return w.select("doc_id", "tok", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("doc_id")))).alias("w"))


_TFIDF = f"{WORDS}, tf AS (SELECT doc_id, tok, count(*) AS n FROM w GROUP BY 1, 2), df AS (SELECT tok, count(*) AS df FROM tf GROUP BY tok), tw AS (SELECT doc_id, tok, (1 + ln(n::DOUBLE)) * (ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (tok)), ts AS (SELECT doc_id, sqrt(sum(w * w)) AS size FROM tw GROUP BY doc_id), tu AS (SELECT doc_id, tok, w / size AS w FROM tw JOIN ts USING (doc_id))"


@query(f"WITH {_TFIDF} SELECT doc_id, tok, round(w, 5) AS w FROM tu")
def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_weights(spark, sf_dir).select("doc_id", "tok", F.round("w", 5).alias("w"))


# MinHash


def token_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return lsh.text_signatures(docs, PERMS, words=(1, 1), chars=None, marked=False)


def _band_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh.band_keys(token_signatures(spark, sf_dir), BANDS, BAND_ROWS, PERMS)


_COEFFICIENTS = ", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate(lsh.coefficients(PERMS)))
_SIGNED = f"{WORDS}, h AS (SELECT DISTINCT doc_id AS id, ('0x' || substr(md5(tok), 1, 8))::BIGINT % {lsh.PRIME} AS h FROM w), c(k, a, b) AS (VALUES {_COEFFICIENTS}), m AS (SELECT id, k, min((a::BIGINT * h + b) % {lsh.PRIME}) AS m FROM h, c GROUP BY id, k)"
_BANDED = f"{_SIGNED}, bk AS (SELECT id, k // {BAND_ROWS} AS band, md5(string_agg(m::VARCHAR, ',' ORDER BY k)) AS key FROM m GROUP BY id, k // {BAND_ROWS})"


@query(f"WITH {_SIGNED} SELECT id, string_agg(m::VARCHAR, ',' ORDER BY k) AS signature FROM m GROUP BY id")
def minhash_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = token_signatures(spark, sf_dir)
    return s.select("id", F.array_join(F.transform("signature", lambda x: x.cast("string")), ",").alias("signature"))


@query(f"WITH {_BANDED} SELECT band::INT AS band, key, count(*)::BIGINT AS n FROM bk GROUP BY band, key")
def lsh_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _band_keys(spark, sf_dir).groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_BANDED} SELECT DISTINCT x.id AS i, y.id AS j FROM bk x JOIN bk y ON x.band = y.band AND x.key = y.key AND x.id < y.id")
def lsh_candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh.candidate_pairs(_band_keys(spark, sf_dir))


@query(f"WITH {_BANDED}, s AS (SELECT count(*) AS n FROM bk GROUP BY band, key) SELECT count(*)::BIGINT AS buckets, max(n)::BIGINT AS max_bucket, sum(n * (n - 1) // 2)::BIGINT AS bucket_pairs FROM s")
def lsh_bucket_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh.bucket_statistics(_band_keys(spark, sf_dir))


# Inverted lists around the labels' mean vectors


@query(f"WITH {CENTROIDS} SELECT id, list FROM pr WHERE r = 1")
def ivf_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivf.assign(vectors(spark, sf_dir), label_centroids(spark, sf_dir))


@query(f"WITH {CENTROIDS} SELECT id, list FROM pr WHERE r <= {N_PROBE}")
def ivf_probe_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivf.probe(vectors(spark, sf_dir), label_centroids(spark, sf_dir), N_PROBE)


@query(f"WITH {CENTROIDS} SELECT DISTINCT a.id AS i, b.id AS j FROM pr a JOIN pr b ON a.list = b.list AND a.r <= {N_PROBE} AND b.r = 1 AND a.id < b.id")
def ivf_candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivf.candidate_pairs(vectors(spark, sf_dir), label_centroids(spark, sf_dir), N_PROBE)


@query(f"WITH {CENTROIDS}, f AS (SELECT a.id AS i, b.id AS j, row_number() OVER (PARTITION BY a.id ORDER BY greatest(-1.0, least(1.0, list_dot_product(x.vec, y.vec))) DESC, b.id) AS rank FROM pr a JOIN pr b ON a.list = b.list AND a.r <= {N_PROBE} AND b.r = 1 JOIN u x ON x.id = a.id JOIN u y ON y.id = b.id) SELECT i, rank::INT AS rank, j FROM f WHERE rank <= 5")
def ivf_search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return ivf.search(v, v, label_centroids(spark, sf_dir), 5, N_PROBE).select("i", "rank", "j")


@query(f"WITH {CENTROIDS}, s AS (SELECT count(*) AS n FROM pr WHERE r = 1 GROUP BY list) SELECT count(*)::BIGINT AS lists, sum(n)::BIGINT AS n, min(n)::BIGINT AS min_list, max(n)::BIGINT AS max_list, avg(n) AS mean_list FROM s")
def ivf_list_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivf.list_statistics(ivf.assign(vectors(spark, sf_dir), label_centroids(spark, sf_dir)))


_CANDIDATES = CENTROIDS + f", cp AS (SELECT DISTINCT a.id AS i, b.id AS j FROM pr a JOIN pr b ON a.list = b.list AND a.r <= {N_PROBE} AND b.r = 1 AND a.id < b.id), cs AS (SELECT i, j, list_dot_product(x.vec, y.vec) AS sim FROM cp JOIN u x ON x.id = i JOIN u y ON y.id = j)"


@query(f"WITH {_CANDIDATES} SELECT count(*)::BIGINT AS candidates, count(*) FILTER (sim >= {NEAR})::BIGINT AS verified, count(*) FILTER (sim < {NEAR})::BIGINT AS rejected FROM cs")
def verify_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return ivf.verified_pairs(v, label_centroids(spark, sf_dir), N_PROBE, NEAR)[1]


@query(f"WITH {_CANDIDATES}, t AS (SELECT a.id AS i, b.id AS j FROM u a JOIN u b ON a.id < b.id AND list_dot_product(a.vec, b.vec) >= {NEAR}), g AS (SELECT i, j FROM cs WHERE sim >= {NEAR}), n AS (SELECT (SELECT count(*) FROM t) AS n_truth, (SELECT count(*) FROM g) AS n_got, (SELECT count(*) FROM t JOIN g USING (i, j)) AS n_hit) SELECT n_truth::BIGINT AS n_truth, n_got::BIGINT AS n_got, n_hit::BIGINT AS n_hit, n_hit / n_truth AS recall, n_hit / n_got AS precision, 2 * (n_hit / n_truth) * (n_hit / n_got) / (n_hit / n_truth + n_hit / n_got) AS f1 FROM n")
def ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    got, _ = ivf.verified_pairs(v, label_centroids(spark, sf_dir), N_PROBE, NEAR)
    return similarity.pair_recall(similarity.pairs_above(v, NEAR), got)


@query(f"WITH {_CANDIDATES}, x AS (SELECT i, j FROM cp UNION SELECT a.id, b.id FROM u a JOIN u b ON a.id < b.id AND list_dot_product(a.vec, b.vec) >= {NEAR}) SELECT count(*)::BIGINT AS n_pairs, sum(i)::BIGINT AS sum_i, sum(j)::BIGINT AS sum_j FROM x")
def hybrid_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivf.union_sums(vectors(spark, sf_dir), label_centroids(spark, sf_dir), N_PROBE, NEAR)


# Groups, survivors, audits

_COMPONENTS = "WITH RECURSIVE " + PAIRS + f", e AS (SELECT i, j FROM p WHERE sim >= {NEAR} UNION SELECT j, i FROM p WHERE sim >= {NEAR}), r AS (SELECT id AS node, id AS g FROM u UNION SELECT e.j, r.g FROM r JOIN e ON r.node = e.i), c AS (SELECT node AS id, min(g) AS group_id FROM r GROUP BY node)"


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.near_groups(vectors(spark, sf_dir), NEAR)


@query(_COMPONENTS + " SELECT id, group_id FROM c")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir)


@query(_COMPONENTS + " SELECT group_id, string_agg(id::VARCHAR, ',' ORDER BY id) AS members, count(*)::BIGINT AS n FROM c GROUP BY group_id HAVING count(*) > 1")
def group_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = dedup.members(_groups(spark, sf_dir)).where(F.size("members") > 1)
    return m.select("group_id", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"), F.size("members").cast("long").alias("n"))


@query(_COMPONENTS + " SELECT id FROM c WHERE id = group_id")
def near_dedup_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir).where("id = group_id").select("id")


@query(_COMPONENTS + ", m AS (SELECT y.id, x.id AS i, p.sim FROM c x JOIN c y ON x.group_id = y.group_id AND x.id < y.id JOIN p ON p.i = x.id AND p.j = y.id) SELECT id, i AS kept_index, round(sim, 6) AS similarity FROM m QUALIFY row_number() OVER (PARTITION BY id ORDER BY sim DESC, i) = 1")
def nearest_earlier_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = dedup.nearest_earlier(_groups(spark, sf_dir), vectors(spark, sf_dir))
    return n.select("id", "kept_index", F.round("similarity", 6).alias("similarity"))


# Memorisation, with the vectors of label 0 as seeds

_CLOSEST = VECS + ", x AS (SELECT a.id AS i, b.id AS j, greatest(-1.0, least(1.0, list_dot_product(a.vec, b.vec))) AS sim FROM u a JOIN u b ON a.label <> 0 AND b.label = 0), best AS (SELECT i, j, sim FROM x QUALIFY row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) = 1)"


def _closest(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).withColumn("norm", F.col("id").cast("string"))
    return metrics.closest_seed(v.where("label <> 0"), v.where("label = 0"))


@query(f"WITH {_CLOSEST} SELECT count(*)::BIGINT AS n_generated, avg((sim >= {NEAR})::INT::DOUBLE) AS leak_rate, count(*) FILTER (sim >= {NEAR})::BIGINT AS n_leaks, 0::BIGINT AS n_exact_carryover, round(avg(sim), 6) AS max_sim_mean, round(quantile_cont(sim, 0.5), 6) AS max_sim_median, round(quantile_cont(sim, 0.9), 6) AS max_sim_p90 FROM best")
def memorisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics.memorisation(_closest(spark, sf_dir), NEAR)
    return m.select("n_generated", "leak_rate", "n_leaks", "n_exact_carryover", *[F.round(c, 6).alias(c) for c in ("max_sim_mean", "max_sim_median", "max_sim_p90")])


@query(f"WITH {_CLOSEST} SELECT i, j, round(sim, 6) AS sim FROM best ORDER BY best.sim DESC, i LIMIT 5")
def leak_offenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.offenders(_closest(spark, sf_dir)).select("i", "j", F.round("sim", 6).alias("sim"))


@query(f"WITH {DOCS}, s AS (SELECT DISTINCT {NORM.format('text')} AS norm FROM benchmark) SELECT count(*)::BIGINT AS n_exact FROM d SEMI JOIN s USING (norm)")
def exact_carryover(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "benchmark").select(T.normalize(F.col("text")).alias("norm"))
    return normal_documents(spark, sf_dir).join(seeds, "norm", "left_semi").agg(F.count(F.lit(1)).alias("n_exact"))


# Judging and parsing


@query("WITH c AS (SELECT doc_id AS id, text AS input, 10 * quality AS faithfulness, quality = 1 AS keep FROM documents JOIN labels USING (doc_id)) SELECT id FROM c WHERE keep AND faithfulness >= 6 AND input NOT IN (SELECT text FROM benchmark) QUALIFY row_number() OVER (PARTITION BY input ORDER BY id) = 1")
def judge_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("input"))
    judged = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (10 * F.col("quality")).alias("faithfulness"), (F.col("quality") == 1).alias("keep"))
    return generate.gate(c, table(spark, sf_dir, "benchmark").select(F.col("text").alias("input")), judged).select("id")


@query("SELECT d.doc_id FROM documents d ANTI JOIN (SELECT doc_id FROM labels) l ON d.doc_id = l.doc_id")
def unseen_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id")


REPLIES = [
    (1, '[{"input":"a","output":"b"}]'), (2, '```json\n[{"input":"a","output":"b"},{"input":"c"}]\n```'), (3, "not json at all"),
    (4, 'Here: [{"input": 1, "output": true}, 7, {"input":"x","output":"y"}] done'), (5, ""), (6, None),
]
VERDICTS = [
    (1, '{"faithfulness": 8, "keep": true}'), (2, "nope"), (3, '{"faithfulness": "8", "keep": true}'), (4, '{"faithfulness": 8.7, "keep": true}'), (5, '{"faithfulness": "8.5", "keep": true}'),
    (6, '{"faithfulness": null, "keep": true}'), (7, '{"keep": true}'), (8, '{"faithfulness": 8, "keep": "false"}'), (9, '{"faithfulness": 8, "keep": 0}'), (10, '```\n{"faithfulness": 9, "keep": false}\n```'), (11, '{"faithfulness": 9}'),
]


@query("SELECT * FROM (VALUES (1, 0, 'a', 'b'), (2, 0, 'a', 'b'), (4, 0, '1', 'true'), (4, 1, 'x', 'y')) t(id, k, input, output)")
def json_reply_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = spark.createDataFrame(REPLIES, "id int, reply string")
    return r.select("id", F.posexplode(generate.parsed_variants(F.col("reply"))).alias("k", "v")).select("id", "k", "v.input", "v.output")


@query("SELECT * FROM (VALUES (1, 8, true), (2, 0, false), (3, 8, true), (4, 8, true), (5, 0, true), (6, 0, true), (7, 0, true), (8, 8, true), (9, 8, false), (10, 9, false), (11, 9, false)) t(id, faithfulness, keep)")
def verdict_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.createDataFrame(VERDICTS, "id int, reply string").select("id", generate.parsed_verdict(F.col("reply")).alias("v"))
    return v.select("id", "v.faithfulness", "v.keep")


_TURNS = "c AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS r2, lead(text) OVER w AS t2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"


@query(f"WITH {_TURNS} SELECT conv_id, turn, text AS input, t2 AS output FROM c WHERE role = 'user' AND r2 = 'assistant'")
def chat_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.chat_pairs(table(spark, sf_dir, "conversations"))


@query(f"WITH {_TURNS} SELECT conv_id, turn, 'user' AS first_role, text AS first_content, 'assistant' AS second_role, t2 AS second_content FROM c WHERE role = 'user' AND r2 = 'assistant'")
def chat_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.to_json(X.chat_record(F.col("input"), F.col("output")))
    back = F.from_json(line, "messages array<struct<role string, content string>>")["messages"]
    m = X.chat_pairs(table(spark, sf_dir, "conversations")).select("conv_id", "turn", back.alias("m"))
    return m.select("conv_id", "turn", *[F.get("m", F.lit(k))[f].alias(f"{n}_{f}") for k, n in enumerate(("first", "second")) for f in ("role", "content")])


# Splits and leaks


def _split_sql(source: str, unit: str, stratum: str, key: str) -> str:
    return f"""u AS (SELECT {unit} AS unit, {stratum} AS stratum, row_number() OVER (PARTITION BY {stratum} ORDER BY {key}, {unit}) AS k, count(*) OVER (PARTITION BY {stratum}) AS n FROM {source}),
s AS (SELECT DISTINCT stratum, n FROM u), r(s, ratio) AS (VALUES (0, 0.8::DOUBLE), (1, 0.1::DOUBLE), (2, 0.1::DOUBLE)),
t AS (SELECT stratum, r.s, n, floor(n * ratio)::BIGINT AS base, n * ratio - floor(n * ratio) AS frac FROM s, r),
w AS (SELECT stratum, s, base + CASE WHEN row_number() OVER (PARTITION BY stratum ORDER BY frac DESC, s) <= n - sum(base) OVER (PARTITION BY stratum) THEN 1 ELSE 0 END AS want FROM t),
e AS (SELECT stratum, s, unnest(range(1, want + 1)) AS r FROM w WHERE want > 0),
l AS (SELECT stratum, s, row_number() OVER (PARTITION BY stratum ORDER BY r DESC, s) AS k FROM e),
a AS (SELECT unit, stratum, s FROM u JOIN l USING (stratum, k))"""


_DOC_SPLIT = _split_sql("documents", "doc_id", "lang", "sha256(text)")


def document_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("unit"), F.col("lang").alias("stratum"), F.sha2("text", 256).alias("key"))


@query(f"WITH {_DOC_SPLIT} SELECT stratum, s::INT AS s, want::BIGINT AS want FROM w")
def largest_remainder_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.targets(document_units(spark, sf_dir).groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))).select("stratum", "s", F.col("want").cast("long").alias("want"))


@query(f"WITH {_DOC_SPLIT} SELECT unit, stratum, s::INT AS s FROM a")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.assign_singles(document_units(spark, sf_dir))


@query(f"WITH {_DOC_SPLIT} SELECT stratum, ['train', 'val', 'test'][s + 1] AS split, count(*)::BIGINT AS n FROM a GROUP BY 1, 2")
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.assign_singles(document_units(spark, sf_dir)).groupBy("stratum", split.split_name(F.col("s")).alias("split")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH k AS (SELECT o_orderpriority AS stratum, o_orderkey AS unit, md5(o_orderkey::VARCHAR) AS key FROM orders), " + _split_sql("k", "unit", "stratum", "key") + " SELECT stratum, s::INT AS s, count(*)::BIGINT AS n, sum(unit)::BIGINT AS sum_units FROM a GROUP BY 1, 2")
def stratified_split_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("unit"), F.col("o_orderpriority").alias("stratum"), F.md5(F.col("o_orderkey").cast("string")).alias("key"))
    return split.assign_singles(o).groupBy("stratum", "s").agg(F.count(F.lit(1)).alias("n"), F.sum("unit").alias("sum_units"))


@query()
def grouped_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = normal_documents(spark, sf_dir).select("doc_id", "lang", T.content_hash(F.col("norm")).alias("key"))
    units = d.groupBy("key").agg(F.min("doc_id").alias("unit"), F.min_by("lang", "doc_id").alias("stratum"), F.count(F.lit(1)).alias("weight"))
    return split.assign_weighted(units)


def leaky_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = normal_documents(spark, sf_dir)
    return d.select(F.col("doc_id").alias("id"), split.split_name((F.col("doc_id") % 3).cast("int")).alias("split"), T.content_hash(F.col("norm")).alias("key"))


@query(f"WITH {DOCS}, k AS (SELECT ['train', 'val', 'test'][doc_id % 3 + 1] AS split, {SHA.format('norm')} AS key, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids FROM d GROUP BY 1, 2) SELECT a.split AS split_a, b.split AS split_b, a.key, a.ids AS ids_a, b.ids AS ids_b FROM k a JOIN k b ON a.key = b.key AND a.split < b.split")
def leak_shared_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = split.shared_keys(leaky_rows(spark, sf_dir))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return s.select("split_a", "split_b", "key", text("ids_a"), text("ids_b"))


@query(f"WITH {PAIRS} SELECT i, j, round(sim, 6) AS sim, least(['train', 'val', 'test'][i % 3 + 1], ['train', 'val', 'test'][j % 3 + 1]) AS split_a, greatest(['train', 'val', 'test'][i % 3 + 1], ['train', 'val', 'test'][j % 3 + 1]) AS split_b FROM p WHERE sim >= {NEAR} AND i % 3 <> j % 3")
def leak_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).withColumn("split", split.split_name((F.col("id") % 3).cast("int")))
    return split.near_across(rows, NEAR).select("i", "j", F.round("sim", 6).alias("sim"), "split_a", "split_b")


@query(f"WITH {PAIRS}, n AS (SELECT * FROM p WHERE i % 3 <> j % 3) SELECT count(*) FILTER (sim >= {NEAR})::BIGINT AS near_duplicates, round(max(sim), 6) AS max_cosine, count(*) FILTER (sim >= {NEAR}) = 0 AS ok FROM n")
def leakage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).withColumn("split", split.split_name((F.col("id") % 3).cast("int")))
    near = cut(split.near_across(rows, NEAR).agg(F.count(F.lit(1)).alias("near_duplicates"), F.max("sim").alias("sim")), "leaks")
    most = near if near.first()["near_duplicates"] else near.select("near_duplicates").crossJoin(split.greatest_across(rows))
    return most.select("near_duplicates", F.round("sim", 6).alias("max_cosine"), (F.col("near_duplicates") == 0).alias("ok"))


@query("WITH c AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM labels) AS l, (SELECT count(*) FROM labels WHERE quality = 1) AS q) SELECT * FROM (SELECT 'seeds' AS stage, n::BIGINT AS n, 0::BIGINT AS dropped FROM c UNION ALL SELECT 'labelled', l::BIGINT, greatest(0, n - l)::BIGINT FROM c UNION ALL SELECT 'kept', q::BIGINT, greatest(0, l - q)::BIGINT FROM c)")
def stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    count = lambda df, k, name: df.agg(F.lit(k).alias("k"), F.lit(name).alias("stage"), F.count(F.lit(1)).alias("n"))
    stages = count(table(spark, sf_dir, "documents"), 0, "seeds").unionByName(count(labels, 1, "labelled")).unionByName(count(labels.where("quality = 1"), 2, "kept"))
    before = F.lag("n").over(W.orderBy("k"))
    return stages.select("stage", "n", F.greatest(F.lit(0), F.coalesce(before - F.col("n"), F.lit(0))).cast("long").alias("dropped"))


# Without an equivalent in SQL


@query()
def ivf_kmeans_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    c = ivf.train_centroids(v, ivf.default_lists(v.count()))
    got, _ = ivf.verified_pairs(v, c, 4, NEAR)
    return similarity.pair_recall(similarity.pairs_above(v, NEAR), got)


@query()
def lsa_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return similarity.top_k(embed.LsaEmbedder(dim=16, min_components=8).fit_transform(texts), 3)


@query()
def external_embedder(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return embed.ExternalEmbedder(dim=4, call=lambda ts: [[float(len(t)), float(t.count(" ")), 1.0] for t in ts]).embed(texts)


@query()
def near_dedup_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return dedup.dedup(texts, strategy="lsh", embedder=embed.HashingEmbedder(128, chars=None))[1]


@query()
def candidate_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    rows = [(r["strategy"], r["n"], r["pair_recall"], r["pair_precision"], r["recall_at_k"]) for r in candidates.benchmark(v, None, ("exact", "ivf"), 10, NEAR)]
    return spark.createDataFrame(rows, "strategy string, n long, pair_recall double, pair_precision double, recall_at_k double")
