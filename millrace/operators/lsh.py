"""MinHash signatures and banding over feature sets."""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grams as G
from ..functions.staging import cut
from ..functions.text import let, portable_hash

PRIME = (1 << 31) - 1
MARGIN = 0.8


def band_parameters(num_perm: int, threshold: float) -> tuple[int, int]:
    """(bands, rows) whose chance of a shared band at `threshold` is nearest one half; ties take more bands."""
    options = ((b, num_perm // b) for b in range(1, num_perm + 1))
    return min(options, key=lambda o: (abs(0.5 - (1 - (1 - threshold ** o[1]) ** o[0])), -o[0]))


def jaccard_of_cosine(cosine: float, margin: float = MARGIN) -> float:
    c = min(1.0, max(0.0, cosine))
    return min(1.0, max(1e-3, margin * (1.0 if c >= 1 else c / (2 - c))))


def coefficients(num_perm: int, seed: int = 13) -> list[tuple[int, int]]:
    r = random.Random(seed)
    return [(r.randrange(1, PRIME), r.randrange(PRIME)) for _ in range(num_perm)]


def signatures(sets: DataFrame, features: str, num_perm: int, seed: int = 13) -> DataFrame:
    """(id, signature): per permutation the least (a h + b) mod p over a row's features; an empty set gives all p.

    Each row holds its whole set, so this is a narrow step: no shuffle, and every feature is hashed once.
    """
    least = lambda hs, a, b: F.coalesce(F.array_min(F.transform(hs, lambda h: (F.lit(a) * h + F.lit(b)) % PRIME)), F.lit(PRIME))
    hashes = F.transform(F.array_distinct(F.coalesce(F.col(features), F.array().cast("array<string>"))), lambda f: F.pmod(portable_hash(f), F.lit(PRIME)))
    return sets.select("id", let(hashes, lambda hs: F.array(*[least(hs, a, b) for a, b in coefficients(num_perm, seed)])).alias("signature"))


def text_signatures(texts: DataFrame, num_perm: int, seed: int = 13, **kinds) -> DataFrame:
    """`signatures` of the features of (id, text), of the kinds that `grams.features` has: each different feature of a batch is hashed and permuted once."""
    perms = coefficients(num_perm, seed)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in G.slices(batches, 1):
            least = np.full((num_perm, b.num_rows), PRIME, np.int64)
            for owner, code, names in G.features(b.column(1).to_pylist(), **kinds):
                if len(owner):
                    once = pd.unique(owner * len(names) + code)  # in the order of the rows
                    owner, code = once // len(names), once % len(names)
                    starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                    h = G.digests(names)[:, 0] % PRIME
                    for k, (x, y) in enumerate(perms):
                        low = np.minimum.reduceat(((x * h + y) % PRIME).astype(np.int32)[code], starts)
                        least[k, owner[starts]] = np.minimum(least[k, owner[starts]], low)
            whole = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * num_perm), pa.array(least.T.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), whole], ["id", "signature"])

    rows = texts.select("id", "text")
    return rows.mapInArrow(run, rows.select("id", F.array(F.lit(0).cast("long")).alias("signature")).schema)


def bands_of(signature: Column, bands: int, rows: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.md5(F.array_join(F.transform(F.slice(signature, b * rows + 1, rows), lambda x: x.cast("string")), ",")))


def band_keys(signed: DataFrame, bands: int, rows: int, num_perm: int | None = None) -> DataFrame:
    """(id, band, key) of each band of `rows` signature values; values beyond the last band are unused."""
    if num_perm is not None and bands * rows > num_perm:
        raise ValueError(f"{bands} bands of {rows} need more than {num_perm} permutations")
    return signed.select("id", F.posexplode(bands_of(F.col("signature"), bands, rows)).alias("band", "key"))


def candidate_pairs(keys: DataFrame) -> DataFrame:
    """(i, j), i < j, of ids that share a bucket. The join is on the bucket; ids that share several come once.

    Keys are written out first, so that signatures are computed once and not for either side."""
    keys = cut(keys, "band-keys")
    left, right = keys.select("band", "key", F.col("id").alias("i")), keys.select("band", "key", F.col("id").alias("j"))
    return left.join(right, ["band", "key"]).where("i < j").select("i", "j").distinct()


def neighbours(keys: DataFrame, id_: int) -> DataFrame:
    """(j): who shares a bucket with one id."""
    mine = keys.where(F.col("id") == id_).select("band", "key")
    return keys.join(mine, ["band", "key"], "left_semi").where(F.col("id") != id_).select(F.col("id").alias("j")).distinct()


def bucket_statistics(keys: DataFrame) -> DataFrame:
    """One row (buckets, max_bucket, bucket_pairs)."""
    sizes = keys.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("buckets"), F.max("n").alias("max_bucket"), F.sum((F.col("n") * (F.col("n") - 1) / 2).cast("long")).alias("bucket_pairs"))
