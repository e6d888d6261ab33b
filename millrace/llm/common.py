"""What the training-data operators share: reading, words, cutting lineage, batches, ranks."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts, as a character class of Java, RE2 and Python alike.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where the session names none and runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    if not re.match(r"local(\[|$)", sc.master):
        raise RuntimeError("spark.checkpoint.dir is not set; on a cluster, tables between steps need a folder that all machines share")
    mine = getattr(sc, "_millrace_dir", None)
    if mine is None:
        mine = tempfile.mkdtemp(prefix="millrace-")
        sc._millrace_dir = mine
    return mine


def cut(df: DataFrame, name: str = "part", compression: str = "snappy") -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends here and a lost executor costs only a read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._millrace_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that `cut` wrote and nothing reads any more, and let Spark drop the shuffle files of plans that are gone."""
    spark = SparkSession.active()
    for df in tables:
        at = spark._jvm.org.apache.hadoop.fs.Path(df._millrace_path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    gc.collect()
    spark._jvm.System.gc()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once, also where body uses it within a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The words of a text (null: none), split at the contracts' white space."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+"))


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def shingles_of(words: Column, size: int = 5) -> Column:
    """64-bit hashes of the runs of `size` words, repeats kept; fewer words make one shingle, none make none."""
    def runs(w: Column) -> Column:
        return (
            F.when(F.size(w) >= size, F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)])))
            .when(F.size(w) > 0, F.array(F.xxhash64(F.concat(F.lit("short "), F.array_join(w, " ")))))
            .otherwise(F.array().cast("array<bigint>"))
        )

    return let(words, runs)


def salted_rank(df: DataFrame, keys: list[str], order: list[str], rank: str, salt_of: str, salts: int) -> DataFrame:
    """Adds `rank` (from 0) within `keys`. A hot key is spread over `salts` groups; their sizes, a small table, are summed up before."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt_of), F.lit(salts)).cast("int"))
    from pyspark.sql import Window as W

    sizes = salted.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_base", F.sum("_n").over(W.partitionBy(*keys).orderBy("_salt").rowsBetween(W.unboundedPreceding, -1))).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_salt").alias("_s"), F.coalesce("_base", F.lit(0)).alias("_base"))
    ranked = salted.withColumn("_r", F.row_number().over(W.partitionBy(*keys, "_salt").orderBy(*order)) - 1)
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_salt") == F.col("_s")]
    out = ranked.join(before, on, "inner").withColumn(rank, (F.col("_base") + F.col("_r")).cast("long"))
    return out.drop("_salt", "_s", "_r", "_base", *[f"_k{i}" for i in range(len(keys))])


def whole_groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables in which no group of `key` is cut, from batches sorted by it. Held: one batch and the last group of the one before."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        at = len(keys)
        while at and keys[at - 1] == keys[-1]:
            at -= 1
        if at:
            yield pa.Table.from_batches([*rest, batch.slice(0, at)])
            rest = []
        rest.append(batch.slice(at))
    if rest:
        yield pa.Table.from_batches(rest)
