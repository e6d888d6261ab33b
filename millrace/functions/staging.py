"""Cutting lineage: tables written to the folder that the session shares between driver and executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a local folder of our own only where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    if getattr(sc, "_millrace_dir", None) is None:
        sc._millrace_dir = tempfile.mkdtemp(prefix="millrace-")
    return sc._millrace_dir


def cut(df: DataFrame, name: str = "part") -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends here, and a lost executor costs only a read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
