"""Exact duplicates in a stream: the first row of each normalised text within the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_hash, normalize


def first_of_each(stream: DataFrame, text: str, time: str, delay: str = "1 hour") -> DataFrame:
    """`stream` with content_hash, without rows whose text came before within `delay`; state is dropped as the watermark passes."""
    keyed = stream.withColumn("content_hash", content_hash(normalize(F.col(text))))
    return keyed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["content_hash"])
