"""One query for each training-data operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import html_text, language, mixing, near_duplicates, neighbours, packing, pii, quality_model, quality_rules, repeated_bytes
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": lambda spark, d: pii.digest(table(spark, d, "documents")),
    "op2_quality_rules": lambda spark, d: quality_rules.quality_query(table(spark, d, "documents")),
    "op3_near_duplicates": lambda spark, d: near_duplicates.near_duplicates_query(table(spark, d, "documents")),
    "op4_html_text": lambda spark, d: html_text.extract(table(spark, d, "pages")),
    "op5_packing": lambda spark, d: packing.packing_query(table(spark, d, "documents")),
    "op6_neighbours": lambda spark, d: neighbours.neighbours_query(table(spark, d, "embeddings")),
    "op7_mixing": lambda spark, d: mixing.mixing_query(table(spark, d, "documents")),
    "op8_language": lambda spark, d: language.of_documents(table(spark, d, "documents")),
    "op9_repeated_bytes": lambda spark, d: repeated_bytes.removal(table(spark, d, "documents")),
    "op10_quality_model": lambda spark, d: quality_model.score(table(spark, d, "documents"), table(spark, d, "labels")),
}
ORACLE_SQL: dict[str, str] = {"op2_quality_rules": quality_rules.ORACLE}
