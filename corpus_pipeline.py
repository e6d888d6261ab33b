"""The corpus pipeline: language ID, near-duplicate removal, personal data, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; all but the last return the columns
of `docs`, extra ones included, whatever their names: what a stage adds for itself lies under names that `docs` does not have.
`run` writes each stage's rows as Parquet in the shared folder and reads them back for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import language, mixing, near_duplicates, packing, pii
from millrace.llm.common import cut


def unused(docs: DataFrame, name: str) -> str:
    """`name`, or a longer one that no column of `docs` has in any case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; `lang` becomes the language found.

    Null, empty and letterless texts go. Repeated rows stay; rows of one doc_id with different texts are judged together and stay if
    any has a known language. Ties go to the first language by name. An empty table stays empty; other columns pass."""
    key, lang = unused(docs, "_id"), unused(docs, "_lang")
    found = language.of_documents(docs.select("doc_id", "text", "lang", "source"))
    found = found.where("kept").groupBy(F.col("doc_id").alias(key)).agg(F.min("language").alias(lang))
    kept = docs.join(found, F.col("doc_id") == F.col(key))
    return kept.select(*[F.col(lang).alias(c) if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that of the smallest doc_id.

    Repeated rows become one; rows of one doc_id with different texts are different documents. Null and empty texts are one
    class. Very long texts are compared whole. An empty table stays empty; other columns pass."""
    return near_duplicates.keep_one(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; n_chars follows.

    Null texts stay null, empty ones empty; every row stays, repeated ones too; other columns pass."""
    return pii.mask_with_length(docs).select(*[f"`{c}`" for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; those that it leaves out go.

    A null source is one of its own, a text without words counts 0. Rows that repeat a doc_id share what the mix takes of the doc_id:
    each stays as often as the largest of its rows' shares. An empty table stays empty; other columns pass."""
    key, times, copy = unused(docs, "_id"), unused(docs, "_times"), unused(docs, "_copy")
    size, hidden = unused(docs, "_size"), unused(docs, "_source")
    found = mixing.mix(docs.select("doc_id", "text", "source")).select(F.col("doc_id").alias(key), F.col("source").alias(hidden), F.col("size").alias(size), F.col("times").alias(times))
    # Rows of one doc_id, source and size are alike to the mix.
    found = cut(found.where(F.col(times) > 0).groupBy(key, hidden, size).agg(F.max(times).alias(times)), "times")
    on = (F.col("doc_id") == F.col(key)) & F.col("source").cast("string").eqNullSafe(F.col(hidden)) & (mixing.n_words(F.col("text")) == F.col(size))
    taken = docs.join(found, on)
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).select(*[f"`{c}`" for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in sequences.

    Every row is packed for itself, repeated ones too; null and empty texts are one end token; other columns are left out."""
    return packing.packing_query(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Trained models and seeded choices have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, f"stage-{name}")
    return docs
