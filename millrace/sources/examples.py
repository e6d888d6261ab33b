"""Examples in and out: JSON arrays, chat JSON lines, splits."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id long, input string, output string, tag string"


def load_examples(spark: SparkSession, path: str) -> DataFrame:
    """(id, input, output, tag) from one JSON array of objects; `id` is the place in the array.

    Raises FileNotFoundError without a file, ValueError for bad JSON, another root, or an element without input and output."""
    try:
        raw = spark.read.text(path, wholetext=True).limit(2).collect()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(path) from e
        raise
    if len(raw) != 1:
        raise ValueError(f"{path}: one JSON array is needed")
    whole = spark.createDataFrame([(raw[0][0],)], "value string")
    kind = whole.select(F.schema_of_variant(F.try_parse_json("value"))).first()[0]
    if kind is None or not kind.startswith("ARRAY"):
        raise ValueError(f"{path}: {'not JSON' if kind is None else 'not a JSON array'}")
    rows = whole.select(F.posexplode(F.from_json("value", "array<string>")).alias("id", "item")).withColumn("v", F.try_parse_json("item"))
    get = lambda k: F.try_variant_get("v", f"$.{k}", "string")
    parsed = rows.select(F.col("id").cast("long").alias("id"), get("input").alias("input"), get("output").alias("output"), F.coalesce(get("tag"), F.lit("")).alias("tag"), F.coalesce(F.schema_of_variant("v"), F.lit("")).startswith("OBJECT").alias("ok"))
    bad = parsed.where(~F.col("ok") | F.col("input").isNull() | F.col("output").isNull()).orderBy("id").select("id").first()
    if bad:
        raise ValueError(f"{path}: element {bad['id']} is not an object with input and output")
    return parsed.drop("ok")


def chat_record(prompt: Column, answer: Column) -> Column:
    said = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.struct(F.array(said("user", prompt), said("assistant", answer)).alias("messages"))


def chat_lines(examples: DataFrame) -> DataFrame:
    return examples.select("id", F.to_json(chat_record(F.col("input"), F.col("output"))).alias("value"))


def write_chat(examples: DataFrame, path: str, one_file: bool = False) -> None:
    """One chat object a line. Sorted by id over all part files, or within the one that `one_file` asks for."""
    lines = chat_lines(examples).orderBy("id").select("value")
    (lines.coalesce(1) if one_file else lines).write.mode("overwrite").text(path)


def write_chat_file(examples: DataFrame, path: str) -> int:
    """The same as a plain file beside the driver, row by row; for small sets."""
    n = 0
    with open(path, "w", encoding="utf-8") as f:
        for r in chat_lines(examples).orderBy("id").toLocalIterator():
            f.write(r["value"] + "\n")
            n += 1
    return n


def save_examples(examples: DataFrame, path: str) -> None:
    """A JSON array with an indent, as a plain file; parent folders are made."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    rows = [{"input": r["input"], "output": r["output"], "tag": r["tag"]} for r in examples.orderBy("id").toLocalIterator()]
    with open(path, "w", encoding="utf-8") as f:
        json.dump(rows, f, ensure_ascii=False, indent=2)


def write_splits(examples: DataFrame, folder: str) -> None:
    """Chat lines under split=train, split=val and split=test."""
    rows = examples.select("split", "id", F.to_json(chat_record(F.col("input"), F.col("output"))).alias("value"))
    rows.repartition("split").sortWithinPartitions("split", "id").select("split", "value").write.mode("overwrite").partitionBy("split").text(folder)


def write_split_files(examples: DataFrame, folder: str, prefix: str = "split", names=("train", "val", "test")) -> dict[str, str]:
    """split-train.jsonl and so on, as plain files."""
    os.makedirs(folder, exist_ok=True)
    out = {}
    for name in names:
        out[name] = os.path.join(folder, f"{prefix}-{name}.jsonl")
        write_chat_file(examples.where(F.col("split") == name), out[name])
    return out


def chat_pairs(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, input, output): each user turn with the assistant's next one."""
    from pyspark.sql import Window as W

    w = W.partitionBy("conv_id").orderBy("turn")
    nxt = conversations.withColumn("_role", F.lead("role").over(w)).withColumn("_text", F.lead("text").over(w))
    return nxt.where("role = 'user' and _role = 'assistant'").select("conv_id", "turn", F.col("text").alias("input"), F.col("_text").alias("output"))
