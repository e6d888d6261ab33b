"""Expansion and judging by functions that the caller brings, and the parsing of what they reply."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.staging import cut

Model = Callable[[str], str]
MIN_SCORE, VARIANTS, ATTEMPTS = 6, 3, 3
EXPAND = "Write %d new examples in the manner of this one, as a JSON array of objects with the keys input and output.\ninput: %s\noutput: %s"
JUDGE = "Rate this example. Reply with a JSON object with the keys faithfulness (0 to 10), diversity (0 to 10) and keep (true or false).\ninput: %s\noutput: %s"


def ask(df: DataFrame, prompt: str, model: Model, into: str = "reply", error: str = "error", attempts: int = ATTEMPTS) -> DataFrame:
    """Adds the model's reply to each prompt, or the error of the last attempt. Tasks may be run again, so the model should bear that."""
    at = df.columns.index(prompt)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            replies, errors = [], []
            for p in b.iloc[:, at]:
                reply, wrong = None, None
                for _ in range(attempts):
                    try:
                        reply, wrong = str(model(p)), None
                        break
                    except Exception as e:  # noqa: BLE001  a failing model is a value here
                        wrong = f"{type(e).__name__}: {e}"
                replies.append(reply)
                errors.append(wrong)
            yield b.assign(**{into: replies, error: errors})

    return df.mapInPandas(run, f"{schema}, {into} string, {error} string")


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def parsed_variants(reply: Column) -> Column:
    """Array of (input, output) from a reply; elements that aren't objects with both keys are left out, other replies give none."""
    items = F.from_json(T.json_array_in(reply), "array<string>")
    pairs = F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.struct(_text(F.try_parse_json(x), "$.input").alias("input"), _text(F.try_parse_json(x), "$.output").alias("output")))
    return F.filter(pairs, lambda p: p["input"].isNotNull() & p["output"].isNotNull())


def score_of(v: Column, key: str) -> Column:
    """Whole-number score under a key: numbers are cut off, strings must be whole numbers, all else is 0."""
    kind = F.schema_of_variant(F.coalesce(F.try_variant_get(v, f"$.{key}", "variant"), F.parse_json(F.lit("null"))))
    number = F.try_variant_get(v, f"$.{key}", "double")
    string = _text(v, f"$.{key}")
    return F.when(kind == "STRING", F.when(string.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(string).try_cast("int"))).when(kind.rlike("BIGINT|DOUBLE|DECIMAL|BOOLEAN"), F.when(F.abs(number) < 1e9, number.cast("int")))


def parsed_verdict(reply: Column) -> Column:
    """(faithfulness, keep): an unreadable score is 0; keep is true for whatever isn't false, zero, empty or missing."""
    v = F.try_parse_json(T.json_object_in(reply))
    keep = F.coalesce(F.try_variant_get(v, "$.keep", "variant").isNotNull(), F.lit(False)) & ~F.coalesce(_text(v, "$.keep"), F.lit("")).isin("false", "0", "0.0", "", "[]", "{}", "null")
    quoted = F.schema_of_variant(F.coalesce(F.try_variant_get(v, "$.keep", "variant"), F.parse_json(F.lit("null")))) == "STRING"
    keep = keep | (quoted & (F.coalesce(_text(v, "$.keep"), F.lit("")) != ""))
    return F.struct(F.coalesce(score_of(v, "faithfulness"), F.lit(0)).alias("faithfulness"), keep.alias("keep"))


def expand(seeds: DataFrame, model: Model, n: int = VARIANTS) -> tuple[DataFrame, DataFrame]:
    """(id, input, output, tag) of new examples of `seeds`, and the replies with their errors."""
    prompts = seeds.select("id", F.format_string(EXPAND, F.lit(n), F.col("input"), F.col("output")).alias("prompt"))
    replies = cut(ask(prompts, "prompt", model), "replies")  # the model is asked once, whoever reads the replies
    found = replies.select("id", F.posexplode(parsed_variants(F.col("reply"))).alias("k", "v"))
    return found.select("id", "k", "v.input", "v.output", F.lit("expanded").alias("tag")), replies


def gate(candidates: DataFrame, existing: DataFrame, judged: DataFrame, min_score: int = MIN_SCORE) -> DataFrame:
    """Candidates (id, input, ...) that are new, that their verdict (id, faithfulness, keep) keeps, and that come first with their input."""
    new = candidates.join(existing.select("input").distinct(), "input", "left_anti")
    passed = new.join(judged, "id").where(F.col("keep") & (F.col("faithfulness") >= min_score))
    rank = F.row_number().over(W.partitionBy("input").orderBy("id"))
    return passed.withColumn("_r", rank).where("_r = 1").select(candidates.columns)


def filter_candidates(candidates: DataFrame, existing: DataFrame, model: Model, min_score: int = MIN_SCORE) -> DataFrame:
    """`gate` with the model's own verdicts; known inputs are left out before any call."""
    new = candidates.join(existing.select("input").distinct(), "input", "left_anti")
    prompts = new.select("id", F.format_string(JUDGE, F.col("input"), F.col("output")).alias("prompt"))
    judged = ask(prompts, "prompt", model).select("id", parsed_verdict(F.col("reply")).alias("v")).select("id", "v.faithfulness", "v.keep")
    return gate(new.select(candidates.columns), existing, judged, min_score)
