"""Text scalars as Column expressions: normalise, tokens, shingles, hashes, extraction from replies."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
#: What the native form handles: ASCII, and the Latin-1 letters that `translate` and sharp s cover.
NATIVE = r"^[\x00-\x7FßÀ-ÅÇ-ÏÑ-ÖÙ-Ýà-åç-ïñ-öù-ýÿ]*$"


def _normalize_latin(text: Column) -> Column:
    """`normalize` for what NATIVE matches."""
    low = F.replace(F.translate(F.lower(F.coalesce(text, F.lit(""))), ACCENTED, PLAIN), F.lit("ß"), F.lit("ss"))
    return F.trim(F.regexp_replace(low, r"[^\p{L}\p{N}'-]+", " "))


def normalize_exactly(text: str | None) -> str:
    """The same for all of Unicode: NFKC, case folding, NFKD, marks dropped."""
    if text is None:
        return ""
    folded = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", str(text)).casefold())
    kept = (c if c in "'-" or unicodedata.category(c)[0] in "LN" else " " for c in folded if not unicodedata.combining(c))
    return " ".join("".join(kept).split())


@F.pandas_udf(StringType())
def normalize_unicode(text: pd.Series) -> pd.Series:
    return text.map(normalize_exactly)


def normalize(text: Column) -> Column:
    """Folded case without accents; letters, digits, apostrophes and hyphens stay, all else is one space; null gives ''. Only rows beyond Latin-1 bring their text to Python."""
    simple = text.isNull() | text.rlike(NATIVE)
    return F.when(simple, _normalize_latin(text)).otherwise(normalize_unicode(F.when(~simple, text)))


def with_normalized(df: DataFrame, text: str, into: str) -> DataFrame:
    """Adds the normalised text; only rows beyond Latin-1 go through Python."""
    simple = F.col(text).isNull() | F.col(text).rlike(NATIVE)
    return df.where(simple).withColumn(into, _normalize_latin(F.col(text))).unionByName(df.where(~simple).withColumn(into, normalize_unicode(F.col(text))))


def tokens(normal: Column) -> Column:
    """Tokens of a normalised text."""
    return F.when(normal == "", F.array().cast("array<string>")).otherwise(F.split(normal, " "))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once, even if the optimiser moves its definition into a lambda that uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ngrams(items: Column, n: int, joint: str = "_") -> Column:
    """Runs of n items, joined; none if there are fewer."""
    if n == 1:
        return items

    def runs(w: Column) -> Column:
        return F.when(F.size(w) < n, F.array().cast("array<string>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.concat_ws(joint, *[F.get(w, i + k) for k in range(n)]))
        )

    return let(items, runs)


def word_shingles(toks: Column, low: int = 1, high: int = 2) -> Column:
    return let(toks, lambda w: F.concat(*[ngrams(w, n) for n in range(max(1, low), max(high, 1) + 1)]))


def char_shingles(normal: Column, low: int = 3, high: int = 5) -> Column:
    """Windows of characters over the text between two spaces; none for an empty text."""
    letters = F.split(F.concat(F.lit(" "), normal, F.lit(" ")), "")

    def of(chars: Column) -> Column:
        return F.concat(*[ngrams(chars, n, "") for n in range(max(1, low), max(high, 1) + 1)])

    return F.when(normal == "", F.array().cast("array<string>")).otherwise(let(letters, of))


def features(normal: Column, words: tuple[int, int] = (1, 2), chars: tuple[int, int] = (3, 5)) -> Column:
    """Word runs under w: and character runs under c:, repeats kept."""

    def of(s: Column) -> Column:
        w = F.transform(word_shingles(tokens(s), *words), lambda x: F.concat(F.lit("w:"), x))
        return F.concat(w, F.transform(char_shingles(s, *chars), lambda x: F.concat(F.lit("c:"), x)))

    return let(normal, of)


def shingle_set(normal: Column, **ranges) -> Column:
    return F.array_distinct(features(normal, **ranges))


def ngram_counts(df: DataFrame, toks: str, n: int, *by: str) -> DataFrame:
    """(by..., ngram, n): how often each run of n tokens occurs; nothing for n below 1."""
    if n < 1:
        n, df = 1, df.where(F.lit(False))
    return df.select(*by, F.explode(ngrams(F.col(toks), n)).alias("ngram")).groupBy(*by, "ngram").agg(F.count(F.lit(1)).alias("n"))


def portable_hash(text: Column) -> Column:
    """31-bit hash that other engines can repeat: the head of md5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def hash64(text: Column, seed: int = 0) -> Column:
    return F.xxhash64(F.lit(seed), text)


def content_hash(*parts: Column) -> Column:
    """SHA-256 of the parts, each closed by a unit separator."""
    return F.sha2(F.concat(*[F.concat(F.coalesce(p.cast("string"), F.lit("")), F.lit("\u001f")) for p in parts]), 256)


def example_text(prompt: Column, answer: Column) -> Column:
    return F.concat(prompt, F.lit("\n"), answer)


def content_key(prompt: Column, answer: Column) -> Column:
    return content_hash(normalize(example_text(prompt, answer)))


def members_key(ids: Column) -> Column:
    """Key of a group without one of its own: the hash of its ids, sorted as strings."""
    return content_hash(F.array_join(F.array_sort(F.transform(ids, lambda x: x.cast("string"))), ","))


def unfenced(reply: Column) -> Column:
    """A reply without the code fence that it starts with."""
    r = F.btrim(reply, F.lit(" \t\n\r"))
    inner = F.regexp_replace(F.regexp_replace(r, r"^```[A-Za-z]*[ \t]*\n?", ""), r"\n?[ \t]*```[ \t\n]*$", "")
    return F.when(r.startswith("```"), inner).otherwise(r)


def json_array_in(reply: Column) -> Column:
    """From the first [ to the last ], '' if there is none."""
    return F.regexp_extract(unfenced(reply), r"(?s)\[.*\]", 0)


def json_object_in(reply: Column) -> Column:
    return F.regexp_extract(unfenced(reply), r"(?s)\{.*\}", 0)


def preview(text: Column, n: int = 80) -> Column:
    return F.substring(text, 1, n)


def normalized_all(texts: Iterable[str | None]) -> list[str]:
    return [normalize_exactly(t) for t in texts]
