"""Operator 2: quality rules as a short-circuit cascade, with DataFrame functions only.

Each rule is a predicate over the text's own statistics that says *reject*. `measured_order` times every rule from the raw
text on over a seeded sample, sees how much of it the rule rejects, and sorts the rules by rejection per cost; `cascade`
chains them in that order, so a text pays for a rule only if all earlier ones let it pass. The base rule is first, as its counts are wanted anyway. The order changes
the cost and never the verdict, which is that no rule rejects.

Cases: a null or empty text has no words and fails the base rule; ties and repeated rows are judged each by
itself; other columns, whatever their names, pass through `cascade` untouched; an empty table gives no rows.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let, words_of

#: About so many rows the cost estimate looks at; verdicts don't depend on it.
SAMPLE_ROWS = 1024
SEED = 17


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column


def n_repeat_words(words: Column, size: int = 5) -> Column:
    """Words that lie in a run of `size` words found twice or more in the text."""

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda p, k: F.when(k == F.size(at) - 1, F.lit(size)).otherwise(F.least(F.lit(size), F.get(at, k + 1) - p)))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def repeated(pairs: Column) -> Column:
        twice = F.filter(pairs, lambda x, k: F.coalesce(F.get(pairs, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(pairs, k + 1)["h"] == x["h"], F.lit(False)))
        return let(F.array_sort(F.transform(twice, lambda x: x["i"])), covered)

    def of_runs(runs: Column) -> Column:
        pairs = F.array_sort(F.transform(runs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(runs)) == F.size(runs), F.lit(0)).otherwise(let(pairs, repeated))

    def of_words(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))
        return F.when(F.size(w) < size, F.lit(0)).otherwise(let(runs, of_runs))

    return let(words, of_words).cast("long")


def symbols_in(text: Column) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long")


def line_statistics(text: Column) -> Column:
    """n_lines with a word, and n_dup_lines of them."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    return let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))


def word_statistics(text: Column, repeats: bool = True) -> Column:
    """n_words, word_chars and, if asked for, n_repeat_words."""

    def of_words(w: Column) -> list[Column]:
        return [F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), *([n_repeat_words(w).alias("n_repeat_words")] if repeats else [])]

    return let(words_of(text), lambda w: F.struct(*of_words(w)))


def text_statistics(text: Column) -> Column:
    """A struct of w (words), l (lines) and n_symbols."""
    return F.struct(word_statistics(text).alias("w"), line_statistics(text).alias("l"), symbols_in(text).alias("n_symbols"))


def base_failed(n_words: Column, repeats: Column) -> Column:
    return (n_words < 10) | (100 * repeats > 20 * n_words)


def default_rules(text: Column, n_words: Column, word_chars: Column, n_symbols: Column, n_lines: Column, n_dup_lines: Column) -> list[Rule]:
    """Reject symbol noise, odd word lengths, repeated lines, and texts with few letters or mostly capitals."""
    letters = lambda: F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    capitals = lambda: F.length(F.regexp_replace(text, r"[^\p{Lu}]", ""))
    return [
        Rule("symbols", 10 * n_symbols > 3 * n_words),
        Rule("word_length", (word_chars < 2 * n_words) | (word_chars > 15 * n_words)),
        Rule("dup_lines", 2 * n_dup_lines > n_lines),
        Rule("letters", 2 * letters() < word_chars),
        Rule("capitals", 2 * capitals() > word_chars),
    ]


def raw_rules(text: Column) -> list[Rule]:
    """`default_rules` with each rule's statistics inside, as their costs are measured."""
    w, lines = word_statistics(text, False), line_statistics(text)
    return default_rules(text, w["n_words"], w["word_chars"], symbols_in(text), lines["n_lines"], lines["n_dup_lines"])


def measured_order(docs: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Names of the rules by rejection per second on about `sample_rows` rows, a seeded share of all; best first, given order breaks ties.

    Each rule is timed by itself from the raw text on, so it bears the cost of the statistics that it reads."""
    n = docs.count()
    share = min(1.0, sample_rows / max(1, n))
    t = F.coalesce(F.col(text), F.lit(""))
    # Equal texts are chosen row by row, so a text with many copies doesn't come whole.
    sample = docs.where(F.rand(SEED) < share).select(t.alias("t")).cache()
    rules = raw_rules(F.col("t"))
    try:
        seen = max(1, sample.count())

        def cost(flag: Column) -> tuple[float, float]:
            began = time.perf_counter()
            hit = sample.agg(F.sum(F.coalesce(flag, F.lit(False)).cast("int"))).first()[0] or 0
            return time.perf_counter() - began, hit / seen

        idle = min(cost(F.length("t") < 0)[0] for _ in range(2))
        rated = []
        for k, rule in enumerate(rules):
            seconds, rejected = min(cost(rule.rejects) for _ in range(2))
            rated.append((-rejected / max(seconds - idle, 1e-4), k, rule.name))
    finally:
        sample.unpersist()
    return [name for *_, name in sorted(rated)]


def cascade(rules: Sequence[Rule]) -> Column:
    """The name of the first rule that rejects, or null; a later rule isn't evaluated once one has rejected."""
    chain = None
    for rule in rules:
        chain = F.when(rule.rejects, F.lit(rule.name)) if chain is None else chain.when(rule.rejects, F.lit(rule.name))
    return F.lit(None).cast("string") if chain is None else chain


def judged(docs: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> Column:
    """A struct for a row of `docs`: the counts, base_failed, and the rule that rejected first (null: kept)."""
    order = measured_order(docs, text, sample_rows)
    t = F.coalesce(F.col(text), F.lit(""))

    def of(s: Column) -> Column:
        n, chars, repeats, lines, dups, symbols = s["w"]["n_words"], s["w"]["word_chars"], s["w"]["n_repeat_words"], s["l"]["n_lines"], s["l"]["n_dup_lines"], s["n_symbols"]
        rules = {r.name: r for r in default_rules(t, n, chars, symbols, lines, dups)}
        failed = base_failed(n, repeats)
        return F.struct(
            n.alias("n_words"), chars.alias("word_chars"), symbols.alias("n_symbols"), dups.alias("n_dup_lines"), repeats.alias("n_repeat_words"),
            failed.alias("base_failed"), F.when(failed, F.lit("base")).otherwise(cascade([rules[k] for k in order])).alias("rejected_by"),
        )

    return let(text_statistics(t), of)


def judge(docs: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS, verdict: str = "verdict") -> DataFrame:
    """`docs` with the struct `verdict`; a column of that name is an error, all others stay as they are."""
    if verdict.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"there is a column {verdict!r} already; give another name for the verdict")
    return docs.withColumn(verdict, judged(docs, text, sample_rows))


def quality_query(docs: DataFrame) -> DataFrame:
    v = F.col("verdict")
    return judge(docs.select("doc_id", "text")).select("doc_id", v["n_words"].alias("n_words"), v["word_chars"].alias("word_chars"), v["n_symbols"].alias("n_symbols"), v["n_dup_lines"].alias("n_dup_lines"), v["n_repeat_words"].alias("n_repeat_words"), v["base_failed"].alias("base_failed"), v["rejected_by"].isNull().alias("kept"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
t AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM t) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dups FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
s AS (SELECT w.doc_id, w.text, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        (length(w.text) - length(regexp_replace(w.text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        coalesce(l.n, 0)::BIGINT AS n_lines, coalesce(l.dups, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 3 * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 2 * n_dup_lines > n_lines
       OR 2 * length(regexp_replace(text, '[^\p{L}]', '', 'g')) < word_chars OR 2 * length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) > word_chars) AS kept
FROM b
"""
