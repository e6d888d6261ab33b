"""Operator 1: personal data by fixed patterns and a character-level bidirectional LSTM with CRF transitions.

The tagger reads a text in overlapping windows. All four kinds hold a digit or an at sign, so windows without
either have nothing to decode. Each window is decoded by itself; spans that a window's edge cuts off are joined with what
the next window has of them, and the spans of all windows of a text are then reconciled at once: the set of spans without overlaps that scores best, found by weighted interval scheduling, is
added to the spans of the fixed patterns, which always stay.

Cases: null and empty texts have no spans; texts of any length are read whole, some windows at a time; repeated rows
are each searched; other columns pass through `mask` untouched; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .crf_lstm import KINDS, PAD, STRIDE, TAGS, WINDOW, Tagger, encode, trained

Span = tuple[str, int, int]

LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A number that fails at its first digit fails at each later one too, so looking there only keeps time linear.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]")
DIGIT = re.compile(r"[0-9]")
LETTER = re.compile(r"[^\W\d_]")
#: Windows that are decoded at once.
AT_ONCE = 512


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns by kind, then start."""
    out: list[Span] = []
    end = 0
    at = text.find("@")
    while at >= 0:
        m = DOMAIN.match(text, at)
        if m:
            start = at
            while start > end and LOCAL_END.match(text, start - 1):
                start -= 1
            if start < at:
                end = m.end()
                out.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(DIGIT.findall(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def window_starts(text: str) -> np.ndarray:
    """Starts of the windows that hold a digit or an at sign; they overlap by half."""
    at = np.fromiter((m.start() for m in TRIGGER.finditer(text)), np.int64)
    if not len(at):
        return at
    block = np.unique(at // STRIDE)
    return STRIDE * np.unique(np.concatenate([block, np.maximum(block - 1, 0)]))


def spans_of_tags(tags: np.ndarray, scores: np.ndarray, start: int, length: int) -> list[tuple[float, str, int, int, bool, bool]]:
    """(score, kind, start, end, open before, open after) of one window's tags; a span is open where a window's inner edge cuts it off."""
    out, k, n = [], 0, min(len(tags), length - start)
    while k < n:
        name = TAGS[tags[k]] if tags[k] else ""
        if name and (name[0] == "B" or k == 0 and start > 0):
            kind, a = name[2:], k
            k += 1
            while k < n and TAGS[tags[k]] == f"I-{kind}":
                k += 1
            margin = scores[np.arange(a, k), tags[a:k]] - scores[a:k, 0]
            out.append((float(margin.sum()), kind, start + a, start + k, a == 0 and start > 0, k == len(tags) and start + k < length))
        else:
            k += 1
    return out


def stitched(parts: list[tuple[float, str, int, int, bool, bool]]) -> list[tuple[float, str, int, int]]:
    """Whole spans of a text, from those of its windows in order: parts of one kind that are cut off and overlap are one span.

    What stays open at an edge is a piece of something that no window chain saw whole, and goes."""
    out: list[tuple[float, str, int, int]] = []
    held: dict[str, tuple[float, int, int, bool]] = {}
    for score, kind, a, b, before, after in sorted(parts, key=lambda p: (p[2], p[3])):
        if before and kind in held and held[kind][2] > a:
            first, start, end, was_open = held.pop(kind)
            if not was_open:
                # The rest of the span before is longer where this window saw further.
                score, a, before = first + max(0.0, score) * (b - end) / max(1, b - a) if b > end else first, start, False
        if before:
            held[kind] = (score, a, b, True)
        elif after:
            held[kind] = (score, a, b, False)
        else:
            out.append((score, kind, a, b))
    return out


def reconcile(found: list[tuple[float, str, int, int]], fixed: list[Span]) -> list[Span]:
    """The best-scoring set of spans without overlaps that leaves all fixed spans alone."""
    taken = sorted((a, b) for _, a, b in fixed)
    starts = [a for a, _ in taken]
    tops = np.maximum.accumulate([b for _, b in taken]) if taken else []

    def free(a: int, b: int) -> bool:
        k = bisect.bisect_left(starts, b)
        return not k or tops[k - 1] <= a

    best: dict[Span, float] = {}
    for score, kind, a, b in found:
        if score > 0 and free(a, b):
            best[kind, a, b] = max(score, best.get((kind, a, b), 0.0))
    spans = sorted(best, key=lambda s: (s[2], s[1], s[0]))
    ends = [s[2] for s in spans]
    value, took = [0.0], []
    for k, s in enumerate(spans):
        j = bisect.bisect_right(ends, s[1], 0, k)
        with_it = value[j] + best[s]
        took.append(j if with_it > value[k] else -1)
        value.append(max(with_it, value[k]))
    out, k = [], len(spans)
    while k:
        if took[k - 1] >= 0:
            out.append(spans[k - 1])
            k = took[k - 1]
        else:
            k -= 1
    return out[::-1]


def plausible(text: str, kind: str, a: int, b: int) -> bool:
    """What the tagger adds must hold what its kind can't be without."""
    part = text[a:b]
    if kind == "email":
        return "@" in part and "." in part
    if text[max(0, a - 1) : a].isalnum() or text[b : b + 1].isalnum():
        return False
    n = len(DIGIT.findall(part))
    return not LETTER.search(part) and {"ip": 4 <= n <= 17 and part.count(".") >= 3, "card": 13 <= n <= 19, "phone": 7 <= n <= 15}[kind]


def tagger_spans(texts: list[str], tagger: Tagger) -> list[list[tuple[float, str, int, int]]]:
    """Per text, the spans of all its windows."""
    parts: list[list[tuple[float, str, int, int, bool, bool]]] = [[] for _ in texts]
    todo: list[tuple[int, int]] = []

    def flush() -> None:
        x = np.full((len(todo), WINDOW), PAD, np.int64)
        for row, (k, a) in enumerate(todo):
            codes = encode(texts[k][a : a + WINDOW])
            x[row, : len(codes)] = codes
        scores = tagger.emissions(x)
        for (k, a), tags, s in zip(todo, tagger.decode(scores), scores, strict=True):
            if tags.any():
                parts[k] += spans_of_tags(tags, s, a, len(texts[k]))
        todo.clear()

    for k, text in enumerate(texts):
        for a in window_starts(text):
            todo.append((k, int(a)))
            if len(todo) == AT_ONCE:
                flush()
    if todo:
        flush()
    return [[f for f in stitched(p) if plausible(t, *f[1:])] for t, p in zip(texts, parts, strict=True)]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def find_spans(texts: list[str], tagger: Tagger) -> list[tuple[list[Span], list[Span]]]:
    """Per text its fixed spans and those that the tagger adds."""
    base = [base_spans(t) for t in texts]
    return [(b, reconcile(f, b)) for b, f in zip(base, tagger_spans(texts, tagger), strict=True)]


def digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""
    tagger = trained()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, sha, spans, added = {k: [] for k in KINDS}, [], [], []
            for lo in range(0, batch.num_rows, 256):
                texts = [t or "" for t in batch.column(1).slice(lo, 256).to_pylist()]
                for base, more in find_spans(texts, tagger):
                    for kind in KINDS:
                        counts[kind].append(sum(s[0] == kind for s in base))
                    sha.append(hashlib.sha256(joined(base).encode()).hexdigest())
                    spans.append(joined(base + more))
                    added.append(len(more))
            arrays = [batch.column(0), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(sha, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def masked(text: str, spans: list[Span]) -> str:
    """The text with each stretch of spans replaced by the kind of its first, in angle-free capitals: [EMAIL]."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with personal data in `text` replaced; null texts stay null."""
    tagger = trained()
    at = docs.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean: list[str | None] = []
            for lo in range(0, batch.num_rows, 256):
                texts = batch.column(at).slice(lo, 256).to_pylist()
                found = find_spans([t or "" for t in texts], tagger)
                clean += [t if t is None else masked(t, base + more) for t, (base, more) in zip(texts, found, strict=True)]
            arrays = [*batch.columns]
            arrays[at] = pa.array(clean, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    # Names with dots can't be handed to a map, so columns go by number meanwhile.
    numbered = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    return numbered.mapInArrow(run, numbered.schema).toDF(*docs.columns)


def mask_with_length(docs: DataFrame) -> DataFrame:
    out = mask(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
