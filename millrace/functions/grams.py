"""Tokens and runs of texts by batches in Python: each text is normalised once, and each batch's repeats are counted before anything is sent on."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

#: Bytes of text that are taken apart at once.
SLICE = 12_000_000
_BEYOND = re.compile(T.NATIVE.replace("^[", "[^").rstrip("*$"))
_PLAIN = {c: c if chr(c).isalnum() or chr(c) in "'-" else " " for c in range(128)} | {ord(a): b for a, b in zip(T.ACCENTED, T.PLAIN, strict=True)} | {ord("ß"): "ss"}


def normal(text: str | None) -> str:
    """`T.normalize` of one text."""
    if text is None:
        return ""
    if text.isascii() or not _BEYOND.search(text):
        return " ".join(text.lower().translate(_PLAIN).split())
    return T.normalize_exactly(text)


def normalized(df: DataFrame, text: str = "text", into: str = "norm") -> DataFrame:
    """Adds the normalised text, computed once a row whatever is made of it later."""
    columns = df.columns
    at = columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([normal(t) for t in b.column(at).to_pylist()], pa.string())], [*columns, into])

    return df.mapInArrow(run, df.select("*", F.lit("").alias(into)).schema)


def slices(batches: Iterable[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most about SLICE bytes of text."""
    for b in batches:
        n = max(1, b.num_rows * SLICE // max(SLICE, b.column(text).nbytes))
        for a in range(0, b.num_rows, n):
            yield b.slice(a, n)


class Runs:
    """Runs found in a batch: `owner` (row) and `code` of each, in the order of the rows; `texts(codes)` names codes."""

    def __init__(self, owner: np.ndarray, code: np.ndarray, size: int, texts: Callable[[np.ndarray], pa.Array]):
        self.owner, self.code, self.size, self.texts = owner, code, size, texts

    def dense(self) -> Runs:
        """The same with codes from 0 to the number of different runs."""
        code, names = pd.factorize(self.code)
        return Runs(self.owner, code.astype(np.int64), len(names), lambda c, names=names: self.texts(names[c]))


def word_runs(texts: list[str | None]) -> Callable[[int], Runs]:
    """A function of n, 1 or 2, to the texts' runs of n tokens, joined by _."""
    parts = pc.split_pattern(pa.array([normal(t) for t in texts], pa.string()), " ")
    tokens, size = parts.flatten(), np.asarray(pc.list_value_length(parts)).astype(np.int64)
    live = np.asarray(pc.not_equal(tokens, "")) if len(tokens) else np.zeros(0, bool)  # an empty text has none
    size = np.bincount(np.repeat(np.arange(len(size)), size)[live], minlength=len(size))
    tokens = tokens.filter(pa.array(live))
    coded = tokens.dictionary_encode()
    names, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(size)), size)

    def of(n: int) -> Runs:
        at = np.arange(max(0, len(code) - n + 1))
        at = at[owner[at] == owner[at + n - 1]] if len(at) else at
        if n == 1:
            return Runs(owner, code, len(names), lambda c: names.take(pa.array(c)))
        v = max(1, len(names))
        return Runs(owner[at], code[at] * v + code[at + 1], v * v, lambda c: pc.binary_join_element_wise(names.take(pa.array(c // v)), names.take(pa.array(c % v)), "_"))

    return of


def counted(owner: np.ndarray, code: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, code, n), each pair once, by owner."""
    at, n = np.unique(owner * size + code, return_counts=True)
    return at // size, at % size, n


def gram_counts(df: DataFrame, text: str, sizes: tuple[int, ...] = (1,), *by: str) -> DataFrame:
    """(by..., size, ngram, n): how often the batches' texts hold each run of one or two tokens; a run has a row for each batch that has it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 0):
            keys = list(zip(*(b.column(k + 1).to_pylist() for k in range(len(by))), strict=True)) if by else [()] * b.num_rows
            place: dict = {}
            group = np.array([place.setdefault(k, len(place)) for k in keys], np.int64)
            first = np.unique(group, return_index=True)[1]
            runs = word_runs(b.column(0).to_pylist())
            for n in sizes:
                r = runs(n).dense() if n > 1 else runs(n)
                g, c, m = counted(group[r.owner], r.code, max(1, r.size))
                if len(g):
                    yield pa.RecordBatch.from_arrays([*(b.column(k + 1).take(pa.array(first[g])) for k in range(len(by))), pa.array(np.full(len(g), n, np.int32)), r.texts(c), pa.array(m)], [*by, "size", "ngram", "n"])

    rows = df.select(F.col(text).alias("_text"), *by)
    return rows.mapInArrow(run, df.select(*by, F.lit(0).alias("size"), F.lit("").alias("ngram"), F.lit(0).cast("long").alias("n")).schema)


def char_runs(normals: list[str], n: int) -> Runs:
    """Runs of n characters of normalised texts between two spaces, codes dense; none for an empty text."""
    whole = "".join(f" {t} " if t else "" for t in normals)
    size = np.array([len(t) + 2 if t else 0 for t in normals], np.int64)
    owner = np.repeat(np.arange(len(size)), size)
    letters = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    there = np.zeros(int(letters.max()) + 1 if len(letters) else 1, np.int64)
    there[letters] = 1
    width = max(1, int(there.sum()))
    letter = (np.cumsum(there) - 1)[letters]
    at = np.arange(max(0, len(letters) - n + 1))
    at = at[owner[at] == owner[at + n - 1]] if len(at) else at
    code, most = letter[at], width
    for k in range(1, n):
        if most * width >= 1 << 62:
            code = pd.factorize(code)[0]
            most = int(code.max()) + 1
        code, most = code * width + letter[at + k], most * width
    code, names = pd.factorize(code)
    first = np.zeros(len(names), np.int64)
    first[code[::-1]] = at[::-1]
    return Runs(owner[at], code.astype(np.int64), len(names), lambda c: pa.array([whole[p : p + n] for p in first[c].tolist()], pa.string()))


def features(texts: list[str | None], words: tuple[int, int] = (1, 2), chars: tuple[int, int] | None = (3, 5), marked: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
    """What `T.features` finds, kind by kind: (row, code) of each occurrence and the names of the codes, with `marked` behind w: or c:."""
    runs = word_runs(texts)
    for n in range(words[0], words[1] + 1):
        r = runs(n).dense() if n > 1 else runs(n)
        yield r.owner, r.code, [f"w:{t}" if marked else t for t in r.texts(np.arange(r.size)).to_pylist()]
    normals = [normal(t) for t in texts] if chars else []
    for n in range(chars[0], chars[1] + 1) if chars else ():
        r = char_runs(normals, n)
        yield r.owner, r.code, [f"c:{t}" if marked else t for t in r.texts(np.arange(r.size)).to_pylist()]


def digests(names: list[str], head: str = "") -> np.ndarray:
    """(names, 2): the first two 32-bit words of the MD5 of each name."""
    return np.frombuffer(b"".join(hashlib.md5((head + t).encode()).digest()[:8] for t in names), ">u4").reshape(-1, 2).astype(np.int64)


def hashed(texts: list[str | None], dim: int, head: str = "", signed: bool = True, sublinear: bool = True, **kinds) -> tuple[np.ndarray, np.ndarray]:
    """(sums, hits), both (texts, dim): of signed weights of the features in each bucket, and how many features fell there."""
    sums, hits = np.zeros(len(texts) * dim), np.zeros(len(texts) * dim, np.int64)
    for owner, code, names in features(texts, **kinds):
        if len(owner):
            row, code, n = counted(owner, code, len(names))
            d = digests(names, head)
            place = row * dim + (d[:, 0] % dim)[code]
            w = (1 + np.log(n.astype(float))) if sublinear else n.astype(float)
            sums += np.bincount(place, w * np.where(d[:, 1] % 2 == 1, 1.0, -1.0)[code] if signed else w, len(sums))
            hits += np.bincount(place, minlength=len(hits))
    return sums.reshape(-1, dim), hits.reshape(-1, dim)


def row_counts(df: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, tok, n): the tokens of each row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            r = word_runs(b.column(1).to_pylist())(1)
            row, code, n = counted(r.owner, r.code, max(1, r.size))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), r.texts(code), pa.array(n)], [id_, "tok", "n"])

    return df.select(id_, text).mapInArrow(run, df.select(id_, F.lit("").alias("tok"), F.lit(0).cast("long").alias("n")).schema)


def row_frequencies(df: DataFrame, text: str) -> DataFrame:
    """(tok, df): in how many rows each token stands, each row of its own."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 0):
            r = word_runs(b.column(0).to_pylist())(1)
            _, code, _ = counted(r.owner, r.code, max(1, r.size))
            code, n = np.unique(code, return_counts=True)
            yield pa.RecordBatch.from_arrays([r.texts(code), pa.array(n.astype(np.int64))], ["tok", "df"])

    return df.select(text).mapInArrow(run, "tok string, df long").groupBy("tok").agg(F.sum("df").alias("df"))


def shingle_sizes(df: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, n, n_distinct) of runs of one and two tokens, of rows with a token."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            runs = word_runs(b.column(1).to_pylist())
            total, distinct = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for n in (1, 2):  # no token holds the joint, so runs of different sizes differ
                r = runs(n).dense() if n > 1 else runs(n)
                total += np.bincount(r.owner, minlength=b.num_rows)
                distinct += np.bincount(counted(r.owner, r.code, max(1, r.size))[0], minlength=b.num_rows)
            live = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(live)), pa.array(total[live]), pa.array(distinct[live])], [id_, "n", "n_distinct"])

    return df.select(id_, text).mapInArrow(run, df.select(id_, F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("n_distinct")).schema)
