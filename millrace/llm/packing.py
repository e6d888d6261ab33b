"""Operator 5: pack documents into sequences by a configuration linear program.

Tokenised documents are cut into pieces of at most `capacity` tokens. The number of pieces of each length, a
table of at most `capacity` rows, is all that planning needs: multiplicative weights over the lengths price
patterns (multisets of lengths that fit a sequence) by an unbounded-knapsack dynamic programme; the fractional
solution is rounded down, and what it leaves is filled by best fit. The plan also knows a lower bound from the weights.
Pieces get their place by rank within their length, so no piece is ever sent to the driver.

Cases: a null or empty text is one end token; equal documents are packed each for itself; other columns pass by
(only doc_id and text are read); an empty table gives no rows; a text of any length is cut, never dropped.
"""

from __future__ import annotations

import json
import math
import sys
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, salted_rank

CAPACITY = 2048
END = 0
#: Rounds of multiplicative weights, and the rate at which covered lengths lose weight.
ROUNDS, RATE = 96, 0.5
#: Chunks whose tokens each Python worker remembers.
REMEMBERED = 500000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def encoder(path: str) -> Callable[[str], bytes]:
    """Text to little-endian unsigned 32-bit token ids, as the byte-level BPE file at `path` has them.

    The same merges run in tiktoken, three times as fast as in tokenizers; texts that hold a special token's own
    string go to tokenizers itself.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = [t["content"] for t in spec.get("added_tokens", [])]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
    ranks = {bytes(table[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    whole = Tokenizer.from_file(path)
    little = sys.byteorder == "little"

    def encode(text: str) -> bytes:
        ids = whole.encode(text, add_special_tokens=False).ids if any(s in text for s in special) else fast.encode_ordinary(text)
        return array("I", ids).tobytes() if little else np.asarray(ids, "<u4").tobytes()

    return encode


def pieces_of(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Per piece of each document: doc_id, piece, start, length, ids_crc32."""
    tail = np.asarray([END], "<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + tail
                n = len(ids) // 4
                first = n % capacity or min(n, capacity)
                cuts = [0, *range(first, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    for row, value in zip(rows, (doc_id, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])), strict=True):
                        row.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def knapsack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each room its best total value and the length taken first (0: none); values[l] is that of one piece of length l, -inf if there is none."""
    capacity = len(values) - 1
    best, pick = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        found = values[1 : c + 1] + best[c - 1 :: -1] if c > 1 else values[1:2] + best[:1]
        k = int(found.argmax())
        if found[k] > best[c - 1]:
            best[c], pick[c] = found[k], k + 1
        else:
            best[c] = best[c - 1]
    return best, pick


def traced(pick: np.ndarray, room: int) -> dict[int, int]:
    """The pattern that fills `room`: length to how often."""
    pattern: dict[int, int] = {}
    while room > 0:
        size = int(pick[room])
        if size:
            pattern[size] = pattern.get(size, 0) + 1
        room -= size or 1
    return pattern


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, list[int]]]:
    """Best-fit decreasing over the histogram: equal sequences are filled together."""
    rooms: dict[int, list[tuple[int, list[int]]]] = {}
    for size in np.flatnonzero(counts)[::-1].tolist():
        n = int(counts[size])
        if size == 0:
            continue
        room = size
        while n and room < capacity:
            if not rooms.get(room):
                room += 1
                continue
            copies, sizes = rooms[room].pop()
            k = min(n, copies)
            if k < copies:
                rooms[room].append((copies - k, sizes))
            rooms.setdefault(room - size, []).append((k, [*sizes, size]))
            n -= k
            room = size if room - size >= size else room
        each = capacity // size
        for copies, times in ((n // each, each), (1 if n % each else 0, n % each)):
            if copies:
                rooms.setdefault(capacity - times * size, []).append((copies, [size] * times))
    return [group for groups in rooms.values() for group in groups]


@dataclass(frozen=True)
class Plan:
    """Patterns as (copies, lengths); how many sequences they are; a lower bound of any plan's; the value of the fractional cover before rounding."""

    patterns: list[tuple[int, list[int]]]
    sequences: int
    bound: int
    fractional: float
    method: str


def planned(counts: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS, rate: float = RATE) -> Plan:
    """Uses up counts[length] pieces exactly; counts has capacity + 1 entries.

    Multiplicative weights on the lengths' covering constraints: each round prices the pattern of greatest weight by the knapsack
    programme, gives it a share of what it can still cover, and multiplies the weights of its lengths by
    exp(-rate * the share of them that it covered). Weights over the greatest pattern's weight are a feasible dual, so every round
    also bounds the programme from below. The cover is rounded down, best fit fills what is left, and best-fit decreasing of all pieces
    is taken instead where it needs fewer sequences."""
    counts = counts.astype(np.int64).copy()
    full = [(int(counts[capacity]), [capacity])] if counts[capacity] else []
    counts[capacity] = 0
    lengths = np.flatnonzero(counts)
    lengths = lengths[lengths > 0]
    if not len(lengths):
        n = sum(c for c, _ in full)
        return Plan(full, n, n, float(n), "whole pieces")
    n, weight = counts[lengths].astype(float), lengths / capacity
    left, chosen, bound = n.copy(), {}, 0.0
    where = np.full(capacity + 1, -1)
    where[lengths] = np.arange(len(lengths))
    material = float((lengths * n).sum()) / capacity
    for _ in range(rounds):
        whole = np.full(capacity + 1, -np.inf)
        whole[lengths] = weight
        best, pick = knapsack(whole)
        bound = max(bound, float((n * weight).sum()) / best[capacity])
        open_ = left >= 1
        if not open_.all():
            if not open_.any():
                break
            whole[lengths[~open_]] = -np.inf
            best, pick = knapsack(whole)
        pattern = traced(pick, capacity)
        at = where[list(pattern)]
        times = np.array(list(pattern.values()), float)
        copies = min(float((left[at] / times).min()), max(1.0, material / rounds))
        key = tuple(sorted(pattern.items()))
        chosen[key] = chosen.get(key, 0.0) + copies
        left[at] -= times * copies
        weight[at] *= np.exp(-rate * times * copies / n[at])
    fractional = sum(chosen.values()) + float((left * lengths).sum()) / capacity
    rest, out = counts.copy(), []
    for pattern, copies in chosen.items():
        k = int(min([copies + 1e-9] + [rest[size] // times for size, times in pattern]))
        if k:
            out.append((k, [size for size, times in reversed(pattern) for _ in range(times)]))
            for size, times in pattern:
                rest[size] -= times * k
    out += best_fit(rest, capacity)
    other = best_fit(counts, capacity)
    total = lambda plan: sum(c for c, _ in plan)
    patterns, method = (out, "multiplicative weights") if total(out) <= total(other) else (other, "best fit decreasing")
    first = sum(c for c, _ in full)
    return Plan(full + patterns, first + total(patterns), first + math.ceil(bound - 1e-6), first + fractional, method)


class Places:
    """Where the r-th piece of a length goes: arrays sorted by (length, first rank). Bounded by the plan, not by the rows."""

    def __init__(self, patterns: list[tuple[int, list[int]]]):
        used: dict[int, int] = {}
        rows, sequence = [], 0
        for copies, sizes in patterns:
            at = 0
            for size in sizes:
                rows.append((size, used.get(size, 0), sequence, at))
                used[size] = used.get(size, 0) + copies
                at += size
            sequence += copies
        self.rows = np.asarray(sorted(rows), np.int64).reshape(-1, 4)
        self.sequences = sequence

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = self.rows[:, 0] * (1 << 48) + self.rows[:, 1]
        at = np.searchsorted(key, length * (1 << 48) + rank, "right") - 1
        return self.rows[at, 2] + rank - self.rows[at, 1], self.rows[at, 3]


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, salts: int = 64) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = cut(pieces_of(docs, path, capacity), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[row["length"]] = row["n"]
    places = pieces.sparkSession.sparkContext.broadcast(Places(planned(counts, capacity).patterns))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            column = lambda k: batch.column(names.index(k))  # noqa: E731,B023
            sequence, offset = places.value.find(column("length").to_numpy(), column("_rank").to_numpy())
            keep = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*map(column, keep), pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])

    ranked = salted_rank(pieces, ["length"], ["doc_id", "piece"], "_rank", "doc_id", salts)
    return ranked.mapInArrow(run, PIECES + ", sequence_id long, offset long")


def packing_query(docs: DataFrame, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return pack(docs, str(path))
