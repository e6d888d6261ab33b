"""Operator 9: removal of repeated 50-byte strings, by external induced sorting of shards of shared passages.

A string of 50 bytes goes where it also starts in a document of smaller doc_id. Equal texts are settled first. The other texts
are written once, in batches of about a megabyte. Each window of 50 bytes names the least hash among its 32-byte grams (its
minimizer), which depends on the window alone; so only windows whose minimizer occurs in two texts can repeat. Which do is
found from packed lists of minimizers, dealt by hash range; the answer is a bit for each minimizer of a batch. Runs of
windows around a shared minimizer become segments; equal segments are merged, and segments of a minimizer that has
several are dealt into shards by minimizer. Of a shard, what windows cover whose hash is found twice is suffix-sorted by external
induced sorting (induced_sort.py): suffixes that share 50 bytes with their neighbour form groups, and the smallest document of a group owns its string. A minimizer
whose segments would fill a good part of a shard is hot: its windows are grouped one by one over a 128-bit hash instead, so
no shard grows with the number of texts that hold a common line. Batches then drop every byte of windows that an earlier
document owns. Tables are deleted when their last reader is done.

Cases: null and empty texts have no bytes; texts under 50 bytes lose nothing; rows that repeat a doc_id are judged each by
its own text, against smaller doc_ids only; other columns pass by; an empty table gives no rows; texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release, whole_groups
from .induced_sort import IN_MEMORY, sorted_suffixes
from .near_duplicates import mix

LENGTH = 50
GRAM = 32
#: Bytes of text in a batch (a longer text is one for itself), and windows handled at once.
BATCH, BLOCK = 1 << 20, 1 << 16
#: Windows of one segment at most; longer runs of one minimizer, which only periods have, are cut.
LONGEST = 4096
#: Bytes of segments in a shard.
SHARD = 2_000_000
#: Bytes of segments beyond which a minimizer is hot.
HOT = 250_000
#: A window in at least so many segments of hot minimizers, or a HOT_SHARE-th of all their windows, is looked up apart from the others.
HOT_WINDOW, HOT_SHARE = 10_000, 100_000
#: A filter side of at most so many rows is broadcast; a longer one is joined by a shuffle. Likewise bytes of the minimizers' bits.
BROADCAST_ROWS, BROADCAST_BITS = 400_000, 16_000_000
#: Batches whose minimizers fill one bucket (about 100,000 each).
BATCHES_IN_BUCKET = 16
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
LISTS = "batch long, ids array<long>, sizes array<int>, body binary"


def minimizers(text: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """For each window of `length` bytes the least hash among its grams."""
    n = len(text)
    if n < length:
        return np.zeros(0, np.uint64)
    out = np.empty(n - length + 1, np.uint64)
    base, width = 0x9E3779B97F4A7C15, length - gram + 1
    for a in range(0, len(out), BLOCK):
        b = min(len(out), a + BLOCK)
        h = text[a : b + length - 1].astype(np.uint64) + np.uint64(1)
        step = 1
        while step < gram:  # gram is a power of two
            h = h[:-step] * np.uint64(pow(base, step, 1 << 64)) + h[step:]
            step *= 2
        best, span = mix(h), 1
        while span * 2 <= width:
            best = np.minimum(best[:-span], best[span:])
            span *= 2
        if span < width:
            best = np.minimum(best[: span - width], best[width - span :])
        out[a:b] = best
    return out


def once(values: np.ndarray) -> np.ndarray:
    """np.unique, which takes eight times as long over these."""
    values = np.sort(values)
    return values[np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])[: len(values)])]


def runs_of(body: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, windows, document, value) of each run of windows with one minimizer, over texts that stand one after another."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    value = minimizers(body)
    stops = np.maximum(starts, ends - LENGTH + 1)
    at = once(np.concatenate([np.flatnonzero(value[1:] != value[:-1]) + 1, starts, stops]))
    document = np.searchsorted(starts, at, "right") - 1
    windows = np.diff(np.append(at, len(body)))
    ok = at < stops[document]
    at, document, windows = at[ok], document[ok], windows[ok]
    if len(windows) and windows.max() > LONGEST:
        parts = -(-windows // LONGEST)
        within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        at, document, whole = np.repeat(at, parts) + LONGEST * within, np.repeat(document, parts), np.repeat(windows, parts)
        windows = np.minimum(LONGEST, whole - LONGEST * within)
    return at, windows, document, value[at]


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """`df` to be broadcast if it has at most `rows` rows, else as it is."""
    return F.broadcast(df) if df.count() <= (BROADCAST_ROWS if rows is None else rows) else df


def batched(docs: DataFrame) -> DataFrame:
    """Texts of `docs` (doc_id, text) in batches: batch, ids, sizes (bytes), body."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list[int] = []
        bodies: list[bytes] = []
        held = 0

        def whole() -> pa.RecordBatch:
            nonlocal number, held
            sizes = [len(b) for b in bodies]
            out = pa.RecordBatch.from_arrays([pa.array([number]), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())), pa.array([b"".join(bodies)], pa.binary())], ["batch", "ids", "sizes", "body"])
            ids.clear()
            bodies.clear()
            number, held = number + 1, 0
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = text.as_py().encode()
                if ids and (held + len(raw) > BATCH or len(ids) >= 1 << 16):
                    yield whole()
                ids.append(doc_id)
                bodies.append(raw)
                held += len(raw)
        if ids:
            yield whole()

    return docs.select("doc_id", "text").mapInArrow(run, LISTS)


def opened(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, sizes and body of a row of LISTS."""
    of = lambda name: batch.column(batch.schema.get_field_index(name))[row]
    return of("ids").values.to_numpy(), of("sizes").values.to_numpy().astype(np.int64), np.frombuffer(of("body").as_buffer(), np.uint8)


def bucket_of(values: np.ndarray, buckets: int) -> np.ndarray:
    """The range of each of `values`: mixed minimizers, as minimizers themselves are least hashes and crowd in the lowest range."""
    return ((values >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def minimizer_lists(lists: DataFrame, buckets: int) -> DataFrame:
    """(bucket, batch, low, high, several): a batch's distinct minimizers by hash range, 48 bits each, and whether two of its documents have one."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, sizes, body = opened(batch, row)
                _, _, document, value = runs_of(body, sizes)
                if not len(value):
                    continue
                value = mix(value)
                o = np.argsort(value)
                value, document = value[o], document[o]
                first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
                several = np.minimum.reduceat(document, first) != np.maximum.reduceat(document, first)
                value = value[first]
                cuts = np.searchsorted(bucket_of(value, buckets), np.arange(buckets + 1))
                held = np.flatnonzero(np.diff(cuts))
                low, high = value.astype(np.uint32), (value >> np.uint64(32)).astype(np.uint16)
                parts = [[x[cuts[k] : cuts[k + 1]] for k in held] for x in (low, high, several)]
                number = batch.column(0)[row].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(held.astype(np.int32)), pa.array(np.full(len(held), number)), *(pa.array([x.tobytes() for x in p], pa.binary()) for p in parts)], ["bucket", "batch", "low", "high", "several"]
                )

    return lists.mapInArrow(run, "bucket int, batch long, low binary, high binary, several binary")


def bits_of(low: list[np.ndarray], high: list[np.ndarray], several: list[np.ndarray]) -> list[bytes]:
    """For each list of a bucket's values a bit a value: whether it is in two lists, or `several` says that two documents have it."""
    values = np.concatenate(high).astype(np.uint64) << np.uint64(32)
    values |= np.concatenate(low)
    ordered = np.sort(values)
    shared = once(np.concatenate([ordered[1:][ordered[1:] == ordered[:-1]], values[np.concatenate(several)]]))
    del ordered
    flags = np.zeros(len(values), bool)
    if len(shared):
        for a in range(0, len(values), BLOCK):
            part = values[a : a + BLOCK]
            flags[a : a + BLOCK] = shared[np.minimum(np.searchsorted(shared, part), len(shared) - 1)] == part
    ends = np.cumsum([len(x) for x in low])
    return [np.packbits(x).tobytes() for x in np.split(flags, ends[:-1])]


def shared_bits(found: DataFrame, buckets: int) -> DataFrame:
    """(batch, bucket, bits): for each of a batch's minimizers in the bucket, whether another document has it too."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, "bucket"):
            keys = group.column("bucket").to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                part = group.slice(lo, hi - lo)
                bits = bits_of(*([np.frombuffer(x.as_buffer(), kind) for x in part.column(name)] for name, kind in (("low", np.uint32), ("high", np.uint16), ("several", bool))))
                yield pa.RecordBatch.from_arrays([part.column("batch").combine_chunks(), part.column("bucket").combine_chunks(), pa.array(bits, pa.binary())], ["batch", "bucket", "bits"])

    return found.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "batch long, bucket int, bits binary")


def segments_of(lists: DataFrame, buckets: int) -> DataFrame:
    """From LISTS with `known` (bucket, bits): one row for each distinct segment of a batch.

    batch, value, id1, id2 (hash of the bytes), lo, hi (least and greatest doc_id), windows, firsts (where it starts)."""
    names = ["batch", "value", "id1", "id2", "lo", "hi", "windows", "firsts"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, sizes, body = opened(batch, row)
                at, windows, document, value = runs_of(body, sizes)
                distinct, of = np.unique(mix(value), return_inverse=True)
                counts = np.bincount(bucket_of(distinct, buckets), minlength=buckets)
                known = batch.column(batch.schema.get_field_index("known"))[row].as_py()
                shared = np.concatenate([np.unpackbits(np.frombuffer(k["bits"], np.uint8), count=counts[k["bucket"]]) for k in sorted(known, key=lambda k: k["bucket"])]).astype(bool)
                keep = shared[of]
                at, windows, value, doc = at[keep], windows[keep], value[keep], ids[document[keep]]
                if not len(at):
                    continue
                raw = body.tobytes()
                pieces = [raw[a:b] for a, b in zip(at.tolist(), (at + windows + LENGTH - 1).tolist(), strict=True)]
                blake = hashlib.blake2b
                both = np.frombuffer(b"".join([blake(p, digest_size=16).digest() for p in pieces]), np.int64).reshape(-1, 2)
                o = np.argsort(both[:, 0])
                s = both[o]
                if ((s[1:, 0] == s[:-1, 0]) & (s[1:, 1] != s[:-1, 1])).any():
                    o = np.lexsort((both[:, 1], both[:, 0]))
                    s = both[o]
                head = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]).any(1)]))
                of_head = o[head]
                lo, hi = np.minimum.reduceat(doc[o], head), np.maximum.reduceat(doc[o], head)
                firsts = pa.ListArray.from_arrays(pa.array(np.append(head, len(o)).astype(np.int32)), pa.array(at[o].astype(np.int32)))
                columns = [np.full(len(head), batch.column(0)[row].as_py()), value[of_head].view(np.int64), s[head, 0], s[head, 1], lo, hi, windows[of_head].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), firsts], names)

    return lists.mapInArrow(run, "batch long, value long, id1 long, id2 long, lo long, hi long, windows int, firsts array<int>")


def bytes_of(lists: DataFrame) -> DataFrame:
    """From LISTS with `wanted` (first, windows, value, id1, id2, doc, hot): value, id1, id2, doc, hot and bytes of each."""
    names = ["value", "id1", "id2", "doc", "hot"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                raw = batch.column(batch.schema.get_field_index("body"))[row].as_py()
                rows = batch.column(batch.schema.get_field_index("wanted"))[row].values
                first = rows.field(0).to_numpy().astype(np.int64)
                stop = first + rows.field(1).to_numpy() + LENGTH - 1
                pieces = pa.array([raw[a:b] for a, b in zip(first.tolist(), stop.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(rows.field(k) for k in range(2, 7)), pieces], [*names, "bytes"])

    return lists.mapInArrow(run, "value long, id1 long, id2 long, doc long, hot boolean, bytes binary")


def owners(segments_: list[bytes], documents: np.ndarray, budget: int = IN_MEMORY) -> list[np.ndarray]:
    """Per segment, for each of its windows the smallest document in which its string starts."""
    sizes = np.array([len(s) for s in segments_])
    # UTF-8 has no byte above 0xF4, so one more fits; 0 ends a segment.
    text = np.frombuffer(b"\0".join(segments_) + b"\0", np.uint8) + np.uint8(1)
    ends = np.cumsum(sizes + 1)
    text[ends - 1] = 0
    owner = np.zeros(len(text), np.int64)
    with sorted_suffixes(text, LENGTH, budget) as (sa, lcp, _):
        a = 0
        while a < len(sa):
            b = min(len(sa), a + budget)
            while b < len(sa) and lcp[b] >= LENGTH:  # a group is not cut
                more = np.flatnonzero(lcp[b : b + budget] < LENGTH)
                b = b + int(more[0]) if len(more) else min(len(sa), b + budget)
            pos = sa[a:b].astype(np.int64)
            which = np.searchsorted(ends, pos, "right")
            group = np.cumsum(lcp[a:b] < LENGTH)
            ok = pos + LENGTH <= ends[which] - 1
            pos, which, group = pos[ok], which[ok], group[ok]
            if len(pos):
                head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
                owner[pos] = np.repeat(np.minimum.reduceat(documents[which], head), np.diff(np.append(head, len(pos))))
            a = b
    starts = ends - sizes - 1
    return [owner[a : a + n - LENGTH + 1] for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]


def window_hashes(text: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """A 64-bit hash of each window of `length` bytes; equal windows have equal ones."""
    base, out, done = 0x9E3779B97F4A7C15, None, 0
    h, step = text.astype(np.uint64) + np.uint64(1), 1
    while True:  # length in binary, from the lowest bit; each h is over `step` bytes
        if length & step:
            out = h if out is None else h[: len(h) - done] * np.uint64(pow(base, done, 1 << 64)) + out[step:]
            done += step
        if step * 2 > length:
            return mix(out)
        h, step = h[:-step] * np.uint64(pow(base, step, 1 << 64)) + h[step:], step * 2


def shared_owners(segments_: list[bytes], documents: np.ndarray, budget: int = IN_MEMORY) -> list[np.ndarray]:
    """What `owners` gives. Windows whose hash is found once have no other owner; only what the others cover is sorted."""
    sizes = np.array([len(s) for s in segments_])
    windows = sizes - LENGTH + 1
    starts = np.cumsum(sizes) - sizes
    hashes = window_hashes(np.frombuffer(b"".join(segments_), np.uint8))
    of = np.repeat(np.arange(len(sizes)), windows)
    at = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows) + starts[of]
    hashes = hashes[at]
    ordered = np.sort(hashes)
    twice = once(ordered[1:][ordered[1:] == ordered[:-1]])
    found = np.zeros(len(of), bool)
    if len(twice):
        found = twice[np.minimum(np.searchsorted(twice, hashes), len(twice) - 1)] == hashes
    owner = documents[of]
    first = np.flatnonzero(found & ~(np.append(False, found[:-1]) & np.append(False, of[1:] == of[:-1])))
    if len(first):
        stop = np.flatnonzero(found & ~(np.append(found[1:], False) & np.append(of[1:] == of[:-1], False))) + 1
        pieces = [segments_[k][a:b] for k, a, b in zip(of[first].tolist(), (at[first] - starts[of[first]]).tolist(), (at[stop - 1] - starts[of[first]] + LENGTH).tolist(), strict=True)]
        owner[found] = np.concatenate(owners(pieces, documents[of[first]], budget))
    return np.split(owner, np.cumsum(windows)[:-1])


def shard_owners(distinct: DataFrame) -> DataFrame:
    """From distinct segments (value, id1, id2, doc, bytes): (id1, id2, owner array) where a window has another owner than doc; shards of about SHARD bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        last = None

        def solve() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            doc = whole.column("doc").to_numpy()
            found = shared_owners([x.as_py() for x in whole.column("bytes")], doc)
            keep = np.array([k for k, f in enumerate(found) if (f < doc[k]).any()], np.int64)
            flat = np.concatenate([found[k] for k in keep]) if len(keep) else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(found[k]) for k in keep])]).astype(np.int32)), pa.array(flat))
            return pa.RecordBatch.from_arrays([pa.array(whole.column(c).to_numpy()[keep]) for c in ("id1", "id2")] + [lists], ["id1", "id2", "owner"])

        # Rows come sorted by minimizer: a shard may end between two minimizers once it is full.
        for batch in batches:
            values = batch.column(0).to_numpy()
            a = 0
            while a < len(values):
                if size >= SHARD and values[a] != last:
                    yield solve()
                    held.clear()
                    size = 0
                b = a + int(np.searchsorted(values[a:], values[a], "right")) if size >= SHARD else min(len(values), a + 2000)
                b = max(b, a + 1)
                held.append(batch.slice(a, b - a))
                size += held[-1].column(4).nbytes
                last = values[b - 1]
                a = b
        if held:
            yield solve()

    return distinct.select("value", "id1", "id2", "doc", "bytes").mapInArrow(run, "id1 long, id2 long, owner array<long>")


def emit_windows(hot: DataFrame) -> DataFrame:
    """From (id1, id2, doc, bytes): one row (id1, id2, k, w1, w2, doc) for each window k of a segment, w1 and w2 its hash."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                pieces = part.column(3).to_pylist()
                counts = np.array([len(s) - LENGTH + 1 for s in pieces])
                hashes = b"".join(hashlib.blake2b(s[k : k + LENGTH], digest_size=16).digest() for s in pieces for k in range(len(s) - LENGTH + 1))
                w = np.frombuffer(hashes, np.int64).reshape(-1, 2)
                of = np.repeat(np.arange(len(pieces)), counts)
                k = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
                ids = [part.column(i).to_numpy()[of] for i in range(3)]
                columns = [ids[0], ids[1], k.astype(np.int32), w[:, 0], w[:, 1], ids[2]]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["id1", "id2", "k", "w1", "w2", "doc"])

    return hot.select("id1", "id2", "doc", "bytes").mapInArrow(run, "id1 long, id2 long, k int, w1 long, w2 long, doc long")


def hot_owners(hot: DataFrame) -> DataFrame:
    """What `shard_owners` gives, for segments of hot minimizers, by grouping windows over their hash; no group is held in one task."""
    windows = cut(emit_windows(hot), "hot-windows")
    least = windows.groupBy("w1", "w2").agg(F.min("doc").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    least = cut(least, "hot-least")
    # So many rows of one window don't go to one task: such windows are few, at most HOT_SHARE.
    limit = max(HOT_WINDOW, windows.count() // HOT_SHARE)
    common = least.where(F.col("n") >= limit).select("w1", "w2", F.col("least").alias("top"))
    found = windows.join(F.broadcast(common), ["w1", "w2"], "left")
    settled = found.where(F.col("top").isNotNull()).select("id1", "id2", "k", F.col("top").alias("owner"))
    rest = found.where(F.col("top").isNull()).join(least.where(F.col("n") < limit).select("w1", "w2", "least"), ["w1", "w2"], "left")
    every = settled.unionByName(rest.select("id1", "id2", "k", F.coalesce("least", "doc").alias("owner")))
    owner = F.transform(F.array_sort(F.collect_list(F.struct("k", "owner"))), lambda x: x["owner"])
    out = cut(every.groupBy("id1", "id2").agg(owner.alias("owner")), "hot-owners")
    release(windows, least)
    return out


def removed(lists: DataFrame) -> DataFrame:
    """From LISTS with `gone` (rows windows, firsts, doc, owner; or null): doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, sizes, body = opened(batch, row)
                ends = np.cumsum(sizes)
                starts = ends - sizes
                delta = np.zeros(len(body) + 1, np.int64)
                gone = batch.column(batch.schema.get_field_index("gone"))[row]
                if gone.is_valid:
                    rows = gone.values
                    windows, firsts, doc, owner = (rows.field(k) for k in range(4))
                    windows, doc = windows.to_numpy().astype(np.int64), doc.to_numpy()
                    # An owner for each window of each row; where none is listed, it is doc.
                    of = np.repeat(np.arange(len(windows)), windows)
                    who = doc[of]
                    listed = owner.is_valid().to_numpy(zero_copy_only=False)
                    who[listed[of]] = owner.flatten().to_numpy()
                    k = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
                    at = firsts.flatten().to_numpy().astype(np.int64)
                    many = np.diff(firsts.offsets.to_numpy())
                    # Each place of a row takes all windows of the row.
                    row_of = np.repeat(np.arange(len(windows)), many)
                    size = windows[row_of]
                    base = np.cumsum(windows) - windows
                    pick = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                    entry = np.repeat(base[row_of], size) + pick
                    start = np.repeat(at, size) + k[entry]
                    mine = ids[np.searchsorted(starts, np.repeat(at, size), "right") - 1]
                    start = start[who[entry] < mine]
                    delta = np.bincount(start, minlength=len(delta)) - np.bincount(start + LENGTH, minlength=len(delta))
                mask = np.cumsum(delta[:-1]) > 0
                total = np.concatenate([[0], np.cumsum(mask)])
                n_removed = total[ends] - total[starts]
                rise = mask.copy()
                rise[1:] &= ~mask[:-1]
                full = np.flatnonzero(sizes > 0)
                rise[starts[full]] = mask[starts[full]]
                rises = np.concatenate([[0], np.cumsum(rise)])
                raw = memoryview(body)
                sha = [hashlib.sha256(raw[a:b] if not n else body[a:b][~mask[a:b]].tobytes()).hexdigest() for a, b, n in zip(starts.tolist(), ends.tolist(), n_removed.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(sizes), pa.array(n_removed), pa.array(rises[ends] - rises[starts]), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return lists.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def removal(docs: DataFrame) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), "text").alias("h2"))
    copies = docs.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("top")).where("rep < top")
    copies = small(cut(copies.select(F.col("h1").alias("c1"), F.col("h2").alias("c2"), "rep"), "copies"))
    copied = (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")) & (F.col("doc_id") > F.col("rep"))
    lists = cut(batched(docs.join(copies, copied, "left_anti")), "batches", "zstd")

    buckets = max(1, lists.count() // BATCHES_IN_BUCKET)
    bits = cut(shared_bits(minimizer_lists(lists, buckets), buckets), "bits")
    known = bits.groupBy(F.col("batch").alias("_batch")).agg(F.collect_list(F.struct("bucket", "bits")).alias("known"))
    if int(bits.agg(F.sum(F.length("bits"))).first()[0] or 0) <= BROADCAST_BITS:
        known = F.broadcast(known)
    segments = cut(segments_of(lists.join(known, F.col("batch") == F.col("_batch")).drop("_batch"), buckets), "segments", "zstd")
    release(bits)

    # One batch carries the bytes of a segment for all others; both columns of it are of one row, whichever comes first.
    carrier = [F.first("batch").alias("carrier"), F.first(F.get("firsts", F.lit(0))).alias("first")]
    distinct = segments.groupBy("value", "id1", "id2").agg(F.min("lo").alias("doc"), F.max("hi").alias("last"), *carrier, F.first("windows").alias("windows"))
    distinct = cut(distinct, "distinct", "zstd")
    several = cut(distinct.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("windows") + LENGTH - 1).alias("size")).where("n > 1").select("value", "size"), "several")
    # Shuffle files of the last query were seen to stay until another had run; so one comes before the release, here and below.
    size = int(several.where(F.col("size") <= HOT).agg(F.sum("size")).first()[0] or 0)
    release()
    one = F.struct("first", "windows", "value", "id1", "id2", "doc", (F.col("size") > HOT).alias("hot"))
    wanted = distinct.join(small(several), "value").groupBy(F.col("carrier").alias("_batch")).agg(F.collect_list(one).alias("wanted"))
    carried = cut(bytes_of(lists.join(wanted, F.col("batch") == F.col("_batch")).select("body", "wanted")), "carried", "zstd")
    hot = carried.where("hot")
    none_hot = hot.isEmpty()
    release(several)
    parts = max(12, size // SHARD + 1)
    owner = cut(shard_owners(carried.where(~F.col("hot")).repartition(parts, "value").sortWithinPartitions("value")), "owners")
    release()
    every = owner if none_hot else owner.unionByName(hot_owners(hot))
    # Without a listed owner, a segment's windows belong to its least document.
    table = distinct.select("id1", "id2", "doc", "last").join(every, ["id1", "id2"], "left").where(F.col("owner").isNotNull() | (F.col("doc") < F.col("last")))
    table = cut(table, "table", "zstd")
    release(distinct, carried, owner)
    places = segments.select("batch", "id1", "id2", "windows", "firsts", "hi").join(table, ["id1", "id2"]).where(F.col("owner").isNotNull() | (F.col("doc") < F.col("hi")))
    gone = cut(places.groupBy(F.col("batch").alias("_batch")).agg(F.collect_list(F.struct("windows", "firsts", "doc", "owner")).alias("gone")), "gone")
    release(segments, table)

    own = removed(lists.join(gone, F.col("batch") == F.col("_batch"), "left").select("batch", "ids", "sizes", "body", "gone"))
    n = F.octet_length("text").cast("long")
    wiped = n >= LENGTH
    rest = docs.join(copies, copied).select("doc_id", n.alias("n_bytes"), F.when(wiped, n).otherwise(0).alias("n_removed"), F.when(wiped, 1).otherwise(0).cast("long").alias("n_spans"), F.when(wiped, F.lit(EMPTY_SHA)).otherwise(F.sha2("text", 256)).alias("kept_sha256"))
    return own.unionByName(rest)
