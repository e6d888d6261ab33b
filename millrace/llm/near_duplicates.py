"""Operator 3: near-duplicates by ProbMinHash, banding and exact verification.

A document is the weighted set of its runs of five words, the weight growing with how often the run occurs. Each element
sends arrivals of a Poisson process of its weight's rate to random registers; a register keeps the earliest. An
element stops as soon as its next arrival is later than all registers hold, so a document of n runs costs about n arrivals
plus what fills the registers. Two documents agree in a register with their probability Jaccard similarity.

Registers are banded, those of weighted runs and, where a run repeats, those of runs of weight one as well, under the same keys;
so any two documents meet at least as often as their plain similarity lets them. Documents that share a band are candidates; a candidate pair is a link if the
plain Jaccard similarity of the two sets of runs is at least the threshold, computed from the sets themselves. Classes are the
connected components of links. Equal texts are one document throughout. Within a bucket no all-pairs list is made:
everyone is compared with one head, then what isn't in the head's class with a second head, and only pairs of
different classes that remain are compared one by one, so no link that a bucket shows is lost.

Cases: null, empty and blank texts have no runs and link to nothing but texts equal to them (null counts as empty);
texts of fewer than five words are one run; ties go to the smallest doc_id; repeated rows get their document's class;
other columns pass by; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, let, shingles_of, words_of
from .components import components

SIZE = 5
THRESHOLD_TENTHS = 8
#: 24 bands of 5: a pair whose plain similarity is 0.8 is missed with a chance of 7e-5.
BANDS, ROWS = 24, 5
#: Elements that one vectorised step works on.
AT_ONCE = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signatures(elements: np.ndarray, weights: np.ndarray, document: np.ndarray, documents: int, registers: int) -> np.ndarray:
    """(documents, registers): the element that comes first to each register; documents without elements get zeros."""
    earliest = np.full(documents * registers, np.inf)
    winner = np.zeros(documents * registers, np.uint64)
    e, w, d = elements.astype(np.uint64), weights.astype(float), document.astype(np.int64)
    counts = np.bincount(d, minlength=documents)
    alone = counts[d] == 1  # its one element wins everywhere
    if alone.any():
        winner.reshape(documents, registers)[d[alone]] = e[alone][:, None]
        e, w, d = e[~alone], w[~alone], d[~alone]
    when = np.zeros(len(e))
    latest = np.full(documents, np.inf)
    step = 0
    while len(e):
        step += 1
        h = mix(e + np.uint64(step * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        when = when - np.log(((h >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / w
        alive = when < latest[d]
        if not alive.all():
            e, w, d, when, h = e[alive], w[alive], d[alive], when[alive], h[alive]
        if not len(e):
            break
        at = d * registers + (mix(h) % np.uint64(registers)).astype(np.int64)
        before = earliest[at]
        np.minimum.at(earliest, at, when)
        won = (earliest[at] == when) & (when < before)
        winner[at[won]] = e[won]
        touched = np.unique(d)
        latest[touched] = earliest.reshape(documents, registers)[touched].max(1)
    return winner.reshape(documents, registers)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(documents, bands): one 64-bit key for each band of `rows` registers."""
    key = np.broadcast_to(mix(np.arange(1, bands + 1)), (len(signature), bands)).copy()
    for r in range(rows):
        key = mix(key * np.uint64(3) + signature[:, r : bands * rows : rows])
    return key.view(np.int64)


def sketched(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, h1, h2 (hash of the text), n (distinct runs), keys (one for each band and set of weights; none without runs)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    runs = docs.select("doc_id", F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2"), shingles_of(words_of(F.col("text")), SIZE).alias("runs"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            ends = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False)
            sizes = np.zeros(batch.num_rows, np.int64)
            keys: list[np.ndarray] = []
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(ends, ends[a] + AT_ONCE, "right")) - 1)
                b = min(b, batch.num_rows)
                found = [np.unique(values[ends[k] : ends[k + 1]], return_counts=True) for k in range(a, b)]
                sizes[a:b] = [len(v) for v, _ in found]
                elements = np.concatenate([v for v, _ in found]).view(np.uint64)
                counts = np.concatenate([c for _, c in found])
                document = np.repeat(np.arange(b - a), sizes[a:b])
                found_keys = list(band_keys(signatures(elements, 1 + np.log(counts), document, b - a, bands * rows), bands, rows))
                # Where no run repeats, the two sets of keys are the same.
                repeats = np.zeros(b - a, bool)
                repeats[document[counts > 1]] = True
                of = repeats[document]
                plain = band_keys(signatures(elements[of], np.ones(int(of.sum())), (np.cumsum(repeats) - 1)[document[of]], int(repeats.sum()), bands * rows), bands, rows)
                for k, more in zip(np.flatnonzero(repeats), plain, strict=True):
                    found_keys[k] = np.unique(np.concatenate([found_keys[k], more]))
                keys += [x if n else x[:0] for x, n in zip(found_keys, sizes[a:b], strict=True)]
                a = b
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "h1", "h2", "n", "keys"])

    return runs.mapInArrow(run, "doc_id long, h1 long, h2 long, n long, keys array<long>")


def verified(pairs: DataFrame, sets: DataFrame, tenths: int) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of at least tenths / 10."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("runs").alias("_ra"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("runs").alias("_rb"))
    joined = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("_ra", "_rb"))
    return joined.where(let(common, lambda c: 10 * c >= tenths * (F.size("_ra") + F.size("_rb") - c))).select("a", "b")


def classes(docs: DataFrame, tenths: int = THRESHOLD_TENTHS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, class_id) for every row of `docs` (doc_id, text); a class is named by its smallest doc_id."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = cut(sketched(docs, bands, rows), "sketches")
    copies = cut(sketch.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies"), "copies")
    owner = cut(sketch.select("doc_id", "h1", "h2").join(copies, ["h1", "h2"]).select("doc_id", "rep").where(F.col("doc_id") != F.col("rep")), "owners")
    # A representative may itself stand in several rows.
    entries = sketch.join(owner.select("doc_id"), "doc_id", "left_anti").select(F.col("doc_id").alias("doc"), "n", F.explode("keys").alias("key")).distinct()
    entries = cut(entries, "entries")
    buckets = cut(entries.groupBy("key").agg(F.min(F.struct("doc", "n")).alias("head"), F.count(F.lit(1)).alias("members")).where("members > 1").select("key", "head"), "buckets")
    shared = cut(entries.join(buckets, "key").select("key", "doc", "n", "head"), "shared")

    # Sizes alone rule a pair out if one set has less than tenths / 10 of the other's elements.
    alike = lambda x, y: 10 * F.least(x, y) >= tenths * F.greatest(x, y)
    pair = lambda x, y: [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]
    wanted = cut(shared.select("doc").distinct(), "wanted")
    sets = docs.join(wanted, docs.doc_id == wanted.doc, "left_semi").dropDuplicates(["doc_id"]).select("doc_id", F.array_distinct(shingles_of(words_of(F.col("text")), SIZE)).alias("runs"))
    sets = cut(sets, "sets")

    stars = shared.where((F.col("doc") != F.col("head.doc")) & alike(F.col("n"), F.col("head.n"))).select(*pair(F.col("doc"), F.col("head.doc"))).distinct()
    checked = cut(stars, "pairs")
    links = cut(verified(checked, sets, tenths), "links")
    roots = components(links)
    for last in (False, True):
        # Members of each bucket under the class found so far; buckets within one class are done.
        members = cut(shared.select("key", "doc", "n").join(roots, F.col("doc") == F.col("node"), "left").select("key", "doc", "n", F.coalesce("root", "doc").alias("root")), "members")
        spread = members.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key", "lo")
        left = cut(members.join(cut(spread, "spread"), "key"), "open")
        if last:
            other = left.select("key", F.col("doc").alias("doc2"), F.col("n").alias("n2"), F.col("root").alias("root2"))
            more = left.join(other, "key").where((F.col("doc") < F.col("doc2")) & (F.col("root") != F.col("root2")) & alike(F.col("n"), F.col("n2")))
            more = more.select(*pair(F.col("doc"), F.col("doc2")))
        else:
            second = cut(left.where(F.col("root") != F.col("lo")).groupBy("key").agg(F.min(F.struct("doc", "n", "root")).alias("head")), "seconds")
            more = left.join(second, "key").where((F.col("root") != F.col("head.root")) & alike(F.col("n"), F.col("head.n"))).select(*pair(F.col("doc"), F.col("head.doc")))
        more = cut(more.distinct().join(checked, ["a", "b"], "left_anti"), "pairs")
        if more.isEmpty():
            continue
        new = cut(verified(more, sets, tenths), "links")
        checked = cut(checked.unionByName(more), "pairs")
        if not new.isEmpty():
            links = cut(links.unionByName(new), "links")
            roots = components(links)
    known = owner.join(roots, F.col("rep") == F.col("node"), "left").select("doc_id", F.coalesce("root", "rep").alias("class_id")).distinct()
    known = cut(known.unionByName(roots.where(F.col("node") != F.col("root")).select(F.col("node").alias("doc_id"), F.col("root").alias("class_id"))), "classes")
    out = sketch.select("doc_id").join(known, "doc_id", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def near_duplicates_query(docs: DataFrame) -> DataFrame:
    return classes(docs)


def keep_one(docs: DataFrame) -> DataFrame:
    """`docs` with one row for each class: that of the smallest doc_id.

    A doc_id with several rows: rows of one text are one document; rows with different texts are told apart, so each goes only with its own class."""
    ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    if ids.where("n > 1").isEmpty():
        gone = cut(classes(docs), "classes").where(F.col("doc_id") != F.col("class_id")).select(F.col("doc_id").alias("_gone"))
        return docs.join(gone, docs["doc_id"] == F.col("_gone"), "left_anti")
    # Rows are numbered in the order of doc_id, so that the first of a class has its smallest doc_id.
    number = "_row_" + "_".join(docs.columns)
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = cut(docs.select(F.col("doc_id").alias("d"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2")).distinct(), "keys")
    ranked = keys.repartitionByRange("d", "h1", "h2").sortWithinPartitions("d", "h1", "h2").withColumn("place", F.monotonically_increasing_id())
    ranked = cut(ranked, "numbers")
    once = docs.dropDuplicates(["doc_id", "text"])
    text = F.coalesce(once["text"], F.lit(""))
    on = once["doc_id"].eqNullSafe(ranked["d"]) & (F.xxhash64(text) == ranked["h1"]) & (F.xxhash64(F.lit("second"), text) == ranked["h2"])
    numbered = cut(once.join(ranked, on).select(*[once[c] for c in docs.columns], ranked["place"].alias(number)), "numbered")
    gone = cut(classes(numbered.select(F.col(number).alias("doc_id"), "text")), "classes").where(F.col("doc_id") != F.col("class_id")).select(F.col("doc_id").alias("_gone"))
    left = numbered.join(gone, F.col(number) == F.col("_gone"), "left_anti")
    return left.dropDuplicates([number]).select(docs.columns)  # null and empty texts are one
