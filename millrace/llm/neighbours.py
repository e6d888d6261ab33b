"""Operator 6: approximate nearest neighbours by NN-descent and greedy graph search.

Equal vectors become one node. Some random-hyperplane tables give every node first neighbours; then iterative joins bring
the neighbours of a node (its own and the nearest of those that name it) together, compare them with one another, and keep each
node's best, until few edges change; only pairs that may be new and may enter a list leave a meeting. Queries walk the graph from their own node and some random ones: each round expands the
best unexpanded nodes of a query's pool, scores what they lead to, and keeps the best. The walk ends when
the whole pool is expanded. The pool's head is scored again with the original vectors in double precision.

The graph and the walk use single precision, scaled by the greatest component; only the final scores decide the order. Vectors of different
lengths have no distance: each length is searched by itself. Cases: vectors that are null, empty, zero, or with null or non-finite
components take no part, neither as query nor as candidate; ties go to the smaller id; repeated vectors are one node
with many ids, of which the k + 1 smallest can be among the nearest; other columns pass by; with fewer than k candidates
all that the graph leads to are returned; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, release, whole_groups
from .near_duplicates import mix

K_GRAPH, K_REVERSE, KEPT = 24, 24, 16
TABLES, BLOCK = 8, 512
#: Descents at most, and the share of changed edges that ends them.
DESCENTS, SETTLED = 6, 0.05
POOL, EXPANDED, ENTRIES, ROUNDS = 300, 75, 32, 40
RERANKED = 40
#: Pairs of a query and a node up to so many are broadcast (16 bytes each), by a bound that is known beforehand; more are joined by a shuffle.
BROADCAST_PAIRS = 2_000_000
#: Bytes of query vectors that are sent to all executors at once; more queries walk in turns.
QUERY_BYTES = 32_000_000
#: Nodes whose vectors are one row, and queries whose state is one.
NODES_IN_BUCKET, QUERIES_IN_PART = 2048, 16
SEED = 11
NODE = "node long, v binary"


def usable(vectors: DataFrame, id_: str, vector: str) -> DataFrame:
    """vec_id, x (array of double), of the vectors that take part."""
    x = F.col(vector).cast("array<double>")
    return vectors.select(F.col(id_).cast("long").alias("vec_id"), x.alias("x")).where(
        F.col("x").isNotNull() & (F.size("x") > 0) & ~F.exists("x", lambda a: a.isNull() | F.isnan(a) | (F.abs(a) == float("inf"))) & F.exists("x", lambda a: a != 0)
    )


def to_single(nodes: DataFrame, scale: float) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in (x / scale).astype("<f4")], pa.binary())], ["node", "v"])

    return nodes.select("node", "x").mapInArrow(run, NODE)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), "<f4").reshape(len(values), -1) if values else np.zeros((0, 1), np.float32)


def best_of(block: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a block (n, d): the k nearest others and minus their squared distances."""
    norms = (block**2).sum(1)
    s = 2 * block @ block.T - norms[:, None] - norms[None]
    np.fill_diagonal(s, -np.inf)
    k = min(k, len(block) - 1)
    top = np.argpartition(-s, k - 1, 1)[:, :k] if k < len(block) - 1 else np.argsort(-s, 1)[:, :k]
    return top, np.take_along_axis(s, top, 1)


EDGE = "a long, b long, s float"


def edges_of(a: list[np.ndarray], b: list[np.ndarray], s: list[np.ndarray]) -> pa.RecordBatch:
    cat = lambda x, t: pa.array(np.concatenate(x) if x else np.zeros(0), t)
    return pa.RecordBatch.from_arrays([cat(a, pa.int64()), cat(b, pa.int64()), cat(s, pa.float32())], ["a", "b", "s"])


def first_edges(nodes: DataFrame, n: int, k: int, tables: int, block: int, seed: int) -> DataFrame:
    """Each node's k nearest among those on the same side of some random hyperplanes, for several sets of hyperplanes."""
    bits = max(0, math.ceil(math.log2(max(1, n / block))))

    def codes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1))
            for t in range(tables):
                planes = np.random.default_rng(seed + t).normal(size=(x.shape[1], bits)).astype(np.float32)
                code = ((x @ planes > 0) * (1 << np.arange(bits))).sum(1) + (t << 40) if bits else np.full(len(x), t << 40)
                yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), batch.column(0), batch.column(1)], ["code", "node", "v"])

    coded = cut(nodes.mapInArrow(codes, "code long, " + NODE), "codes")
    # A side with many nodes is dealt into blocks, so no block is large.
    sizes = coded.groupBy("code").agg(F.ceil(F.count(F.lit(1)) / (4 * block)).cast("int").alias("parts"))
    dealt = coded.join(sizes, "code").withColumn("code", F.xxhash64("code", F.pmod(F.xxhash64(F.lit(seed), "node"), F.col("parts")))).drop("parts")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, "code"):
            code, ids = group.column("code").to_numpy(), group.column("node").to_numpy()
            x = matrix(group.column("v"))
            cuts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1], [True]]))
            a, b, s = [], [], []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi - lo > 1:
                    top, score = best_of(x[lo:hi], k)
                    a.append(np.repeat(ids[lo:hi], top.shape[1]))
                    b.append(ids[lo:hi][top].ravel())
                    s.append(score.ravel())
            if a:
                yield edges_of(a, b, s)

    return dealt.repartition("code").sortWithinPartitions("code").mapInArrow(compare, EDGE)


def best_edges(edges: DataFrame, k: int, by: str) -> DataFrame:
    """From (a, b, s, fresh): the k nearest edges of each node of column `by`; of an edge's rows the one that is not fresh stays."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, by):
            a, b, s, fresh = (group.column(c).to_numpy() for c in ("a", "b", "s", "fresh"))
            o = np.lexsort((fresh, b, a))
            o = o[np.concatenate([[True], (np.diff(a[o]) != 0) | (np.diff(b[o]) != 0)])]
            key, other = (a, b) if by == "a" else (b, a)
            o = o[np.lexsort((other[o], -s[o], key[o]))]
            head = np.concatenate([[True], np.diff(key[o]) != 0])
            rank = np.arange(len(o)) - np.maximum.accumulate(np.where(head, np.arange(len(o)), 0))
            o = o[rank < k]
            yield pa.RecordBatch.from_arrays([pa.array(x[o]) for x in (a, b, s, fresh)], ["a", "b", "s", "fresh"])

    return edges.select("a", "b", "s", "fresh").repartition(by).sortWithinPartitions(by).mapInArrow(run, EDGE + ", fresh boolean")


def thinned(edges: DataFrame, k: int, by: str, salts: int = 32) -> DataFrame:
    """`best_edges` in two steps, so that a node which a large share of all nodes name fills no task."""
    other = "a" if by == "b" else "b"
    rank = F.row_number().over(W.partitionBy(by, F.pmod(F.xxhash64(other), F.lit(salts))).orderBy(F.col("s").desc(), other))
    return best_edges(edges.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r"), k, by)


def met_edges(at: np.ndarray, ids: np.ndarray, x: np.ndarray, fresh: np.ndarray, bound: np.ndarray, kept: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, s): of the nodes that meet at each of `at`, the `kept` nearest of each that it may not know yet.

    Two that both stood there before have been compared; an edge that is not above a node's `bound` could not enter its list."""
    o = np.lexsort((~fresh, ids, at))  # a neighbour may also name the node; the fresh row stays
    o = o[np.concatenate([[True], (np.diff(at[o]) != 0) | (np.diff(ids[o]) != 0)])]
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(at[o]) != 0, [True]]))
    sizes, found = np.diff(cuts), []
    for m in np.unique(sizes[sizes > 1]).tolist():
        groups = o[cuts[:-1][sizes == m][:, None] + np.arange(m)]
        for lo in range(0, len(groups), max(1, (1 << 19) // (m * m))):
            g = groups[lo : lo + max(1, (1 << 19) // (m * m))]
            block, f = x[g], fresh[g]
            norms = (block**2).sum(2)
            s = 2 * block @ block.transpose(0, 2, 1) - norms[:, :, None] - norms[:, None]
            ok = (s > bound[g][:, :, None]) & (f[:, :, None] | f[:, None])
            ok[:, np.arange(m), np.arange(m)] = False
            row, many = ok.reshape(-1, m), s.reshape(-1, m)
            over = np.flatnonzero(row.sum(1) > kept)
            if len(over):
                some = np.where(row[over], many[over], -np.inf)
                top = np.argpartition(-some, kept - 1, 1)[:, :kept]
                row[over] = False
                row[over[:, None], top] = True
            i, j = np.nonzero(row)
            found.append((ids[g].ravel()[i], ids[g][i // m, j], many[i, j]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))


def descend(nodes: DataFrame, edges: DataFrame, k: int, reverse: int, kept: int) -> DataFrame:
    """One round, from edges (a, b, s, fresh): neighbours of a node meet there, and each takes along the `kept` nearest it may not know."""
    named = thinned(edges, reverse, "b").select(F.col("b").alias("at"), F.col("a").alias("node"), "fresh")
    full = edges.groupBy(F.col("a").alias("node")).agg(F.when(F.count(F.lit(1)) >= k, F.min("s")).otherwise(float("-inf")).cast("float").alias("bound"))
    met = edges.select(F.col("a").alias("at"), F.col("b").alias("node"), "fresh").unionByName(named)
    met = met.join(nodes.join(full, "node", "left"), "node").repartition("at").sortWithinPartitions("at")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, "at"):
            at, ids, fresh, bound = (group.column(c).to_numpy() for c in ("at", "node", "fresh", "bound"))
            a, b, s = met_edges(at, ids, matrix(group.column("v")), fresh, bound, kept)
            if len(a):
                yield edges_of([a], [b], [s])

    bound = F.coalesce("bound", F.lit(float("-inf")).cast("float")).alias("bound")
    new = met.select("at", "node", "v", "fresh", bound).mapInArrow(compare, EDGE).withColumn("fresh", F.lit(True))
    return best_edges(edges.withColumn("fresh", F.lit(False)).unionByName(new), k, "a")


def graph(nodes: DataFrame, n: int, k: int = K_GRAPH, reverse: int = K_REVERSE, tables: int = TABLES, block: int = BLOCK, descents: int = DESCENTS, kept: int = KEPT, seed: int = SEED) -> DataFrame:
    """(node, near): each node's nearest and the nearest of those that name it."""
    edges = cut(best_edges(first_edges(nodes, n, k, tables, block, seed).withColumn("fresh", F.lit(True)), k, "a"), "edges")
    for _ in range(descents):
        before, edges = edges, cut(descend(nodes, edges, k, reverse, kept), "edges")
        release(before)
        changed, every = edges.agg(F.sum(F.col("fresh").cast("int")), F.count(F.lit(1))).first()
        if (changed or 0) <= SETTLED * every:
            break
    both = edges.select(F.col("a").alias("node"), "b").unionByName(thinned(edges, reverse, "b").select(F.col("b").alias("node"), F.col("a").alias("b")))
    out = cut(both.groupBy("node").agg(F.collect_set("b").alias("near")), "graph")
    release(edges)
    return out


#: What a walk knows of a node: scored and fallen out of the pool, not expanded yet, expanded next, expanded.
DROPPED, WAITING, NOW, DONE = range(4)
STATE = "part int, q binary, node binary, s binary, kind binary, fq array<int>, fnode array<long>, scored long"


def bucket_of(node: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(node.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)


def packed(nodes: DataFrame, buckets: int) -> DataFrame:
    """(bucket, ids, x): the nodes of a bucket by id, and their vectors one after another."""

    def dealt(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(bucket_of(batch.column(0).to_numpy(), buckets)), batch.column(0), batch.column(1)], ["bucket", "node", "v"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, "bucket"):
            bucket, ids = group.column("bucket").to_numpy(), group.column("node").to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])).tolist()
            for lo, hi in itertools.pairwise(cuts):
                x = b"".join(group.column("v").slice(lo, hi - lo).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(bucket[lo : lo + 1]), pa.array([ids[lo:hi].tobytes()], pa.binary()), pa.array([x], pa.binary())], ["bucket", "ids", "x"])

    return nodes.mapInArrow(dealt, "bucket int, " + NODE).repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(run, "bucket int, ids binary, x binary")


def unpacked(rows: dict, **kinds) -> list[np.ndarray]:
    return [np.frombuffer(rows[name] or b"", kind) for name, kind in kinds.items()]


def requests(asked: DataFrame, buckets: int) -> DataFrame:
    """From a state with `links` (q, near): (bucket, q, node), the pairs that have not been scored, by the node's bucket."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            qs, found = [], []
            for row in range(batch.num_rows):
                q, node = unpacked({k: batch.column(k)[row].as_py() for k in ("q", "node")}, q=np.int32, node=np.int64)
                links = batch.column("links")[row].values
                near = links.field("near")
                lq, ln = np.repeat(links.field("q").to_numpy(), np.diff(near.offsets.to_numpy())), near.flatten().to_numpy()
                o = np.argsort(lq, kind="stable")
                lq, ln = lq[o], ln[o]
                cuts = np.flatnonzero(np.concatenate([[True], lq[1:] != lq[:-1], [True]])).tolist()
                for lo, hi in itertools.pairwise(cuts):
                    new = np.unique(ln[lo:hi])
                    known = node[np.searchsorted(q, lq[lo]) : np.searchsorted(q, lq[lo], "right")]
                    if len(known):
                        new = new[known[np.minimum(np.searchsorted(known, new), len(known) - 1)] != new]
                    qs.append(np.full(len(new), lq[lo], np.int32))
                    found.append(new)
            if not qs or not sum(map(len, qs)):
                continue
            q, node = np.concatenate(qs), np.concatenate(found)
            bucket = bucket_of(node, buckets)
            o = np.argsort(bucket, kind="stable")
            q, node, bucket = q[o], node[o], bucket[o]
            cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])).tolist()
            parts = [[x[lo:hi].tobytes() for lo, hi in itertools.pairwise(cuts)] for x in (q, node)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]]), *(pa.array(p, pa.binary()) for p in parts)], ["bucket", "q", "node"])

    return asked.select("q", "node", "links").mapInArrow(run, "bucket int, q binary, node binary")


def answers(asked: DataFrame, x: np.ndarray) -> DataFrame:
    """From packed nodes with `asked` (q, node): (part, q, node, s), by the queries' parts; x has the queries' vectors."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, v = unpacked({k: batch.column(k)[row].as_py() for k in ("ids", "x")}, ids=np.int64, x="<f4")
                v = v.reshape(len(ids), -1)
                pieces = [unpacked(p, q=np.int32, node=np.int64) for p in batch.column("asked")[row].as_py()]
                q, node = (np.concatenate(c) for c in zip(*pieces, strict=True))
                o = np.argsort(q, kind="stable")
                q, node = q[o], node[o]
                at, s = np.searchsorted(ids, node), np.empty(len(q), np.float32)
                for lo in range(0, len(q), 4096):
                    s[lo : lo + 4096] = -((x[q[lo : lo + 4096]] - v[at[lo : lo + 4096]]) ** 2).sum(1)
                part = q // QUERIES_IN_PART
                cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])).tolist()
                parts = [[c[lo:hi].tobytes() for lo, hi in itertools.pairwise(cuts)] for c in (q, node, s)]
                yield pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]].astype(np.int32)), *(pa.array(p, pa.binary()) for p in parts)], ["part", "q", "node", "s"])

    return asked.select("ids", "x", "asked").mapInArrow(run, "part int, q binary, node binary, s binary")


def merged(state: DataFrame, pool: int, expanded: int) -> DataFrame:
    """From a state with `answers` (q, node, s; or null): the next state."""

    def one(node: np.ndarray, s: np.ndarray, kind: np.ndarray, more: np.ndarray, more_s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A query's nodes by id, with scores and kinds, and those to expand."""
        node, s = np.concatenate([node, more]), np.concatenate([s, more_s])
        kind = np.concatenate([np.where(kind == NOW, DONE, kind).astype(np.uint8), np.full(len(more), WAITING, np.uint8)])
        alive = np.flatnonzero(kind != DROPPED)
        alive = alive[np.lexsort((node[alive], -s[alive]))]
        kind[alive[pool:]] = DROPPED
        now = alive[:pool][kind[alive[:pool]] == WAITING][:expanded]
        kind[now] = NOW
        front = node[now]
        if not len(now):  # the walk has ended; what fell out need not be known any more
            node, s, kind = (c[kind != DROPPED] for c in (node, s, kind))
        o = np.argsort(node, kind="stable")
        return node[o], s[o], kind[o], front

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                q, node, s, kind = unpacked({k: batch.column(k)[row].as_py() for k in ("q", "node", "s", "kind")}, q=np.int32, node=np.int64, s=np.float32, kind=np.uint8)
                pieces = [unpacked(p, q=np.int32, node=np.int64, s=np.float32) for p in batch.column("answers")[row].as_py() or [{"q": b"", "node": b"", "s": b""}]]
                mq, mn, ms = (np.concatenate(c) for c in zip(*pieces, strict=True))
                o = np.argsort(mq, kind="stable")
                mq, mn, ms = mq[o], mn[o], ms[o]
                every, out = np.union1d(q, mq), []
                for k in every.tolist():
                    a, b = np.searchsorted(q, [k, k + 1])
                    c, d = np.searchsorted(mq, [k, k + 1])
                    out.append(one(node[a:b], s[a:b], kind[a:b], mn[c:d], ms[c:d]))
                cat = lambda i, t: np.concatenate([np.zeros(0, t), *(x[i] for x in out)]).astype(t)  # noqa: E731,B023
                of = lambda i: np.repeat(every, [len(x[i]) for x in out]).astype(np.int32)  # noqa: E731,B023
                columns = [[of(0).tobytes()], [cat(0, np.int64).tobytes()], [cat(1, np.float32).tobytes()], [cat(2, np.uint8).tobytes()]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("part").slice(row, 1), *(pa.array(c, pa.binary()) for c in columns), pa.array([of(3)], pa.list_(pa.int32())), pa.array([cat(3, np.int64)], pa.list_(pa.int64())), pa.array([len(mq)])],
                    ["part", "q", "node", "s", "kind", "fq", "fnode", "scored"],
                )

    return state.select("part", "q", "node", "s", "kind", "answers").mapInArrow(run, STATE)


def walk(queries: DataFrame, nodes: DataFrame, near: DataFrame, n: int, pool: int = POOL, expanded: int = EXPANDED, entries: int = ENTRIES, rounds: int = ROUNDS, seed: int = SEED, visits: list[int] | None = None) -> DataFrame:
    """(q, node, s): each query's pool of nearest nodes by greedy search. `queries`: q, v, start (a node to start at, or null).

    No node is scored twice for a query. What belongs to some queries, or to a bucket of nodes, travels as one row of packed numbers.
    `visits` gets the number of scored pairs of each round, for reports."""
    share = min(1.0, entries / max(1, n))
    doors = nodes.select("node").where(F.pmod(F.xxhash64(F.lit(seed), "node"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    doors = [r["node"] for r in doors.collect()]  # about `entries` ids, however many nodes there are
    buckets = max(1, n // NODES_IN_BUCKET)
    held = cut(packed(nodes, buckets), "packed")
    size = int(queries.agg(F.sum(F.length("v"))).first()[0] or 0)
    turns = max(1, -(-size // QUERY_BYTES))
    found = []
    for turn in range(turns):
        mine = queries if turns == 1 else queries.where(F.pmod(F.xxhash64(F.lit(seed), "q"), F.lit(turns)) == turn)
        found.append(walk_together(mine, held, near, doors, buckets, pool, expanded, rounds, visits))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def walk_together(queries: DataFrame, held: DataFrame, near: DataFrame, doors: list[int], buckets: int, pool: int, expanded: int, rounds: int, visits: list[int] | None) -> DataFrame:
    """`walk` of queries whose vectors are sent to all executors."""
    spark = queries.sparkSession
    asked = sorted(queries.select("q", "v", "start").collect(), key=lambda r: r["q"])
    ids, x = np.array([r["q"] for r in asked], np.int64), matrix(pa.array([bytes(r["v"]) for r in asked], pa.binary()))
    numbers = np.arange(len(asked), dtype=np.int32)
    empty = pa.table({"part": pa.array(np.unique(numbers // QUERIES_IN_PART), pa.int32())})
    state = spark.createDataFrame(empty, "part int").select("part", *(F.lit(b"").alias(c) for c in ("q", "node", "s", "kind")))
    starts = pa.table({"q": pa.array(numbers, pa.int32()), "start": pa.array([r["start"] for r in asked], pa.int64())})
    near_doors = F.array_compact(F.array(*(F.lit(d) for d in doors), F.col("start")))
    links = spark.createDataFrame(starts, "q int, start long").select("q", near_doors.alias("near"))
    few = len(asked) * expanded <= BROADCAST_PAIRS

    def ended(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                q, node, s, kind = unpacked({k: batch.column(k)[row].as_py() for k in ("q", "node", "s", "kind")}, q=np.int32, node=np.int64, s=np.float32, kind=np.uint8)
                ok = kind != DROPPED
                yield pa.RecordBatch.from_arrays([pa.array(ids[q[ok]]), pa.array(node[ok]), pa.array(s[ok])], ["q", "node", "s"])

    before = None
    for _ in range(rounds):
        part = F.expr(f"q div {QUERIES_IN_PART}").cast("int").alias("part")
        met = links.groupBy(part).agg(F.collect_list(F.struct("q", "near")).alias("links"))
        wanted = requests(state.join(met, "part"), buckets).groupBy("bucket").agg(F.collect_list(F.struct("q", "node")).alias("asked"))
        scored = answers(held.join(wanted, "bucket"), x).groupBy("part").agg(F.collect_list(F.struct("q", "node", "s")).alias("answers"))
        state = cut(merged(state.join(scored, "part", "left"), pool, expanded), "walk")
        if before is not None:
            release(before)
        before = state
        total, waiting = state.agg(F.sum("scored"), F.sum(F.size("fq"))).first()
        if visits is not None and total:
            visits.append(total)
        if not waiting:
            break
        front = state.select(F.explode(F.arrays_zip("fq", "fnode")).alias("f")).select(F.col("f.fq").alias("q"), F.col("f.fnode").alias("node"))
        links = near.join(F.broadcast(front) if few else front, "node").select("q", "near")
    return state.select("q", "node", "s", "kind").mapInArrow(ended, "q long, node long, s float")


def search(vectors: DataFrame, id_: str, vector: str, k: int = 10, every: int = 100, **tuning) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, its k nearest other rows found."""
    held = cut(usable(vectors, id_, vector), "usable")
    lengths = sorted(r[0] for r in held.select(F.size("x")).distinct().collect())
    found = [search_length(held.where(F.size("x") == d) if len(lengths) > 1 else held, k, every, **tuning) for d in lengths or [0]]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def search_length(usable_: DataFrame, k: int, every: int, **tuning) -> DataFrame:
    """`search` over vectors (vec_id, x) of one length."""
    held = cut(usable_.withColumn("h1", F.xxhash64("x")).withColumn("h2", F.xxhash64(F.lit("second"), "x")), "vectors")
    ids = cut(held.groupBy("h1", "h2").agg(F.min("vec_id").alias("first")), "ids")
    # A node is named by its vector's smallest id; where a vec_id has rows with different vectors, by the hash as well.
    named_twice = not ids.groupBy("first").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    ids = ids.withColumn("node", F.xxhash64("first", "h1", "h2") if named_twice else F.col("first"))
    owner = cut(held.select("vec_id", "h1", "h2").join(ids, ["h1", "h2"]).select("vec_id", "node"), "owners")
    originals = cut(held.join(ids, ["h1", "h2"]).where(F.col("vec_id") == F.col("first")).dropDuplicates(["node"]).select("node", "x"), "nodes")
    n = originals.count()
    scale = float(originals.agg(F.max(F.array_max(F.transform("x", lambda a: F.abs(a))))).first()[0] or 1.0)
    nodes = cut(to_single(originals, scale), "single")
    near = graph(nodes, n, **{key: tuning[key] for key in tuning.keys() & {"k", "tables", "block", "descents"}})
    asked = owner.where(F.col("vec_id") % every == 0).select(F.col("node").alias("q")).distinct()
    queries = cut(asked.join(nodes, F.col("q") == F.col("node")).select("q", "v", F.col("node").alias("start")), "queries")
    pool = walk(queries, nodes, near, n, **{key: tuning[key] for key in tuning.keys() & {"pool", "expanded", "entries", "rounds", "visits"}})

    # The k + 1 smallest ids of each node: a query may be one of them itself. Hot nodes are first thinned by salt.
    first = owner.distinct().withColumn("_salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    first = first.withColumn("_r", F.row_number().over(W.partitionBy("node", "_salt").orderBy("vec_id"))).where(F.col("_r") <= k + 1).drop("_r", "_salt")
    first = first.withColumn("_r", F.row_number().over(W.partitionBy("node").orderBy("vec_id"))).where(F.col("_r") <= k + 1)
    members = cut(first.groupBy("node").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "members")
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.col("s").desc(), "node"))
    heads = pool.withColumn("_r", rank).where(F.col("_r") <= max(RERANKED, 4 * k)).select("q", "node")
    exact = heads.join(originals, "node").join(originals.select(F.col("node").alias("q"), F.col("x").alias("y")), "q")
    distance = F.sqrt(F.aggregate(F.zip_with("x", "y", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b))
    scored = exact.select("q", "node", distance.alias("score")).join(members, "node").select("q", "score", F.explode("ids").alias("vec_id"))
    # All ids of a query's node share its answers, up to themselves.
    nearest = scored.withColumn("_r", F.row_number().over(W.partitionBy("q").orderBy("score", "vec_id"))).where(F.col("_r") <= k + 1).drop("_r")
    nearest = cut(nearest, "nearest")
    per_query = owner.distinct().where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("node").alias("q")).join(nearest, "q").where(F.col("vec_id") != F.col("query_id"))
    out = per_query.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")


def neighbours_query(vectors: DataFrame) -> DataFrame:
    return search(vectors, "vec_id", "embedding")
