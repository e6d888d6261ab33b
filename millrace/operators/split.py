"""Stratified train, validation and test sets that keep near-duplicates together, and an audit for leaks."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..functions.staging import cut
from .dedup import find_groups

RATIOS = (0.8, 0.1, 0.1)
NAMES = ("train", "val", "test")


class LeakageError(AssertionError):
    """Two splits share an example or near-duplicates."""


def normalized_ratios(ratios) -> tuple[float, ...]:
    if len(ratios) != 3 or sum(ratios) <= 0 or min(ratios) < 0:
        raise ValueError(f"three ratios with a positive sum are needed, not {ratios}")
    return tuple(round(r / sum(ratios), 6) for r in ratios)


def apportion(total: int, ratios) -> list[int]:
    """Integer shares of `total` by largest remainder, ties to the earlier one."""
    raw = [total * float(r) for r in ratios]
    out = [int(x // 1) for x in raw]
    order = sorted(range(len(raw)), key=lambda k: (out[k] - raw[k], k))
    for k in range(max(0, total - sum(out))):
        out[order[k % len(order)]] += 1
    return out


def targets(sizes: DataFrame, ratios=RATIOS) -> DataFrame:
    """(stratum, s, want) from (stratum, n), by window functions."""
    shares = F.array(*[F.struct(F.lit(k).alias("s"), F.lit(float(r)).alias("ratio")) for k, r in enumerate(ratios)])
    t = sizes.select("stratum", "n", F.explode(shares).alias("x")).select("stratum", "n", "x.s", (F.col("n") * F.col("x.ratio")).alias("raw"))
    t = t.withColumn("base", F.floor("raw").cast("long")).withColumn("left", F.col("n") - F.sum(F.floor("raw").cast("long")).over(W.partitionBy("stratum")))
    rank = F.row_number().over(W.partitionBy("stratum").orderBy((F.col("raw") - F.col("base")).desc(), "s"))
    return t.select("stratum", "s", (F.col("base") + F.when(rank <= F.col("left"), 1).otherwise(0)).alias("want"))


def assign_singles(units: DataFrame, ratios=RATIOS) -> DataFrame:
    """(unit, stratum, s) for units (unit, stratum, key) of weight one.

    The greedy rule, most wanted split first, equals dealing slots (split, r), r = 1..want, by falling r, then split; the k-th unit
    of its stratum by key takes the k-th slot.
    """
    parts = units.withColumn("part", F.coalesce(F.substring("key", 1, 2), F.lit("")))
    # Two levels: within the units whose keys begin alike, after the units of lesser beginnings. Where keys are hashes, no task has a whole stratum.
    sizes = parts.groupBy("stratum", "part").agg(F.count(F.lit(1)).alias("m"))
    before = sizes.withColumn("base", F.coalesce(F.sum("m").over(W.partitionBy("stratum").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    dealt = before.join(_slots(targets(sizes.groupBy("stratum").agg(F.sum("m").alias("n")), ratios)), "stratum").select("stratum", "part", "base", "slots")
    ranked = parts.withColumn("r", F.row_number().over(W.partitionBy("stratum", "part").orderBy("key", "unit"))).join(dealt, ["stratum", "part"])
    at = F.col("base") + F.col("r") - 1
    here = F.get(F.filter("slots", lambda x: (x["start"] <= at) & (at < x["start"] + x["length"])), F.lit(0))
    placed = ranked.select("unit", "stratum", at.alias("at"), here.alias("here"))
    return placed.select("unit", "stratum", F.get("here.open", ((F.col("at") - F.col("here.start")) % F.size("here.open")).cast("int")).alias("s"))


def _slots(want: DataFrame) -> DataFrame:
    """(stratum, slots) from (stratum, s, want): between two wants, the splits that still want units take turns; slots has the start and length
    of each such run and its splits `open`. So a stratum has three runs at most, not a slot a unit."""
    down = W.partitionBy("stratum").orderBy(F.col("want").desc())
    levels = want.where("want > 0").groupBy("stratum", "want").agg(F.collect_list("s").alias("some"))
    runs = levels.withColumn("open", F.array_sort(F.flatten(F.collect_list("some").over(down.rowsBetween(W.unboundedPreceding, 0))))).withColumn("length", (F.col("want") - F.coalesce(F.lead("want").over(down), F.lit(0))) * F.size("open"))
    runs = runs.withColumn("start", F.coalesce(F.sum("length").over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return runs.groupBy("stratum").agg(F.collect_list(F.struct("start", "length", "open")).alias("slots"))


def assign_weighted(units: DataFrame, ratios=RATIOS) -> DataFrame:
    """(unit, stratum, s) for units (unit, stratum, key, weight): in key order, each goes where most is still wanted.

    A stratum is dealt out in one pass over its units, which are groups of documents, not documents."""
    ratios = tuple(ratios)

    def deal(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["key", "unit"], kind="stable")
        left = apportion(int(group["weight"].clip(lower=1).sum()), ratios)
        out = []
        for w in group["weight"]:
            s = max(range(len(left)), key=lambda k: (left[k], -k))
            left[s] -= max(1, int(w))
            out.append(s)
        return pd.DataFrame({"unit": group["unit"], "stratum": group["stratum"], "s": out})

    return units.groupBy("stratum").applyInPandas(deal, "unit long, stratum string, s int")


def split_name(s):
    return F.get(F.array(*map(F.lit, NAMES)), s)


@dataclass
class Leakage:
    ok: bool
    counts: dict
    shared: list = field(default_factory=list)
    near: list = field(default_factory=list)
    max_cosine: float | None = None
    sampled: bool = False


def shared_keys(rows: DataFrame) -> DataFrame:
    """(split_a, split_b, key, ids_a, ids_b) of content keys that two splits hold; rows: id, split, key."""
    per = rows.groupBy("split", "key").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    a, b = per.select(F.col("split").alias("split_a"), "key", F.col("ids").alias("ids_a")), per.select(F.col("split").alias("split_b"), "key", F.col("ids").alias("ids_b"))
    return a.join(b, "key").where("split_a < split_b").select("split_a", "split_b", "key", "ids_a", "ids_b")


def near_across(rows: DataFrame, threshold: float) -> DataFrame:
    """(i, j, sim, split_a, split_b) of pairs of different splits with a cosine of at least `threshold`; rows: id, split, vec."""
    names, marked = _marked(rows)
    pairs = V.meet(marked, V.blocks(marked), V.Above(threshold, "after", apart=True))
    name = lambda c: F.get(F.lit(names).cast("array<string>"), F.col(c).cast("int"))
    return pairs.select("i", "j", "sim", F.least(name("own"), name("other")).alias("split_a"), F.greatest(name("own"), name("other")).alias("split_b"))


def _marked(rows: DataFrame) -> tuple[list[str], DataFrame]:
    """The names of the splits, and (id, vec, mark) of the rows that have one, mark its place among the names."""
    names = sorted(r["split"] for r in rows.select("split").where("split IS NOT NULL").distinct().collect())
    mark = F.array_position(F.lit(names).cast("array<string>"), F.col("split")) - 1
    return names, rows.where("split IS NOT NULL").select("id", "vec", mark.alias("mark"))


def greatest_across(rows: DataFrame) -> DataFrame:
    """One row (sim): the greatest cosine over all pairs of rows of different splits, below any threshold too; rows: id, split, vec."""
    _, marked = _marked(rows)
    return V.meet(marked, V.blocks(marked), V.Best(1, apart=True)).agg(F.max("sim").alias("sim"))


def audit(rows: DataFrame, threshold: float, limit: int = 20) -> Leakage:
    """Of rows (id, split, key, vec): what splits share, exactly and nearly. The lists show the first `limit`; counts are whole."""
    shared, near = shared_keys(rows), near_across(rows, threshold).persist()
    n_shared, n_near = shared.count(), near.count()
    found = Leakage(n_shared == 0 and n_near == 0, {"shared_hashes": n_shared, "near_duplicates": n_near, "sampled_examples": 0})
    found.shared = [r.asDict() for r in shared.orderBy("key", "split_a", "split_b").limit(limit).collect()]
    found.near = [r.asDict() for r in near.orderBy(F.col("sim").desc(), "i", "j").limit(limit).collect()]
    found.max_cosine = near.agg(F.max("sim").alias("sim")).first()["sim"] if n_near else greatest_across(rows).first()["sim"]
    near.unpersist()
    return found


def assert_no_leakage(rows: DataFrame, threshold: float) -> None:
    found = audit(rows, threshold)
    if not found.ok:
        raise LeakageError(str(found.counts))


@dataclass
class Split:
    rows: DataFrame
    counts: dict
    ratios: tuple
    leakage: Leakage | None

    def proportions(self) -> dict:
        total = sum(self.counts.values())
        return {k: v / total if total else 0.0 for k, v in self.counts.items()}


def split_dataset(examples: DataFrame, ratios=RATIOS, threshold: float = 0.92, strategy: str = "ivf", embedder=None, group: bool = True, check: bool = True) -> Split:
    """`examples` (id, input, output, tag) with a column split; near-duplicates and equal texts stay together."""
    ratios = normalized_ratios(ratios)
    texts = examples.select("id", T.example_text(F.col("input"), F.col("output")).alias("text"), F.coalesce("tag", F.lit("")).alias("tag"))
    if texts.isEmpty():
        return Split(examples.withColumn("split", F.lit(None).cast("string")), dict.fromkeys(NAMES, 0), ratios, None)
    from .embed import build_embedder

    embedder = embedder or build_embedder(None, texts.select("id", "text"))
    keyed = texts.withColumn("key", T.content_hash(T.normalize(F.col("text"))))
    if group:
        g = find_groups(texts, threshold, strategy, embedder).groups
    else:
        g = texts.select("id", F.col("id").alias("group_id"))
    inside = keyed.join(g, "id")
    units = inside.groupBy("group_id").agg(F.count(F.lit(1)).alias("weight"), F.min_by("tag", "id").alias("stratum"), F.sha2(F.array_join(F.array_sort(F.collect_list("key")), "\u001f"), 256).alias("key"))
    placed = assign_weighted(units.select(F.col("group_id").alias("unit"), "stratum", "key", "weight"), ratios)
    rows = cut(inside.join(placed, F.col("group_id") == F.col("unit")).select("id", "key", split_name(F.col("s")).alias("split")), "split")
    counts = dict.fromkeys(NAMES, 0) | {r["split"]: r["n"] for r in rows.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    leakage = None
    if check:
        leakage = audit(rows.join(embedder.embed(texts.select("id", "text")), "id"), threshold)
        if not leakage.ok:
            raise LeakageError(str(leakage.counts))
    return Split(examples.join(rows.select("id", "split"), "id"), counts, ratios, leakage)
