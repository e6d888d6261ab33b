"""Text embeddings: hashed features, TF-IDF with a singular value decomposition, or a function that the caller brings."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import grams as G
from ..functions import text as T
from ..functions import vectors as V

DIM, SEED, MIN_DOCS, MIN_COMPONENTS = 256, 13, 3, 16
VERSION = "1.0"


class DegenerateCorpus(ValueError):
    """Too few documents or features for a decomposition that means anything."""


@dataclass
class Embedder:
    """Common ground: `fit(texts)` if needed, then `embed(texts)` adds vec to (id, text)."""

    dim: int = DIM
    seed: int = SEED
    name: str = "base"

    def __post_init__(self):
        if self.dim <= 0:
            raise ValueError("dim must be positive")

    @property
    def fitted(self) -> bool:
        return True

    def fit(self, texts: DataFrame) -> Embedder:
        return self

    def embed(self, texts: DataFrame) -> DataFrame:
        raise NotImplementedError

    def fit_transform(self, texts: DataFrame) -> DataFrame:
        return self.fit(texts).embed(texts)

    def params(self) -> dict:
        return {"dim": self.dim, "seed": self.seed}

    def as_dict(self) -> dict:
        return {"name": self.name, "params": self.params(), "fitted": self.fitted}

    def save(self, path: str, spark=None) -> None:
        os.makedirs(path, exist_ok=True)
        with open(os.path.join(path, "meta.json"), "w", encoding="utf-8") as f:
            json.dump({"version": VERSION, **self.as_dict()}, f)


@dataclass
class HashingEmbedder(Embedder):
    """Each feature goes to a bucket and a sign by its hash, with weight 1 + ln(tf). Needs no fit."""

    name: str = "hash"
    signed: bool = True
    sublinear: bool = True
    words: tuple[int, int] = (1, 2)
    chars: tuple[int, int] | None = (3, 5)

    def embed(self, texts: DataFrame) -> DataFrame:
        dim, how = self.dim, {"head": f"{self.seed}:", "signed": self.signed, "sublinear": self.sublinear, "words": self.words, "chars": self.chars}

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in G.slices(batches, 1):
                x = V.unit_rows(G.hashed(b.column(1).to_pylist(), dim, **how)[0])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * dim), pa.array(x.ravel()))], ["id", "vec"])

        rows = texts.select("id", "text")
        return rows.mapInArrow(run, rows.select("id", F.array(F.lit(0.0)).alias("vec")).schema)


@dataclass
class LsaEmbedder(Embedder):
    """TF-IDF of word runs and of characters within words, each half of unit length, projected on the main singular vectors."""

    name: str = "lsa"
    min_docs: int = MIN_DOCS
    min_components: int = MIN_COMPONENTS
    whiten: bool = False
    max_features: int = 50_000
    model: dict = field(default_factory=dict)

    @property
    def fitted(self) -> bool:
        return bool(self.model)

    def _halves(self, texts: DataFrame) -> DataFrame:
        """(id, half, f, tf)."""
        normal = T.normalize(F.col("text"))
        words = F.filter(F.split(normal, r"[^\p{L}\p{N}_'-]+|(?<![\p{L}\p{N}_])['-]+|['-]+(?![\p{L}\p{N}_])"), lambda x: x != "")
        word = texts.select("id", F.lit(0).alias("half"), F.explode(T.word_shingles(words, 1, 2)).alias("f"))
        inside = texts.select("id", F.explode(T.tokens(normal)).alias("w")).select("id", F.lit(1).alias("half"), F.explode(T.char_shingles(F.col("w"))).alias("f"))
        return word.unionByName(inside).groupBy("id", "half", "f").agg(F.count(F.lit(1)).alias("tf"))

    def _weights(self, halves: DataFrame) -> DataFrame:
        """(id, half, f, w), each half of unit length."""
        idf = self.model["idf"]
        w = halves.join(idf, ["half", "f"]).withColumn("w", (1 + F.log(F.col("tf").cast("double"))) * F.col("idf"))
        size = w.groupBy("id", "half").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
        return w.join(size, ["id", "half"]).select("id", "k", (F.col("w") / F.col("size")).alias("w"))

    def fit(self, texts: DataFrame) -> LsaEmbedder:
        from pyspark.mllib.linalg import Vectors
        from pyspark.mllib.linalg.distributed import RowMatrix

        n = texts.count()
        if n < self.min_docs:
            raise DegenerateCorpus(f"{n} documents; at least {self.min_docs} are needed")
        halves = self._halves(texts).persist()
        df = halves.groupBy("half", "f").agg(F.countDistinct("id").alias("df"))
        kept = df.orderBy(F.col("df").desc(), "half", "f").limit(self.max_features)
        from pyspark.sql import Window as W

        idf = kept.select("half", "f", (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf"), (F.row_number().over(W.orderBy("half", "f")) - 1).alias("k")).persist()
        size = idf.count()
        k = min(self.dim, n - 1, size - 1)
        if size == 0 or k < max(1, self.min_components):
            halves.unpersist()
            raise DegenerateCorpus(f"{n} documents with {size} features allow {max(k, 0)} components; at least {self.min_components} are needed")
        self.model = {"idf": idf}
        rows = self._weights(halves).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("k", "w"))).alias("e"))
        matrix = RowMatrix(rows.rdd.map(lambda r: Vectors.sparse(size, [(e["k"], e["w"]) for e in r["e"]])))
        svd = matrix.computeSVD(k, computeU=False)
        right, values = svd.V.toArray(), np.array(svd.s.toArray())
        if self.whiten:
            right = right / np.maximum(values, V.EPS)
        halves.unpersist()
        self.model |= {"right": right, "values": values, "n": n}
        return self

    def state(self) -> dict:
        s = self.model["values"]
        return {"explained_variance_top10": [round(float(x), 6) for x in (s**2 / (s**2).sum())[:10]], "n_docs": self.model["n"], "components": len(s)}

    def embed(self, texts: DataFrame) -> DataFrame:
        if not self.fitted:
            self.fit(texts)
        right, dim = self.model["right"], max(self.dim, self.model["right"].shape[1])
        rows = self._weights(self._halves(texts)).groupBy("id").agg(F.collect_list("k").alias("ks"), F.collect_list("w").alias("ws"))
        whole = texts.select("id").join(rows, "id", "left")
        shared = texts.sparkSession.sparkContext.broadcast(right)

        def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = []
                for ks, ws in zip(b["ks"], b["ws"], strict=True):
                    v = np.zeros(dim)
                    if ks is not None:
                        v[: shared.value.shape[1]] = np.asarray(ws) @ shared.value[np.asarray(ks, int)]
                    size = np.linalg.norm(v)
                    out.append(v / size if size >= V.EPS else v * 0)
                yield pd.DataFrame({"id": b["id"], "vec": out})

        return whole.mapInPandas(run, "id long, vec array<double>")


@dataclass
class ExternalEmbedder(Embedder):
    """Vectors from a function of a list of texts, called in batches on the executors."""

    name: str = "external"
    call: Callable[[list[str]], list[list[float]]] | None = None
    batch: int = 96

    def embed(self, texts: DataFrame) -> DataFrame:
        call, size, dim = self.call, self.batch, self.dim
        if call is None:
            raise RuntimeError("an external embedder needs a function")

        def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out: list[np.ndarray] = []
                for a in range(0, len(b), size):
                    for v in call(["" if t is None else t for t in b["text"].iloc[a : a + size]]):
                        v = np.pad(np.asarray(v, float), (0, max(0, dim - len(v))))
                        norm = np.linalg.norm(v)
                        out.append(v / norm if norm >= V.EPS else v * 0)
                yield pd.DataFrame({"id": b["id"], "vec": out})

        return texts.select("id", "text").mapInPandas(run, "id long, vec array<double>")


def available_backends() -> dict[str, bool]:
    return {"hash": True, "lsa": True, "external": True, "auto": True}


def build_embedder(backend: str | None = None, corpus: DataFrame | None = None, dim: int = DIM, seed: int = SEED, min_docs: int = MIN_DOCS, min_components: int = MIN_COMPONENTS, call=None) -> Embedder:
    """By name, else by MILLRACE_EMBEDDER, else `auto`: LSA if the corpus carries it, otherwise hashing."""
    backend = (backend or os.environ.get("MILLRACE_EMBEDDER") or "auto").lower()
    if backend == "hash":
        return HashingEmbedder(dim, seed)
    if backend == "external":
        return ExternalEmbedder(dim, seed, call=call)
    if backend in ("lsa", "auto"):
        if backend == "auto" and (corpus is None or corpus.limit(min_docs).count() < min_docs):
            return HashingEmbedder(dim, seed)
        found = LsaEmbedder(dim, seed, min_docs=min_docs, min_components=min_components)
        try:
            return found.fit(corpus) if corpus is not None else found
        except DegenerateCorpus:
            if backend == "lsa":
                raise
            return HashingEmbedder(dim, seed)
    raise ValueError(f"unknown embedding backend {backend!r}")


def embedder_from_meta(meta: dict) -> Embedder:
    """An unfitted embedder as `as_dict` describes it; hashing for what can't be built."""
    kind = {"hash": HashingEmbedder, "lsa": LsaEmbedder, "external": ExternalEmbedder}.get(meta.get("name"), HashingEmbedder)
    p = meta.get("params", {})
    return kind(int(p.get("dim", DIM)), int(p.get("seed", SEED)))


def load_meta(path: str) -> Embedder:
    with open(os.path.join(path, "meta.json"), encoding="utf-8") as f:
        meta = json.load(f)
    if meta["version"].split(".")[0] != VERSION.split(".")[0]:
        raise RuntimeError(f"saved by version {meta['version']}, this is {VERSION}")
    return embedder_from_meta(meta)
