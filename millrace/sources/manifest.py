"""Lineage of a run: hashes of its configuration and corpora, counts by stage, and the file that records them."""

from __future__ import annotations

import hashlib
import json
import math
import os
import platform
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import __version__
from ..functions.text import normalize

STAGES = ("seeds", "expanded", "filtered", "deduped", "exported")


def canonical(value: Any) -> Any:
    if isinstance(value, float) and not math.isfinite(value):
        return str(value)
    if isinstance(value, dict):
        return {str(k): canonical(v) for k, v in value.items() if not str(k).startswith("_")}
    if isinstance(value, list | tuple | set | frozenset):
        items = [canonical(v) for v in value]
        return sorted(items, key=str) if isinstance(value, set | frozenset) else items
    if hasattr(value, "item"):
        return canonical(value.item())
    return value if value is None or isinstance(value, str | int | float | bool) else str(value)


def canonical_json(value: Any) -> str:
    return json.dumps(canonical(value), sort_keys=True, separators=(",", ":"), ensure_ascii=True)


def config_hash(value: Any) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def corpus_hash(texts: DataFrame, text: str = "text") -> DataFrame:
    """One row (corpus_hash), whatever the order of rows: SHA-256 of the sorted SHA-256 of all texts. One string of 64 bytes a text is gathered."""
    return texts.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))), ""), 256).alias("corpus_hash"))


def ordered_corpus_hash(texts: DataFrame, pos: str, text: str = "text") -> DataFrame:
    """One row (corpus_hash) that depends on the order: of the normalised texts by `pos`."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), normalize(F.col(text)).alias("t"))))
    return texts.agg(F.sha2(F.array_join(F.transform(rows, lambda r: r["t"]), "\u001f"), 256).alias("corpus_hash"))


def stage_counts(**counts: int) -> dict[str, int]:
    """The counts by stage and what each stage dropped."""
    out = {s: int(counts.get(s, 0)) for s in STAGES}
    before = out["seeds"]
    for s in STAGES:
        out[f"dropped_at_{s}"] = max(0, before - out[s])
        before = out[s]
    return out


@dataclass
class RunManifest:
    version: str = __version__
    config: dict = field(default_factory=dict)
    config_hash: str = ""
    seed_corpus_hash: str = ""
    output_corpus_hash: str = ""
    stages: dict = field(default_factory=dict)
    embedder: dict = field(default_factory=dict)
    thresholds: dict = field(default_factory=dict)
    dedup: dict = field(default_factory=dict)
    split: dict = field(default_factory=dict)
    output: dict = field(default_factory=dict)
    environment: dict = field(default_factory=dict)
    created_utc: str | None = None

    @classmethod
    def from_run(cls, config: dict, seeds: DataFrame, exported: DataFrame, stages: dict, spark_version: str = "", **parts: Any) -> RunManifest:
        text = lambda df: df.select(F.concat("input", F.lit("\n"), "output").alias("text"))
        return cls(config=canonical(config), config_hash=config_hash(config), seed_corpus_hash=corpus_hash(text(seeds)).first()[0], output_corpus_hash=corpus_hash(text(exported)).first()[0], stages=stage_counts(**stages), environment={"python": platform.python_version(), "spark": spark_version or seeds.sparkSession.version}, **parts)

    def as_dict(self) -> dict:
        return canonical(asdict(self))

    def to_json(self) -> str:
        return json.dumps(self.as_dict(), sort_keys=True, indent=2, ensure_ascii=False) + "\n"

    @classmethod
    def from_dict(cls, d: dict) -> RunManifest:
        return cls(**{k: v for k, v in d.items() if k in cls.__dataclass_fields__})

    def same_inputs(self, other: RunManifest) -> bool:
        return (self.config_hash, self.seed_corpus_hash) == (other.config_hash, other.seed_corpus_hash)

    def reproduce_command(self) -> str:
        c = self.config
        flags = [f"--{k.replace('_', '-')} {c[k]}" for k in ("threshold", "strategy") if c.get(k) is not None] + [f"--{k}" for k in ("report", "split") if c.get(k)]
        return " ".join(["python -m millrace", str(c.get("seeds_path", "seeds.json")), str(c.get("out_path", "out.jsonl")), *flags])

    def summary(self) -> str:
        return f"run {self.config_hash[:12]} on {self.seed_corpus_hash[:12]}: " + ", ".join(f"{s} {self.stages.get(s)}" for s in STAGES)


def manifest_path(path: str, name: str = "run.json") -> str:
    """The manifest's own path: a path with a suffix names a file beside which it stands, unless it is a .json itself."""
    if path.endswith(".json"):
        return path
    return os.path.join(os.path.dirname(path) if os.path.splitext(path)[1] else path, name)


def write_manifest(manifest: RunManifest, path: str, name: str = "run.json") -> str:
    at = manifest_path(path, name)
    os.makedirs(os.path.dirname(os.path.abspath(at)), exist_ok=True)
    with open(at, "w", encoding="utf-8") as f:
        f.write(manifest.to_json())
    return at


def read_manifest(path: str, name: str = "run.json") -> RunManifest:
    with open(manifest_path(path, name), encoding="utf-8") as f:
        return RunManifest.from_dict(json.load(f))
