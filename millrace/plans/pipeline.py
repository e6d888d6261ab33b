"""The dataset pipeline: load, expand, judge, deduplicate, export, report, split, record."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.staging import cut
from ..operators import generate, metrics, split
from ..operators.dedup import dedup
from ..operators.embed import build_embedder
from ..sources import examples as X
from ..sources.manifest import RunManifest, stage_counts, write_manifest
from ..sources.settings import Settings, get_logger

log = get_logger(__name__)


@dataclass
class Result:
    kept: DataFrame
    seeds: DataFrame
    audit: DataFrame | None
    stages: dict
    report: metrics.DataReport | None = None
    split: split.Split | None = None
    manifest: RunManifest | None = None
    paths: dict | None = None

    @property
    def n(self) -> int:
        return self.stages["exported"]

    def as_dict(self) -> dict:
        return {"n": self.n, "stages": self.stages, "report": self.report and self.report.as_dict(), "split": self.split and {"counts": self.split.counts, "ratios": self.split.ratios}, "manifest": self.manifest and self.manifest.as_dict(), "paths": self.paths}


def run_detailed(spark: SparkSession, seeds_path: str, out_path: str, expander: generate.Model | None = None, judge: generate.Model | None = None, threshold: float | None = None, strategy: str | None = None, report: bool = False, do_split: bool = False, settings: Settings | None = None, keep_seeds: bool = False) -> Result:
    """Without models nothing is expanded and the seeds themselves are deduplicated and exported.

    Judged sets leave the seeds out, whose inputs are known, unless `keep_seeds`; if nothing passes, the seeds go on."""
    settings = settings or Settings.load()
    threshold = settings.dedup_threshold if threshold is None else threshold
    strategy = strategy or settings.dedup_strategy
    config = settings.as_dict() | {"threshold": threshold, "strategy": strategy, "report": report, "split": do_split, "seeds_path": seeds_path, "out_path": out_path}
    seeds = X.load_examples(spark, seeds_path).persist()
    n_seeds = seeds.count()
    if not n_seeds:
        X.write_chat_file(seeds, out_path)
        done = Result(seeds, seeds, None, stage_counts(), paths={"out": out_path})
        done.manifest = RunManifest.from_run(config, seeds, seeds, done.stages)
        done.paths["manifest"] = write_manifest(done.manifest, out_path)
        return done

    pool, n_new = seeds, 0
    if expander is not None:
        new, replies = generate.expand(seeds, expander, settings.variants)
        failed = replies.where("error is not null").count()
        if failed:
            log.warning("%d seeds could not be expanded", failed)
        # New ids follow the seeds', by seed and place in the reply.
        new = cut(new.select((F.lit(n_seeds) + F.col("id") * 1_000_000 + F.col("k")).cast("long").alias("id"), "input", "output", "tag"), "variants")
        n_new = new.count()
        pool = seeds.unionByName(new)
    passed = seeds
    if judge is not None and n_new:
        judged = cut(generate.filter_candidates(pool, seeds, judge, settings.min_score), "judged")
        passed = seeds if judged.isEmpty() else seeds.unionByName(judged) if keep_seeds else judged
    elif n_new:
        passed = pool
    n_passed = passed.count()

    texts = passed.select("id", F.concat("input", F.lit("\n"), "output").alias("text"))
    embedder = build_embedder(settings.embedder, texts, settings.dim, settings.seed)
    kept, audit, facts = dedup(passed.withColumn("text", F.col("input")), threshold=threshold, strategy=strategy, embedder=embedder, num_perm=settings.num_perm, n_probe=settings.n_probe)
    kept = cut(kept.select("id", "input", "output", "tag"), "kept")
    stages = stage_counts(seeds=n_seeds, expanded=n_seeds + n_new, filtered=n_passed, deduped=facts["n_kept"], exported=facts["n_kept"])
    done = Result(kept, seeds, audit, stages, paths={"out": out_path})
    X.write_chat_file(kept, out_path)
    if report:
        same = [F.col(f"kept.{c}").eqNullSafe(F.col(f"seeds.{c}")) for c in ("input", "output", "tag")]
        generated = kept.alias("kept").join(seeds.alias("seeds"), same, "left_anti").select("id", "input", "output", "tag")
        done.report = metrics.quality_report(seeds, generated, embedder, threshold)
    if do_split:
        done.split = split.split_dataset(kept, settings.ratios, threshold, strategy, embedder)
        done.paths |= X.write_split_files(done.split.rows, out_path + ".splits")
    parts: dict[str, Any] = {"embedder": embedder.as_dict(), "thresholds": {"dedup": threshold, "leak": settings.leak_threshold}, "dedup": facts, "split": done.split.counts if done.split else {}, "output": {"path": out_path, "n": done.n}}
    done.manifest = RunManifest.from_run(config, seeds, kept, {k: stages[k] for k in ("seeds", "expanded", "filtered", "deduped", "exported")}, **parts)
    done.paths["manifest"] = write_manifest(done.manifest, out_path)
    return done


def run(spark: SparkSession, seeds_path: str, out_path: str, **how) -> int:
    return run_detailed(spark, seeds_path, out_path, **how).n
