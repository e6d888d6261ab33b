"""python -m millrace SEEDS [OUT] [--threshold T] [--strategy S] [--report] [--split]"""

from __future__ import annotations

import argparse
import json
import sys


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("millrace")
    p.add_argument("seeds")
    p.add_argument("out", nargs="?", default="out.jsonl")
    p.add_argument("--threshold", type=float)
    p.add_argument("--strategy", choices=("exact", "lsh", "ivf", "hybrid"))
    p.add_argument("--report", action="store_true")
    p.add_argument("--split", action="store_true")
    a = p.parse_args(argv)
    from pyspark.sql import SparkSession

    from .plans.pipeline import run_detailed

    spark = SparkSession.builder.appName("millrace").getOrCreate()
    try:
        done = run_detailed(spark, a.seeds, a.out, threshold=a.threshold, strategy=a.strategy, report=a.report, do_split=a.split)
    except FileNotFoundError as e:
        print(f"no such file: {e}", file=sys.stderr)
        return 2
    except Exception as e:  # noqa: BLE001  the exit code tells
        print(f"failed: {e}", file=sys.stderr)
        return 1
    print(json.dumps(done.stages))
    return 0


if __name__ == "__main__":
    sys.exit(main())
