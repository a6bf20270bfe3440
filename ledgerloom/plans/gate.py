"""The matching gate: run all scenarios, judge them, write a report.

    python -m ledgerloom.plans.gate --seed 42 --generated 100 --json report.json --compare
"""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict, dataclass, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import GateThresholds, MatchConfig
from ..operators import metrics
from ..synth.scenarios import Suite, generated_suite, hand_written
from ..workspace import settle, ship_package
from .matcher import match, outcomes

ENGINE_VERSION = "ledgerloom-1"


@dataclass
class GateRun:
    per_scope: DataFrame
    overall: DataFrame
    deterministic: bool
    reasons: list[str]

    @property
    def passed(self) -> bool:
        return not self.reasons


def evaluate(suite: Suite, cfg: MatchConfig, limits: GateThresholds) -> tuple[DataFrame, DataFrame]:
    """(metrics per scope, outcome of every record)."""
    result = match(suite.transactions, suite.slips, cfg)
    actual = settle(outcomes(result, suite.transactions, suite.slips))
    rows = metrics.per_scope(result, suite.transactions, suite.slips, suite.labels, suite.expectations, actual, limits)
    return settle(rows), actual


def run_gate(suite: Suite, cfg: MatchConfig | None = None, limits: GateThresholds | None = None, repeats: int = 1) -> GateRun:
    """Judge a suite; further runs, each under another number of partitions, must agree with the first."""
    cfg, limits = cfg or MatchConfig(), limits or GateThresholds()
    rows, actual = evaluate(suite, cfg, limits)
    same = True
    spark = suite.transactions.sparkSession
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for k in range(repeats):
            spark.conf.set("spark.sql.shuffle.partitions", str(int(before) + 2 * k + 1))
            same = same and metrics.same_rows(actual, evaluate(suite, cfg, limits)[1])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    total = metrics.overall(rows)
    return GateRun(rows, total, same, metrics.failure_reasons(total, rows, limits, same))


def compare_configs(suite: Suite, base: MatchConfig, other: MatchConfig) -> tuple[GateRun, GateRun]:
    return run_gate(suite, base, repeats=0), run_gate(suite, other, repeats=0)


def report(run: GateRun, cfg: MatchConfig, limits: GateThresholds, seed: int, scale: int) -> dict:
    return {
        "schema_version": "1", "timestamp": datetime.now(timezone.utc).isoformat(), "seed": seed, "config_hash": cfg.fingerprint(), "dataset_scale": scale, "engine_version": ENGINE_VERSION,
        "thresholds": asdict(limits), "overall": run.overall.first().asDict(), "per_class": [r.asDict() for r in run.per_scope.orderBy("scope").collect()],
        "deterministic": run.deterministic, "passed": run.passed, "failure_reasons": run.reasons,
    }


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Judge the matcher on labelled scenarios.")
    parser.add_argument("--seed", type=int, default=42)
    parser.add_argument("--generated", type=int, default=100)
    parser.add_argument("--json", default="")
    parser.add_argument("--compare", action="store_true")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    ship_package(spark)
    cfg, limits = MatchConfig(), GateThresholds()
    suite = hand_written(spark)
    if args.generated > 0:
        suite = suite.union(generated_suite(spark, args.generated, args.seed))
    if args.compare:
        for run in compare_configs(suite, cfg, replace(cfg, min_confidence=0.85)):
            run.overall.show(truncate=False)
    run = run_gate(suite, cfg, limits, repeats=5)
    run.per_scope.select("scope", "matched", "conflicts", "recall", F.round("false_match_rate", 4).alias("fmr"), "passed").orderBy("scope").show(100, truncate=False)
    if args.json:
        with open(args.json, "w") as f:
            json.dump(report(run, cfg, limits, args.seed, args.generated), f, indent=2)
    return 0 if run.passed else 1


if __name__ == "__main__":
    sys.exit(main())
