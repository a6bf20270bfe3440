"""The ingestion gate: classify and extract the labelled corpus, judge, write a report.

    python -m ledgerloom.plans.smoke --json report.json
"""

from __future__ import annotations

import argparse
import sys
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SmokeThresholds
from ..functions.classify import RULES
from ..operators.corpus_metrics import classifier_counts, smoke_reasons, stratum_accuracy
from ..operators.extraction import REGISTRY_VERSION
from ..sources.sinks import write_json
from ..synth.corpus import corpus_fingerprint, labelled_corpus
from ..workspace import settle, ship_package
from .ingest import ingest


def run_smoke(corpus: DataFrame, limits: SmokeThresholds | None = None) -> dict:
    corpus = settle(corpus)
    done = ingest(corpus)
    rows = done.classified.select("kind", "label", "stratum")
    metrics = classifier_counts(rows).first().asDict()
    pending = done.extracted.join(corpus.where("label = 'purchase_receipt'").select(F.col("message_id").alias("source_message_id")), "source_message_id").where("grade = 'requires_ocr'").count()
    reasons = smoke_reasons(metrics, limits or SmokeThresholds())
    return {
        "timestamp": datetime.now(timezone.utc).isoformat(), "corpus_size": corpus.count(), "corpus_hash": corpus_fingerprint(corpus).first()[0], "ruleset": RULES, "registry": REGISTRY_VERSION, **metrics,
        "stratum_accuracy": {r["stratum"]: r["accuracy"] for r in stratum_accuracy(rows).orderBy("stratum").collect()}, "requires_ocr": pending, "passed": not reasons, "failure_reasons": reasons,
    }


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Judge classification and extraction on the labelled corpus.")
    parser.add_argument("--json", default="")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    ship_package(spark)
    result = run_smoke(labelled_corpus(spark))
    if args.json:
        write_json(args.json, result)
    for k, v in result.items():
        print(f"{k}\t{v}")
    return 0 if result["passed"] else 1


if __name__ == "__main__":
    sys.exit(main())
