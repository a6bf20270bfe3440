"""Quality of classification and extraction against labelled messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SmokeThresholds
from ..functions.classify import is_bearing
from .metrics import ratio


def classifier_counts(rows: DataFrame) -> DataFrame:
    """Exact and bearing precision and recall of rows (kind, label)."""
    right = F.col("kind") == F.col("label")
    said, true = is_bearing(F.col("kind")), is_bearing(F.col("label"))
    c = rows.agg(F.count_if(right).alias("tp"), F.count_if(~right).alias("miss"), F.count_if(said & true).alias("btp"), F.count_if(said & ~true).alias("bfp"), F.count_if(~said & true).alias("bfn"))
    exact = ratio(F.col("tp"), F.col("tp") + F.col("miss"))  # a miss is both a false positive and a false negative
    return c.select(exact.alias("exact_precision"), exact.alias("exact_recall"), ratio(F.col("btp"), F.col("btp") + F.col("bfp")).alias("bearing_precision"), ratio(F.col("btp"), F.col("btp") + F.col("bfn")).alias("bearing_recall"))


def stratum_accuracy(rows: DataFrame) -> DataFrame:
    return rows.groupBy("stratum").agg(F.avg((F.col("kind") == F.col("label")).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def field_accuracy(labels: DataFrame, slips: DataFrame) -> DataFrame:
    """Share of labels (message_id, supplier, total_minor) met; a missing slip is wrong, no labels are 1."""
    got = slips.select(F.col("slip_id").alias("message_id"), F.col("supplier").alias("g_supplier"), F.col("total_minor").alias("g_total"))
    right = labels.join(got, "message_id", "left").select(((F.col("supplier") == F.col("g_supplier")) & (F.col("total_minor") == F.col("g_total"))).alias("ok"))
    return right.agg(F.when(F.count(F.lit(1)) == 0, 1.0).otherwise(ratio(F.count_if("ok"), F.count(F.lit(1)))).alias("accuracy"))


def smoke_reasons(m: dict, limits: SmokeThresholds) -> list[str]:
    checks = [
        (m["exact_precision"] < limits.min_exact_precision, "exact precision below threshold"), (m["exact_recall"] < limits.min_exact_recall, "exact recall below threshold"),
        (m["bearing_precision"] < limits.min_bearing_precision, "bearing precision below threshold"), (m["bearing_recall"] < limits.min_bearing_recall, "bearing recall below threshold"),
    ]
    return [text for bad, text in checks if bad]
