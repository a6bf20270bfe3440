"""Quality of a match result against labels and expectations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import GateThresholds
from .assignment import MatchResult


def ratio(n: Column, d: Column) -> Column:
    """0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(n.cast("double"), d.cast("double")), F.lit(0.0))


def last_labels(labels: DataFrame) -> DataFrame:
    """One slip per transaction; of several labels the last counts."""
    return labels.groupBy("scope", "transaction_id").agg(F.max_by("slip_id", "ordinal").alias("expected"))


def judged_matches(matches: DataFrame, labels: DataFrame) -> DataFrame:
    """Matches with ``correct``; a match without label counts as false."""
    return matches.join(last_labels(labels), ["scope", "transaction_id"], "left").withColumn("correct", F.coalesce(F.col("expected") == F.col("slip_id"), F.lit(False)))


def violations(expectations: DataFrame, actual: DataFrame) -> DataFrame:
    """Expected outcomes that did not come, with what came instead."""
    got = actual.select("scope", "side", "id", F.col("outcome").alias("got"))
    joined = expectations.join(got, ["scope", "side", "id"], "left").withColumn("got", F.coalesce("got", F.lit("unmatched")))
    return joined.where(F.col("got") != F.col("outcome")).select("scope", "side", "id", F.col("outcome").alias("want"), "got")


def per_scope(result: MatchResult, transactions: DataFrame, slips: DataFrame, labels: DataFrame, expectations: DataFrame, actual: DataFrame, limits: GateThresholds) -> DataFrame:
    """One row of metrics per scenario, with its verdict."""
    count = lambda df, name: df.groupBy("scope").agg(F.count(F.lit(1)).alias(name))
    judged = judged_matches(result.matches, labels).groupBy("scope").agg(F.count(F.lit(1)).alias("matched"), F.count_if("correct").alias("correct"), F.countDistinct("transaction_id").alias("matched_txns"))
    unclear = expectations.where("genuinely_ambiguous").select("scope", "side", "id").distinct().withColumn("meant", F.lit(True))
    conflicts = result.conflicts.select("scope", "side", "id").join(unclear, ["scope", "side", "id"], "left").groupBy("scope").agg(F.count(F.lit(1)).alias("conflicts"), F.count_if("meant").alias("meant"))
    scopes = transactions.select("scope").unionByName(slips.select("scope")).distinct()
    rows = scopes
    for part in (count(transactions, "n_txn"), count(slips, "n_slip"), count(labels, "n_label"), judged, conflicts, count(violations(expectations, actual), "n_violation")):
        rows = rows.join(part, "scope", "left")
    rows = rows.na.fill(0)
    one = lambda c: F.greatest(F.col(c), F.lit(1))
    false = F.col("matched") - F.col("correct")
    rows = rows.select(
        "*", ratio(F.col("correct"), one("matched")).alias("precision"), ratio(F.col("correct"), one("n_label")).alias("recall"), false.alias("false_matches"), ratio(false, one("matched")).alias("false_match_rate"),
        ratio(F.col("matched"), one("n_txn")).alias("match_rate"), ratio(F.col("conflicts"), one("n_txn")).alias("conflict_rate"),
        F.when(F.col("conflicts") == 0, 1.0).otherwise(ratio(F.col("meant"), F.col("conflicts"))).alias("conflict_correctness"),
        (one("n_slip") - F.col("matched")).alias("unmatched_receipts"), (one("n_txn") - F.col("matched_txns")).alias("unmatched_transactions"),
    )
    crowded, hard = F.col("scope").isin(*limits.crowded_classes), F.col("scope").isin(*limits.hard_classes) & (F.col("scope") != "ambiguous")
    fine = (F.col("n_violation") == 0) & (F.col("false_match_rate") <= limits.max_fmr)
    by_class = F.when(crowded, (F.col("false_match_rate") == 0) & (F.col("conflict_correctness") >= limits.min_conflict_correctness)).otherwise(F.col("conflict_rate") <= limits.max_conflict_rate)
    return rows.withColumn("passed", fine & by_class & (~hard | (F.col("recall") >= limits.min_hard_recall)))


def overall(rows: DataFrame) -> DataFrame:
    """All scenarios together; here precision is one minus the rate of false matches."""
    kept = F.floor(F.col("conflict_correctness") * F.col("conflicts"))
    total = rows.agg(*[F.sum(c).alias(c) for c in ("n_txn", "n_label", "matched", "correct", "false_matches", "conflicts")], F.sum(kept).alias("kept"))
    fmr = ratio(F.col("false_matches"), F.col("matched"))
    return total.select(
        "matched", "conflicts", fmr.alias("false_match_rate"), F.when(F.col("matched") > 0, 1 - fmr).otherwise(0.0).alias("precision"), ratio(F.col("correct"), F.col("n_label")).alias("recall"),
        ratio(F.col("conflicts"), F.col("n_txn")).alias("conflict_rate"), F.when(F.col("conflicts") > 0, ratio(F.col("kept"), F.col("conflicts"))).otherwise(1.0).alias("conflict_correctness"), "n_label", "n_txn",
    )


def failure_reasons(total: DataFrame, rows: DataFrame, limits: GateThresholds, deterministic: bool) -> list[str]:
    """In a fixed order; hard classes after the overall checks."""
    t = total.first()
    checks = [
        (t["false_match_rate"] > limits.max_fmr, "FMR exceeds threshold"),
        (t["recall"] < limits.min_recall, "overall recall below threshold"),
        (t["conflict_correctness"] < limits.min_conflict_correctness, "conflict correctness below threshold"),
        (t["conflict_rate"] > limits.max_conflict_rate, "conflict rate exceeds threshold"),
        (not deterministic, "determinism check failed"),
    ]
    weak = rows.where(F.col("scope").isin(*limits.hard_classes) & (F.col("scope") != "ambiguous") & (F.col("recall") < limits.min_hard_recall)).select("scope").orderBy("scope").collect()
    return [text for bad, text in checks if bad] + [f"hard class {r[0]} recall below threshold" for r in weak]


def itemisation(slips: DataFrame, weights: DataFrame) -> DataFrame:
    """Share of cohort weight whose merchant has an itemised slip; 0 without weights."""
    itemised = slips.where("n_lines > 0").select(F.col("supplier").alias("merchant")).distinct()
    covered = weights.join(itemised, "merchant", "left_semi").agg(F.sum("weight").alias("c"))
    whole = weights.agg(F.sum("weight").alias("w"))
    both = covered.withColumn("k", F.lit(0)).join(whole.withColumn("k", F.lit(0)), "k")
    return both.select(ratio(F.coalesce("c", F.lit(0.0)), F.col("w")).alias("rate"))


def category_accuracy(labels: DataFrame, slips: DataFrame) -> DataFrame:
    """Labels (slip_id, expected) against slips; a missing slip counts as wrong."""
    right = labels.join(slips.select("slip_id", "category"), "slip_id", "left")
    return right.agg(ratio(F.count_if(F.col("category") == F.col("expected")), F.count(F.lit(1))).alias("accuracy"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Equal as bags of rows."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
