"""Purchase families: several documents of one purchase become one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grade import GRADE_RANK, KIND_RANK, rank
from ..functions.text import fingerprint


def _grouped(extracted: DataFrame) -> DataFrame:
    family = F.when(F.coalesce("family_key", F.lit("")) != "", F.col("family_key")).otherwise(F.concat(F.lit("singleton:"), F.coalesce("source_message_id", F.lit(""))))
    return extracted.drop("merged_from", "decision").withColumn("family", family)


def family_flags(grouped: DataFrame) -> DataFrame:
    """One row of decisions per family, by a plain aggregation."""
    credit = F.coalesce(F.col("kind") == "credit_note", F.lit(False))
    ref = F.coalesce("order_ref", F.lit(""))
    print_ = fingerprint(F.col("supplier"), F.col("issued_at"), F.col("issued_offset_sec"), F.col("total_minor"))
    facts = grouped.groupBy("family").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~credit).alias("n_purchase"),
        F.count_if(~credit & (ref != "")).alias("n_ref"), F.min(F.when(~credit, print_)).alias("first_print"), F.max(F.when(~credit, print_)).alias("last_print"),
        F.count_if(~credit & F.contains(ref, F.lit("-SHIP-"))).alias("n_ship"), F.min(F.when(~credit, F.coalesce("source_message_id", F.lit("")))).alias("first_msg"), F.max(F.when(~credit, F.coalesce("source_message_id", F.lit("")))).alias("last_msg"),
    )
    unclear = (F.col("n_purchase") >= 2) & (F.col("n_ref") == 0) & (F.col("first_print") == F.col("last_print"))
    one_mail = (F.col("first_msg") == F.col("last_msg")) & (F.col("n_purchase") > 1)
    decision = (
        F.when(F.col("n") == 1, "single").when(F.col("n_purchase") == 0, "credits").when(unclear, "ambiguous")
        .when(F.col("n_ship") >= 2, "shipments").when(one_mail, "forwarded").otherwise("best")
    )
    return facts.select("family", decision.alias("decision"))


def resolve_families(extracted: DataFrame) -> DataFrame:
    """Surviving rows with ``merged_from``, the mails that a winner stands for.

    Families whose documents can't be told apart, or are separate shipments, stay
    whole; else the best purchase document wins: by kind, then grade, then input
    order.  Credit notes stay beside it unless all purchases are one mail.
    """
    grouped = _grouped(extracted).join(family_flags(_grouped(extracted)), "family")
    credit = F.coalesce(F.col("kind") == "credit_note", F.lit(False))
    order = [rank(F.col("kind"), KIND_RANK, 0).desc(), rank(F.col("grade"), GRADE_RANK, 1).desc(), F.col("ordinal").asc()]
    contest = F.col("decision").isin("forwarded", "best")
    best = grouped.where(contest & ~credit).withColumn("__n", F.row_number().over(Window.partitionBy("family").orderBy(*order))).where("__n = 1").drop("__n")
    rivals = grouped.where(contest & ~credit).select("family", F.col("source_message_id").alias("m"))
    merged = best.select("family", "source_message_id").join(rivals, "family").where("m <> source_message_id").groupBy("family").agg(F.array_sort(F.collect_list("m")).alias("merged_from"))
    winners = best.join(merged, "family", "left")
    kept = grouped.where(~contest | (credit & (F.col("decision") == "best"))).withColumn("merged_from", F.lit(None).cast("array<string>"))
    return winners.unionByName(kept).withColumn("merged_from", F.coalesce("merged_from", F.array().cast("array<string>")))


def canonical_slips(resolved: DataFrame) -> DataFrame:
    """Slips the matcher takes; rows without supplier or positive total are left out."""
    rows = resolved.where("supplier <> '' and total_minor > 0")
    rid = F.when(F.coalesce("source_message_id", F.lit("")) != "", F.col("source_message_id")).otherwise(F.col("family_key"))
    return rows.select(
        "ordinal", rid.alias("slip_id"), F.lit("email").alias("source"), "supplier", F.lit("").alias("raw_merchant_hint"), "total_minor", "currency", "issued_at", "issued_offset_sec",
        F.when(F.coalesce("order_ref", F.lit("")) != "", F.col("order_ref")).otherwise(rid).alias("external_ref"), F.lit("").alias("transaction_ref"),
        F.when(F.coalesce("category", F.lit("")) != "", F.col("category")).otherwise("uncategorised").alias("category"), "line_items", F.size("line_items").alias("n_lines"),
    )
