"""Registered queries of the training-data operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import table
from . import bpe, linkage, markup, mixing, nearest, pii, spans, survivors


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.same_purchases(table(spark, sf_dir, "bank_txns"), table(spark, sf_dir, "slips")).select("transaction_id", "slip_id")


def p2_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.same_purchases(table(spark, sf_dir, "bank_txns"), table(spark, sf_dir, "slips"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.field_sources(table(spark, sf_dir, "extracted"))


def p3_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.surviving_records(table(spark, sf_dir, "extracted"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.till_slips(table(spark, sf_dir, "bank_txns"), table(spark, sf_dir, "slips"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "mail_messages"), table(spark, sf_dir, "blocklist"))


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redacted(table(spark, sf_dir, "mail_messages"), table(spark, sf_dir, "blocklist"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.structure(table(spark, sf_dir, "mail_messages")).select("delivery_id", "element", "element_text")


def p7_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many elements come from winning containers, and how many by the fallback."""
    return markup.structure(table(spark, sf_dir, "mail_messages")).groupBy("chosen").agg(F.count(F.lit(1)).alias("elements"))


def p7_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.clean_text(table(spark, sf_dir, "mail_messages"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, sf_dir, "documents"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_weights"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = table(spark, sf_dir, "source_weights")
    return mixing.shares(mixing.mixed(table(spark, sf_dir, "documents"), weights), weights)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_characters(table(spark, sf_dir, "documents"))


def p10_without_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.without_shared(table(spark, sf_dir, "documents"))


QUERIES = {"p2_found": p2_found, "p2_confidence": p2_confidence, "p3_found": p3_found, "p3_survivors": p3_survivors, "p4_found": p4_found, "p5_found": p5_found, "p5_redacted": p5_redacted, "p7_found": p7_found, "p7_chosen": p7_chosen, "p7_clean_text": p7_clean_text, "p8_ids": p8_ids, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found, "p10_without_shared": p10_without_shared}
SQL: dict[str, str] = {}

SQL["p4_found"] = """
WITH l AS (SELECT DISTINCT lower(trim(terminal_id)) e, transaction_id, coalesce(occurred_at, settled_at) t
           FROM bank_txns WHERE trim(terminal_id) <> '' AND coalesce(occurred_at, settled_at) IS NOT NULL),
r AS (SELECT DISTINCT lower(trim(terminal_id)) e, slip_id, issued_at t FROM slips WHERE trim(terminal_id) <> '' AND issued_at IS NOT NULL),
p AS (SELECT transaction_id, slip_id, row_number() OVER (PARTITION BY transaction_id
        ORDER BY abs(epoch_us(r.t) - epoch_us(l.t)), r.t, slip_id) n
      FROM l JOIN r ON l.e = r.e AND r.t BETWEEN l.t - INTERVAL 15 MINUTES AND l.t + INTERVAL 15 MINUTES)
SELECT transaction_id, slip_id FROM p WHERE n = 1"""
