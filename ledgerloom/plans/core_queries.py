"""Registered queries of the general data-quality operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.instants import normalised_times
from ..operators.redelivery import deliver_once, surplus_deliveries
from ..workspace import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surplus_deliveries(table(spark, sf_dir, "mail_messages"))


def p1_deliver_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = deliver_once(table(spark, sf_dir, "mail_messages"))
    return kept.select("delivery_id", "mailbox_id", "subject", F.length("body_text").alias("text_chars"), F.size("attachments").alias("n_attachments"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalised_times(table(spark, sf_dir, "mail_messages"), table(spark, sf_dir, "bank_feed"), table(spark, sf_dir, "feeds"))


QUERIES = {"p1_found": p1_found, "p1_deliver_once": p1_deliver_once, "p6_found": p6_found}
SQL: dict[str, str] = {}
