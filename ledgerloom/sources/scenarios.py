"""Matching scenarios and blocklists kept as JSON files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scrub import Blocklist

SCHEMA = (
    "name string, transactions array<struct<id:string,merchant:string,mcc:string,amount_minor:bigint,currency:string,occurred_at:string>>, "
    "slips array<struct<id:string,supplier:string,amount_minor:bigint,currency:string,issued_at:string,itemised:boolean,category:string,source:string,transaction_ref:string>>, "
    "labels array<struct<transaction_id:string,slip_id:string>>, expect_match boolean, expect_conflict boolean, expect_precision_min double, expect_fmr_max double"
)


def read_scenarios(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).option("multiLine", True).json(path)


def _offset(text):
    """Seconds east of UTC of an RFC 3339 time."""
    hit = F.regexp_extract(text, r"([+-])(\d\d):(\d\d)$", 1)
    h, m = F.regexp_extract(text, r"[+-](\d\d):\d\d$", 1), F.regexp_extract(text, r"[+-]\d\d:(\d\d)$", 1)
    size = h.try_cast("int") * 3600 + m.try_cast("int") * 60
    return F.when(hit == "-", -size).when(hit == "+", size).otherwise(0)


def scenario_transactions(scenarios: DataFrame) -> DataFrame:
    t = scenarios.select(F.col("name").alias("scope"), F.posexplode("transactions").alias("ordinal", "x"))
    return t.select("scope", F.col("ordinal").cast("bigint"), F.col("x.id").alias("transaction_id"), F.lit("synthetic").alias("source"), "x.merchant", "x.mcc", "x.amount_minor", "x.currency", F.to_timestamp("x.occurred_at").alias("occurred_at"), _offset(F.col("x.occurred_at")).alias("occurred_offset_sec"))


def scenario_slips(scenarios: DataFrame) -> DataFrame:
    """Any source but pos is mail; an itemised slip has one line of its whole total."""
    r = scenarios.select(F.col("name").alias("scope"), F.posexplode("slips").alias("ordinal", "x"))
    return r.select(
        "scope", F.col("ordinal").cast("bigint"), F.col("x.id").alias("slip_id"), F.when(F.col("x.source") == "pos", "pos").otherwise("email").alias("source"), "x.supplier", F.lit("").alias("raw_merchant_hint"),
        F.col("x.amount_minor").alias("total_minor"), "x.currency", F.to_timestamp("x.issued_at").alias("issued_at"), _offset(F.col("x.issued_at")).alias("issued_offset_sec"), "x.category", F.coalesce("x.transaction_ref", F.lit("")).alias("transaction_ref"),
        F.when(F.coalesce("x.itemised", F.lit(False)), 1).otherwise(0).alias("n_lines"),
    )


def scenario_labels(scenarios: DataFrame) -> DataFrame:
    x = scenarios.select(F.col("name").alias("scope"), F.posexplode("labels").alias("ordinal", "x"))
    return x.select("scope", F.col("ordinal").cast("bigint"), "x.transaction_id", "x.slip_id")


def load_blocklist(path: str) -> Blocklist:
    """A missing file is an empty list."""
    try:
        with open(path) as f:
            raw = json.load(f)
    except FileNotFoundError:
        return Blocklist()
    return Blocklist(tuple(raw.get("email_local_parts") or ()), tuple(raw.get("area_names") or ()), tuple(raw.get("literal_names") or ()))
