"""Candidate pairs of transactions and slips.

Slips that name their transaction outright are paired first.  For the others a
range condition on time and a band condition on amounts are turned into one
equi-join: a transaction is copied to the time blocks and the amount cells that its
windows touch, a slip stays in one of each, so no pair arises twice and the
exact conditions are left as residuals of a hash-partitioned join.  A block is as
long as the window, so a transaction is in two, and a cell as wide as the tolerance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import MatchConfig
from ..functions import amount as A
from ..functions import merchant as M
from ..functions import temporal as T
from . import meeting


def one_row_each(rows: DataFrame, key: str, order: str = "ordinal") -> DataFrame:
    """The first row of each id; the matcher takes ids as unique."""
    first = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("__first", F.row_number().over(first)).where("__first = 1").drop("__first")


def exact_references(txns: DataFrame, slips: DataFrame) -> DataFrame:
    """(transaction_id, slip_id) of till slips that name a transaction.

    The reference may be a transaction's external reference or its id; of several
    transactions the one that came first in the input is taken.  Two slips may
    name one transaction.
    """
    named = slips.where("source = 'pos' and transaction_ref <> ''").select("scope", "slip_id", "transaction_ref", F.col("ordinal").alias("r_ordinal"))
    by_ref = txns.where("external_ref <> ''").select("scope", F.col("external_ref").alias("transaction_ref"), "transaction_id", "ordinal")
    by_id = txns.select("scope", F.col("transaction_id").alias("transaction_ref"), "transaction_id", "ordinal")
    hits = named.join(by_ref, ["scope", "transaction_ref"]).unionByName(named.join(by_id, ["scope", "transaction_ref"]))
    return hits.groupBy("scope", "slip_id").agg(F.min_by("transaction_id", "ordinal").alias("transaction_id"), F.min("r_ordinal").alias("r_ordinal"))


def leave_out(rows: DataFrame, taken: DataFrame, key: str) -> DataFrame:
    """Rows whose id was not taken by an earlier phase."""
    return rows.join(taken.select("scope", key).distinct(), ["scope", key], "left_anti")


def candidate_pairs(txns: DataFrame, slips: DataFrame, cfg: MatchConfig) -> DataFrame:
    """Pairs of equal scope and currency within the time window, tolerance and bucket span."""
    t = txns.select("scope", "currency", "transaction_id", "merchant", "mcc", "amount_minor", "occurred_at").where("occurred_at is not null and amount_minor is not null")
    r = slips.select("scope", "currency", "slip_id", F.col("source").alias("slip_source"), "supplier", "raw_merchant_hint", "total_minor", "issued_at").where("issued_at is not null and total_minor is not null")
    at = F.unix_micros("occurred_at")
    length = cfg.max_lead_us + cfg.max_lag_us
    rel = A.loose_relative(F.col("mcc"), cfg)
    low, high = A.amount_range(F.col("amount_minor"), rel, cfg)
    block = lambda micros: F.floor(micros / F.lit(length))
    t = t.withColumn("block", F.explode(F.sequence(block(at - cfg.max_lead_us), block(at + cfg.max_lag_us)))).withColumn("cell", F.explode(F.sequence(A.amount_cell(low, cfg), A.amount_cell(high, cfg))))
    r = r.withColumn("block", block(F.unix_micros("issued_at"))).withColumn("cell", A.amount_cell(F.col("total_minor"), cfg))
    pairs = t.join(r, ["scope", "currency", "block", "cell"])
    near = pairs.where(
        T.within_window(F.col("occurred_at"), F.col("issued_at"), cfg)
        & A.within_tolerance(F.col("amount_minor"), F.col("total_minor"), cfg.loose_abs, rel)
        & A.bucket_matches(F.col("amount_minor"), F.col("total_minor"), rel, cfg)
    ).drop("block", "cell")
    # coalescing to more partitions than there are only ends the join's generated method, which with the scores in it would be too long to be compiled
    return near.coalesce(1_000_000)


def scored_candidates(txns: DataFrame, slips: DataFrame, cfg: MatchConfig, resolver=M.default_resolver, least: float = 0.0, tops: bool = False) -> DataFrame:
    """Candidates above the merchant floor with their signals and a confidence of at least ``least``; with ``tops`` those will do that come first or second at either end."""
    if resolver is M.default_resolver or (resolver is M.containment_resolver and 0 < cfg.min_merchant <= M.CONTAINED):
        return meeting.scored(txns, slips, cfg, resolver is M.containment_resolver, least, tops)
    pairs = M.with_merchant_score(candidate_pairs(txns, slips, cfg), resolver, "merchant_signal")
    if cfg.min_merchant > 0:
        pairs = pairs.where(F.col("merchant_signal") >= cfg.min_merchant)
    amount = A.amount_similarity(F.col("amount_minor"), F.col("total_minor"), F.col("currency"), F.col("currency"), cfg)
    signals = pairs.select(
        "scope", "transaction_id", "slip_id", "slip_source", amount.alias("amount_signal"),
        T.temporal_similarity(F.col("occurred_at"), F.col("issued_at"), cfg).alias("temporal_signal"),
        T.delta_seconds(F.col("occurred_at"), F.col("issued_at")).alias("delta_sec"), "merchant_signal",
        M.mcc_corroboration(F.col("mcc"), F.col("supplier"), F.col("raw_merchant_hint")).alias("mcc_signal"),
    )
    return signals.withColumn("confidence", confidence(cfg)).where((F.col("confidence") > 0) & (F.col("confidence") >= least)).drop("slip_source")


def confidence(cfg: MatchConfig) -> Column:
    """Weighted sum in a fixed order, boosted by source and capped at one."""
    total = (
        F.lit(cfg.weight_amount) * F.col("amount_signal") + F.lit(cfg.weight_temporal) * F.col("temporal_signal")
        + F.lit(cfg.weight_merchant) * F.col("merchant_signal") + F.lit(cfg.weight_mcc) * F.col("mcc_signal")
    )
    boost = F.lit(1.0)
    for source, factor in cfg.source_boost:
        if factor > 0 and factor != 1:
            boost = F.when(F.col("slip_source") == source, factor).otherwise(boost)
    return F.least(F.lit(1.0), total * boost)


def signal_map() -> Column:
    return F.map_from_arrays(F.array(*[F.lit(x) for x in ("amount", "temporal", "temporal_delta_secs", "merchant", "mcc")]), F.array("amount_signal", "temporal_signal", "delta_sec", "merchant_signal", "mcc_signal"))
