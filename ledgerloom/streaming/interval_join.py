"""Candidates as a stream: transactions and slips joined within the time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import MatchConfig
from ..functions import amount as A
from ..plans.matcher import match


def streaming_candidates(txns: DataFrame, slips: DataFrame, cfg: MatchConfig | None = None, late: str = "1 day") -> DataFrame:
    """Stream-stream interval join; state is dropped once the watermark passes the window.

    Both sides need event times; amounts are compared as in the batch form, merchants
    are left to the consumer (see ``assign_batch``).
    """
    cfg = cfg or MatchConfig()
    lead, lag = cfg.max_lead_us // 1_000_000, cfg.max_lag_us // 1_000_000
    t = txns.withWatermark("occurred_at", late).alias("t")
    r = slips.withWatermark("issued_at", late).alias("r")
    window = f"r.issued_at >= t.occurred_at - interval {lead} seconds and r.issued_at <= t.occurred_at + interval {lag} seconds"
    rel = A.loose_relative(F.col("t.mcc"), cfg)
    a, b = F.col("t.amount_minor"), F.col("r.total_minor")
    pairs = t.join(r, F.expr(f"t.currency = r.currency and {window}"))
    return pairs.where(A.within_tolerance(a, b, cfg.loose_abs, rel) & A.bucket_matches(a, b, rel, cfg)).select("t.transaction_id", "r.slip_id", "t.occurred_at", "r.issued_at", "t.amount_minor", "r.total_minor")


def assign_batch(write, cfg: MatchConfig | None = None):
    """For ``foreachBatch``: ``write(matches, batch_id)`` with the matches of the records seen in a micro-batch.

    Each batch holds records of both sides, told apart by ``side``; the one-to-one
    choice is not incremental and is taken per batch.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        t = batch.where("side = 'transaction'").select("ordinal", F.col("id").alias("transaction_id"), F.col("name").alias("merchant"), "mcc", F.col("amount").alias("amount_minor"), "currency", F.col("at").alias("occurred_at"))
        r = batch.where("side = 'slip'").select("ordinal", F.col("id").alias("slip_id"), F.lit("email").alias("source"), F.col("name").alias("supplier"), F.col("amount").alias("total_minor"), "currency", F.col("at").alias("issued_at"))
        write(match(t, r, cfg).matches, batch_id)

    return run
