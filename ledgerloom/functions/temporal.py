"""Time between a transaction and its slip."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import MatchConfig


def gap_micros(txn_at: Column, slip_at: Column) -> Column:
    return F.unix_micros(slip_at) - F.unix_micros(txn_at)


def within_window(txn_at: Column, slip_at: Column, cfg: MatchConfig) -> Column:
    """A slip may come up to the lead before and up to the lag after; both bounds count."""
    return gap_micros(txn_at, slip_at).between(-cfg.max_lead_us, cfg.max_lag_us)


def temporal_similarity(txn_at: Column, slip_at: Column, cfg: MatchConfig) -> Column:
    gap = gap_micros(txn_at, slip_at)
    window = F.when(gap < 0, cfg.max_lead_us).otherwise(cfg.max_lag_us)
    return F.when(F.abs(gap) > window, 0.0).otherwise(1 - F.abs(gap) / window * cfg.temporal_decay)


def delta_seconds(txn_at: Column, slip_at: Column) -> Column:
    return F.abs(gap_micros(txn_at, slip_at)) / 1e6


def local_date(at: Column, offset_sec: Column) -> Column:
    """Calendar day where the document was written."""
    shifted = F.timestamp_micros(F.unix_micros(at) + F.coalesce(offset_sec, F.lit(0)).cast("bigint") * 1_000_000)
    return F.date_format(shifted, "yyyy-MM-dd")


def stamp(at: Column, offset_sec: Column) -> Column:
    """A UTC instant with the offset it was written in."""
    return F.struct(at.alias("utc"), offset_sec.alias("offset_sec"))
