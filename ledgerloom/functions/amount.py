"""Money in minor units: tolerances, bands and formatting."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import MatchConfig


def _ratio(diff: Column, larger: Column) -> Column:
    return F.try_divide(diff.cast("double"), larger.cast("double"))


def within_tolerance(a: Column, b: Column, abs_tol: int, rel_tol: Column) -> Column:
    """The larger amount keeps its sign, so two negative amounts always pass."""
    diff, larger = F.abs(a - b), F.greatest(a, b)
    return (diff <= abs_tol) | F.when(larger == 0, diff == 0).otherwise(_ratio(diff, larger) <= rel_tol)


def loose_relative(mcc: Column, cfg: MatchConfig) -> Column:
    """Relative tolerance of candidates; fuel pumps authorise more than they charge."""
    return F.greatest(F.lit(cfg.loose_rel), F.when(mcc == "5541", cfg.bands.fuel_rel).otherwise(0.0))


def amount_bucket(amount: Column, cfg: MatchConfig) -> Column:
    return F.floor(F.abs(amount) / cfg.bucket_minor) * F.signum(amount).cast("bigint")


def bucket_matches(txn: Column, slip: Column, rel: Column, cfg: MatchConfig) -> Column:
    """Buckets may differ by a span that the transaction's amount allows."""
    fixed = cfg.loose_abs // cfg.bucket_minor + 1
    moving = F.floor(F.abs(txn * rel / cfg.bucket_minor)).cast("bigint") * F.signum(txn).cast("bigint") + 1
    return F.abs(amount_bucket(txn, cfg) - amount_bucket(slip, cfg)) <= F.greatest(F.lit(fixed), moving)


def amount_cell(amount: Column, cfg: MatchConfig) -> Column:
    """Cells of amounts, rising with them: refunds as wide as a bucket, then as wide as the absolute tolerance, then five per cent."""
    knee = round(cfg.loose_abs / cfg.loose_rel)
    small = -(-knee // cfg.loose_abs)
    large = F.floor(F.log(F.greatest(amount, F.lit(1)) / F.lit(float(knee))) / math.log(1.05))
    return F.when(amount < 0, F.floor(amount / cfg.bucket_minor)).when(amount < knee, F.floor(amount / cfg.loose_abs)).otherwise(small + large).cast("int")


def amount_range(amount: Column, rel: Column, cfg: MatchConfig) -> tuple[Column, Column]:
    """The amounts that may be within tolerance of this one; two refunds are as long as their buckets touch."""
    slack = F.lit(cfg.loose_abs + 1)
    low = F.when(amount < 0, amount - 2 * cfg.bucket_minor).otherwise(amount - F.greatest(slack, F.ceil(amount * rel) + 1))
    high = F.when(amount < 0, amount + 2 * cfg.bucket_minor).otherwise(amount + F.greatest(slack, F.ceil(amount * rel / (1 - rel)) + 1))
    return low, high


def _decay(diff: Column, abs_tol: float, rel: float, larger: Column, depth: float) -> Column:
    most = F.greatest(F.lit(float(abs_tol)), F.lit(rel) * larger)
    return F.when(most == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - diff / most * depth))


def amount_similarity(txn: Column, slip: Column, txn_currency: Column, slip_currency: Column, cfg: MatchConfig) -> Column:
    """Ordered bands: equal, tip, partial capture, rounding, cashback, plain tolerance."""
    b = cfg.bands
    diff, larger = F.abs(txn - slip), F.greatest(txn, slip)
    ratio = _ratio(diff, larger)
    tip = (slip <= txn) & ((diff <= b.tip_abs) | (ratio <= b.tip_rel))
    # a fuel allowance above the partial one raises the limit of partial captures
    most_partial = F.greatest(F.lit(b.partial_abs), (F.lit(max(b.partial_rel, b.fuel_rel)) * larger).cast("bigint"))
    partial = (txn >= slip) & (diff <= most_partial)
    partial_score = F.greatest(F.lit(0.0), 1 - diff / F.greatest(most_partial.cast("double"), F.lit(b.partial_rel) * larger) * 0.2)
    return (
        F.when(txn_currency != slip_currency, 0.0)
        .when(txn == slip, 1.0)
        .when(larger == 0, 1.0)
        .when(tip, _decay(diff, b.tip_abs, b.tip_rel, larger, 0.2))
        .when(partial, partial_score)
        .when(diff <= b.fx_rounding, 0.95)
        .when((slip > txn) & (diff <= b.cashback_abs), _decay(diff, b.cashback_abs, 0.05, larger, 0.2))
        .when((diff <= cfg.abs_tolerance) | (ratio <= cfg.rel_tolerance), _decay(diff, cfg.abs_tolerance, cfg.rel_tolerance, larger, 0.25))
        .otherwise(0.0)
    )


def money_text(amount: Column, currency: Column) -> Column:
    return F.format_string("%s %.2f", currency, amount / 100)


def round_minor(pounds: Column) -> Column:
    """Half away from zero."""
    return F.round(pounds * 100).cast("bigint")


def pounds_to_minor(text: Column) -> Column:
    """Decimal pounds in integer arithmetic; pence are cut to two digits; null if malformed."""
    s = F.regexp_replace(text, r"^\s+|\s+$", "")
    negative = F.startswith(s, F.lit("-"))
    s = F.when(negative, F.regexp_replace(F.substring(s, 2, 1_000_000), r"^\s+|\s+$", "")).otherwise(s)
    shape = r"^[+]?[0-9]*\s*(?:\.[+]?[0-9]*.*)?$"
    whole = F.regexp_replace(F.split_part(s, F.lit("."), F.lit(1)), r"^\s+|\s+$", "")
    cut = F.locate(".", s)
    pence = F.when(cut > 0, F.substr(s, cut + 1)).otherwise(F.lit(""))
    pence2 = F.rpad(F.substring(pence, 1, 2), 2, "0")
    whole_value = F.when(whole == "", F.lit("0")).otherwise(whole)
    ok = s.rlike(shape) & (s != "") & ~((whole == "") & (pence == "")) & whole_value.rlike(r"^[+-]?[0-9]+$") & ((pence == "") | pence2.rlike(r"^[+-]?[0-9]+$"))
    value = whole_value.try_cast("bigint") * 100 + F.when(pence == "", F.lit(0)).otherwise(pence2.try_cast("bigint"))
    return F.when(ok, F.when(negative, -value).otherwise(value))


def matched_minor(text: Column) -> Column:
    """Minor units of a text that a money pattern has matched: digits with two or no decimals."""
    return F.replace(text, F.lit("."), F.lit("")).try_cast("bigint") * F.when(F.contains(text, F.lit(".")), 1).otherwise(100)


def pounds_text(minor: Column) -> Column:
    size = F.abs(minor)
    return F.concat(F.when(minor < 0, "-").otherwise(""), F.floor(size / 100).cast("string"), F.lit("."), F.lpad((size % 100).cast("string"), 2, "0"))


def fuel_net(total: Column) -> Column:
    """Five sixths of a gross fuel total, towards zero."""
    return F.signum(total).cast("bigint") * F.floor(F.abs(total * 5) / 6)


def fifth(net: Column) -> Column:
    """VAT of a net amount at a fifth, towards zero."""
    return F.signum(net).cast("bigint") * F.floor(F.abs(net) / 5)
