"""The whole matcher: exact references, candidates, resolution, leftovers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import MatchConfig
from ..functions.merchant import containment_resolver, default_resolver
from ..operators.assignment import MatchResult, conflict_rows, greedy_one_to_one, left_over, set_aside
from ..operators.candidates import exact_references, leave_out, scored_candidates, signal_map
from ..workspace import settle

_TXN = {"scope": "string", "ordinal": "bigint", "transaction_id": "string", "source": "string", "merchant": "string", "mcc": "string", "amount_minor": "bigint", "currency": "string", "occurred_at": "timestamp", "external_ref": "string"}
_SLIP = {"scope": "string", "ordinal": "bigint", "slip_id": "string", "source": "string", "supplier": "string", "raw_merchant_hint": "string", "total_minor": "bigint", "currency": "string", "issued_at": "timestamp", "transaction_ref": "string"}


def _shaped(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The columns the matcher reads; those missing are null, a missing scope is ''."""
    have = set(rows.columns)
    out = []
    for c, kind in columns.items():
        if c in have:
            out.append(F.col(c).cast(kind).alias(c))
        else:
            out.append(F.lit("" if c == "scope" else None).cast(kind).alias(c))
    return rows.select(*out)


def match(txns: DataFrame, slips: DataFrame, cfg: MatchConfig | None = None, resolver=default_resolver) -> MatchResult:
    """Every record ends matched, in conflict or unmatched.

    Ids are unique within a ``scope``, a column that keeps separate datasets apart
    and may be absent.
    """
    cfg = cfg or MatchConfig()
    t, r = _shaped(txns, _TXN), _shaped(slips, _SLIP)
    exact = settle(exact_references(t, r))
    rest_t, rest_r = leave_out(t, exact, "transaction_id"), leave_out(r, exact, "slip_id")
    if resolver is containment_resolver:
        whole = settle(scored_candidates(rest_t, rest_r, cfg, resolver))
        strong = whole.where(F.col("confidence") >= cfg.min_confidence)
        aside = set_aside(strong, lambda _: whole, cfg)
        free = left_over(strong, *aside)
    else:
        # where names may be alike candidates are many: what comes first is kept for conflicts, and only what conflicts leave for assignment
        tops = scored_candidates(rest_t, rest_r, cfg, resolver, cfg.min_confidence, tops=True).drop("temporal_signal", "mcc_signal")
        aside = set_aside(settle(tops), lambda ids: scored_candidates(rest_t.join(ids, ["scope", "transaction_id"], "left_semi"), rest_r, cfg, resolver), cfg)
        free = scored_candidates(leave_out(rest_t, aside[0], "transaction_id"), leave_out(rest_r, aside[1], "slip_id"), cfg, resolver, cfg.min_confidence)
    chosen = greedy_one_to_one(free)

    def conflicts() -> DataFrame:
        return conflict_rows(scored_candidates(rest_t, rest_r, cfg, resolver), *aside)

    sure = exact.select("scope", "transaction_id", "slip_id", F.lit(1.0).alias("confidence"), F.lit("exact_ref").alias("method"), F.create_map(F.lit("exact_ref"), F.lit(1.0)).alias("signals"))
    scored = chosen.select("scope", "transaction_id", "slip_id", "confidence", F.lit("scored").alias("method"), signal_map().alias("signals"))
    matches = sure.unionByName(scored).withColumn("outcome", F.lit("matched"))
    gone = lambda aside, key: matches.select("scope", key).unionByName(aside.select("scope", key))
    return MatchResult(
        matches,
        conflicts,
        leave_out(t, gone(aside[0], "transaction_id"), "transaction_id").select("scope", "ordinal", "transaction_id"),
        leave_out(r, gone(aside[1], "slip_id"), "slip_id").select("scope", "ordinal", "slip_id"),
    )


def outcomes(result: MatchResult, txns: DataFrame, slips: DataFrame) -> DataFrame:
    """(scope, side, id, outcome) of every record; conflict outranks matched outranks unmatched."""
    m = result.matches
    seen = (
        m.select("scope", F.lit("transaction").alias("side"), F.col("transaction_id").alias("id"), F.lit(1).alias("rank"))
        .unionByName(m.select("scope", F.lit("slip").alias("side"), F.col("slip_id").alias("id"), F.lit(1).alias("rank")))
        .unionByName(result.conflicts.select("scope", "side", "id", F.lit(2).alias("rank")))
        .unionByName(result.unmatched_transactions.select("scope", F.lit("transaction").alias("side"), F.col("transaction_id").alias("id"), F.lit(0).alias("rank")))
        .unionByName(result.unmatched_receipts.select("scope", F.lit("slip").alias("side"), F.col("slip_id").alias("id"), F.lit(0).alias("rank")))
    )
    word = F.element_at(F.array(F.lit("unmatched"), F.lit("matched"), F.lit("conflict")), F.col("rank") + 1)
    return seen.groupBy("scope", "side", "id").agg(F.max("rank").alias("rank")).select("scope", "side", "id", word.alias("outcome"))
