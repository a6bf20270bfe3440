"""From scored candidates to matches, conflicts and what is left over."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import MatchConfig
from ..workspace import settle

TXN_REASON = "ambiguous transaction candidates within margin"
SLIP_REASON = "ambiguous receipt candidates within margin"
#: Rounds that are run before a table is written, from the first table on; the last number goes on.
ROUNDS_A_TABLE = (1, 2, 4)


def rank_order() -> list[Column]:
    """Total order of candidates: confidence, then ids."""
    return [F.col("confidence").desc(), F.col("transaction_id").asc(), F.col("slip_id").asc()]


def distinguishable(cfg: MatchConfig, a: str, b: str) -> Column:
    """Two candidates differ enough on a primary signal to be told apart."""
    differ = lambda name, most: F.abs(F.col(f"{a}.{name}") - F.col(f"{b}.{name}")) > most
    return differ("amount_signal", cfg.distinguish_amount) | differ("merchant_signal", cfg.distinguish_merchant) | differ("delta_sec", cfg.distinguish_temporal_sec)


def ambiguous_keys(scored: DataFrame, key: str, cfg: MatchConfig) -> DataFrame:
    """Ids whose two best candidates lie within the margin and can't be told apart.

    Only the two first of each key are ever needed, so the rank filter also runs
    before the shuffle.
    """
    order = Window.partitionBy("scope", key).orderBy(*rank_order())
    top = scored.where(F.col("confidence") >= cfg.min_confidence).withColumn("__n", F.row_number().over(order)).where("__n <= 2")
    row = F.struct("confidence", "amount_signal", "merchant_signal", "delta_sec")
    pair = top.groupBy("scope", key).agg(F.max(F.when(F.col("__n") == 1, row)).alias("a"), F.max(F.when(F.col("__n") == 2, row)).alias("b"))
    return pair.where("b is not null").where((F.col("a.confidence") - F.col("b.confidence") <= cfg.ambiguity_margin) & ~distinguishable(cfg, "a", "b")).select("scope", key)


def widened_slips(scored: DataFrame, txns: DataFrame, slips: DataFrame) -> DataFrame:
    """Ambiguous slips and all slips of ambiguous transactions with two or more."""
    tied = scored.join(txns, ["scope", "transaction_id"]).select("scope", "transaction_id", "slip_id").distinct()
    crowded = tied.groupBy("scope", "transaction_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("scope", "transaction_id")
    more = tied.join(crowded, ["scope", "transaction_id"]).select("scope", "slip_id")
    return slips.unionByName(more).distinct()


def conflict_rows(scored: DataFrame, txns: DataFrame, slips: DataFrame) -> DataFrame:
    """(scope, side, id, competing, top_confidence, reason); competing lists all scored candidates."""

    def side(name: str, ids: DataFrame, key: str, other: str, reason: str) -> DataFrame:
        mine = scored.join(ids, ["scope", key])
        rivals = F.array_sort(F.collect_list(F.struct(F.col(other).alias("id"), "confidence")))
        rows = mine.groupBy("scope", key).agg(rivals.alias("competing"), F.max("confidence").alias("top_confidence"))
        return rows.select("scope", F.lit(name).alias("side"), F.col(key).alias("id"), "competing", "top_confidence", F.lit(reason).alias("reason"))

    return side("transaction", txns, "transaction_id", "slip_id", TXN_REASON).unionByName(side("slip", slips, "slip_id", "transaction_id", SLIP_REASON))


OPEN, CHOSEN, TOLD = 0, 1, 2


def _mutual_bests(edges: DataFrame) -> DataFrame:
    """One round: edges that rank first at both ends become chosen, those that share an end with a chosen one go.

    Two exchanges: at the transactions the losers to chosen edges go and the rest are
    ranked, at the slips the first of both ranks are chosen and their rivals go.
    """
    at_t, at_s = Window.partitionBy("scope", "transaction_id"), Window.partitionBy("scope", "slip_id")
    is_open = F.col("state") == OPEN
    rows = edges.withColumn("taken", F.max("state").over(at_t)).where(~is_open | (F.col("taken") == OPEN))
    rows = rows.withColumn("rank_t", F.row_number().over(at_t.orderBy("state", *rank_order())))
    rows = rows.withColumn("rank_s", F.row_number().over(at_s.orderBy("state", *rank_order())))
    rows = rows.withColumn("state", F.when(is_open & (F.col("rank_t") == 1) & (F.col("rank_s") == 1), CHOSEN).otherwise(F.col("state")))
    return rows.withColumn("taken", F.max("state").over(at_s)).where((F.col("state") != OPEN) | (F.col("taken") == OPEN)).drop("taken", "rank_t", "rank_s")


def greedy_one_to_one(candidates: DataFrame) -> DataFrame:
    """The greedy one-to-one choice by rank, in rounds of mutual bests.

    An edge that ranks first at both ends is in the greedy result whatever else
    happens; taking all such edges at once and removing their ends repeats until
    none is left.  Because the order is total the result equals the sequential
    walk.  Each round chooses at least the best edge of every component, so the
    rounds end, usually soon; a strict chain of preferences takes one per link.
    """
    parts: list[DataFrame] = []
    now = candidates.withColumn("state", F.lit(OPEN))
    while True:
        for _ in range(ROUNDS_A_TABLE[min(len(parts), len(ROUNDS_A_TABLE) - 1)]):
            now = _mutual_bests(now)
        now = settle(now)
        parts.append(now.where(F.col("state") == CHOSEN).drop("state"))
        if now.where(F.col("state") == OPEN).isEmpty():
            break
        # what was chosen takes part once more, to tell its transaction's other edges
        now = now.where(F.col("state") != TOLD).withColumn("state", F.when(F.col("state") == CHOSEN, TOLD).otherwise(OPEN))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


class MatchResult:
    """What match gives; the rows of conflicts are only worked out when they are asked for."""

    def __init__(self, matches: DataFrame, conflicts: Callable[[], DataFrame], unmatched_transactions: DataFrame, unmatched_receipts: DataFrame):
        self.matches, self.unmatched_transactions, self.unmatched_receipts = matches, unmatched_transactions, unmatched_receipts
        self._conflicts = conflicts

    @cached_property
    def conflicts(self) -> DataFrame:
        return settle(self._conflicts())

    def matched_only(self) -> DataFrame:
        return self.matches.where("outcome = 'matched'")


def set_aside(tops: DataFrame, competing: Callable[[DataFrame], DataFrame], cfg: MatchConfig) -> tuple[DataFrame, DataFrame]:
    """Transactions and slips in conflict.

    ``tops`` has at least the two first candidates of every id, and ``competing``
    gives all candidates of ambiguous transactions.
    """
    txns = settle(ambiguous_keys(tops, "transaction_id", cfg))
    slips = settle(widened_slips(competing(txns), txns, ambiguous_keys(tops, "slip_id", cfg)))
    tops.sparkSession._jvm.System.gc()  # shuffle files of what is settled go with the driver's garbage
    return txns, slips


def left_over(strong: DataFrame, txns: DataFrame, slips: DataFrame) -> DataFrame:
    """Candidates without those in conflict."""
    return strong.join(txns, ["scope", "transaction_id"], "left_anti").join(slips, ["scope", "slip_id"], "left_anti")


def assigned(scored: DataFrame, cfg: MatchConfig) -> DataFrame:
    """Matches of scored candidates; conflicts are set aside before assignment."""
    scored = settle(scored)
    strong = scored.where(F.col("confidence") >= cfg.min_confidence)
    return greedy_one_to_one(left_over(strong, *set_aside(strong, lambda _: scored, cfg)))


def conflicting(scored: DataFrame, cfg: MatchConfig) -> DataFrame:
    """Conflicts of scored candidates; nothing is assigned for them."""
    scored = settle(scored)
    return conflict_rows(scored, *set_aside(scored.where(F.col("confidence") >= cfg.min_confidence), lambda _: scored, cfg))
