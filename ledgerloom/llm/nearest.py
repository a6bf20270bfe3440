"""Pairing records with the nearest one in time for the same entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOLERANCE_SEC = 15 * 60
#: Width of a time block in multiples of the tolerance.
BLOCK_TOLERANCES = 8


def nearest_in_time(left: DataFrame, right: DataFrame, tolerance_sec: int = TOLERANCE_SEC) -> DataFrame:
    """(left_id, right_id, gap_micros) for left rows with a right row within tolerance.

    ``left`` has (entity, left_id, at), ``right`` (entity, right_id, at), both in
    microseconds.  Both tables are united, sorted per entity and time, and the last
    and the next right row are carried onto every left row.  So that an entity with
    a third of all rows is no single group, time is cut into blocks several
    tolerances wide and right rows within one tolerance of a border also stand in
    the block beyond it; a left row stands in one block only and sees there all
    that it can reach.  Equally near: the earlier, then the smaller right_id.
    Rows with a null entity or time pair with nothing; repeated rows give one row.
    """
    tol = tolerance_sec * 1_000_000
    width = tol * BLOCK_TOLERANCES
    block = lambda at: F.floor(at / F.lit(width))
    # of right rows at one instant only the smallest id can ever be chosen
    r = right.where("entity is not null and at is not null and right_id is not null").groupBy("entity", "at").agg(F.min("right_id").alias("right_id"))
    at = F.col("at")
    r = r.select("entity", "at", F.explode(F.array_distinct(F.array(block(at - tol), block(at), block(at + tol)))).alias("block"), F.lit(None).cast("string").alias("left_id"), "right_id", F.lit(0).alias("side"))
    l = left.where("entity is not null and at is not null and left_id is not null").select("entity", "at", block(at).alias("block"), "left_id", F.lit(None).cast("string").alias("right_id"), F.lit(1).alias("side")).distinct()  # noqa: E741
    both = r.unionByName(l)
    seen = F.when(F.col("side") == 0, F.struct("at", "right_id"))
    up = Window.partitionBy("entity", "block").orderBy("at", "side")
    # descending order instead of a frame that looks ahead: such a frame is computed anew for every row
    down = Window.partitionBy("entity", "block").orderBy(F.col("at").desc(), "side")
    frame = (Window.unboundedPreceding, Window.currentRow)
    carried = both.select(
        "left_id", "at", "side",
        F.last(seen, ignorenulls=True).over(up.rowsBetween(*frame)).alias("before"),
        F.last(seen, ignorenulls=True).over(down.rowsBetween(*frame)).alias("after"),
    ).where("side = 1")
    far = F.lit(2**62)
    back = F.coalesce(F.col("at") - F.col("before.at"), far)
    ahead = F.coalesce(F.col("after.at") - F.col("at"), far)
    chosen = carried.select("left_id", F.when(back <= ahead, F.col("before.right_id")).otherwise(F.col("after.right_id")).alias("right_id"), F.least(back, ahead).alias("gap_micros"))
    return chosen.where(F.col("gap_micros") <= tol)


def _terminal(c: Column) -> Column:
    folded = F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.when(folded != "", folded)


def till_slips(bank_txns: DataFrame, slips: DataFrame, tolerance_sec: int = TOLERANCE_SEC) -> DataFrame:
    """(transaction_id, slip_id): the nearest slip at the terminal of each payment.

    A transaction's instant is occurred_at, or settled_at where that is null.  If
    its rows disagree in the instant, each pairs on its own and the nearest stays.
    """
    left = bank_txns.select(_terminal(F.col("terminal_id")).alias("entity"), F.col("transaction_id").alias("left_id"), F.unix_micros(F.coalesce("occurred_at", "settled_at")).alias("at"))
    right = slips.select(_terminal(F.col("terminal_id")).alias("entity"), F.col("slip_id").alias("right_id"), F.unix_micros("issued_at").alias("at"))
    pairs = nearest_in_time(left, right, tolerance_sec)
    return pairs.groupBy(F.col("left_id").alias("transaction_id")).agg(F.min(F.struct("gap_micros", "right_id")).alias("b")).select("transaction_id", F.col("b.right_id").alias("slip_id"))
