"""Messages delivered more than once: exactly one copy survives.

One aggregation by identifier elects the copy: ``min_by`` over a struct of delivery
time and tie-break.  Spark runs it sorted, as it does for every buffer that holds a
struct.  Partial aggregation comes before the shuffle, so an identifier that holds a
third of all rows arrives as one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .instants import attach_instants


def canonical_message_id(message_id: Column) -> Column:
    """Identifier without outer blanks, angle brackets and Maildir flag suffix."""
    bare = F.regexp_replace(F.trim(message_id), r"^<+|>+$", "")
    bare = F.regexp_replace(bare, r":2,[A-Za-z]*>?$", "")
    return F.trim(F.regexp_replace(bare, r"^<+|>+$", ""))


def elect_copies(rows: DataFrame, identity: list[Column], keep: Column, time: Column, tie: Column) -> DataFrame:
    """One row per identity: ``kept`` is ``keep`` of the earliest copy.

    A null time counts as latest; nulls of an identity part agree with each other.
    """
    keyed = rows.select(*[c.alias(f"__i{n}") for n, c in enumerate(identity)], keep.alias("__keep"), F.struct(time.isNull(), time, tie).alias("__rank"))
    return keyed.groupBy(*[f"__i{n}" for n in range(len(identity))]).agg(F.min_by("__keep", "__rank").alias("kept"), F.count(F.lit(1)).alias("copies"))


def _identity(messages: DataFrame, store: str | None) -> tuple[DataFrame, list[Column]]:
    timed = attach_instants(messages, "sent_raw", "sent_offset_sec", into="__sent", store=store)
    text = F.when(F.col("__sent").isNull(), F.col("sent_raw"))
    return timed, [F.col("mailbox_id"), canonical_message_id(F.col("message_id")), F.col("__sent"), text]


def surplus_deliveries(messages: DataFrame, store: str | None = None) -> DataFrame:
    """delivery_id of every copy that is not the earliest of its mail.

    Copies agree in mailbox, canonical message id and instant of the Date header;
    where a header has no instant its text must be equal (null equals null).  Of
    copies received at the same time the smallest delivery_id stays.  A delivery
    repeated as a whole row stays once and is no case.  An empty table gives none.
    """
    narrow = messages.select("delivery_id", "message_id", "mailbox_id", "received_at", "sent_raw", "sent_offset_sec")
    timed, identity = _identity(narrow, store)
    kept = elect_copies(timed, identity, F.col("delivery_id"), F.col("received_at"), F.col("delivery_id"))
    return messages.select("delivery_id").distinct().join(kept.select(F.col("kept").alias("delivery_id")), "delivery_id", "left_anti")


def deliver_once(messages: DataFrame, store: str | None = None) -> DataFrame:
    """The messages, one whole row per mail, all columns kept."""
    columns = messages.columns
    timed, identity = _identity(messages, store)
    whole = F.struct(*[F.col(f"`{c}`") for c in columns])
    return elect_copies(timed, identity, whole, F.col("received_at"), F.col("delivery_id")).select("kept.*")
