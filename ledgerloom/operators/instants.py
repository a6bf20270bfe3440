"""Normalising written times through a dictionary of distinct values.

The strings of a source repeat far more often than they vary once redeliveries
and repeated lines are counted, and parsing is the costly step.  So the distinct
(text, offset, zone, order) combinations are taken first (a map-side combining
aggregation), those that an earlier run already holds are left out, the rest are
parsed once in Arrow batches and appended to the persisted dictionary, and the
instants are joined back to the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.instants import instant_micros
from ..workspace import scratch_path

KEYS = ("raw", "offset_sec", "zone_name", "date_order")
ENTRY = "raw string, offset_sec int, zone_name string, date_order string, utc_micros bigint"


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = [
            instant_micros(raw, None if pd.isna(off) else int(off), zone if isinstance(zone, str) else None, order if isinstance(order, str) else None)
            for raw, off, zone, order in zip(pdf["raw"], pdf["offset_sec"], pdf["zone_name"], pdf["date_order"], strict=True)
        ]
        pdf["utc_micros"] = pd.array(found, dtype="Int64")
        yield pdf


class InstantDictionary:
    """Distinct written times with their instants, persisted at ``path``.

    Every ``extend`` appends one batch of entries that were not there before, so
    a daily run parses only what the day brought.  Entries without an instant are
    kept too (null), else they would be parsed again each time.
    """

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def exists(self) -> bool:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def entries(self) -> DataFrame:
        return self.spark.read.schema(ENTRY).parquet(self.path)

    def extend(self, keys: DataFrame) -> DataFrame:
        """Add the distinct ``keys`` and return all entries."""
        new = keys.select(*KEYS).distinct()
        if self.exists():
            known = self.entries()
            new = new.alias("n").join(known.alias("k"), [F.col(f"n.{c}").eqNullSafe(F.col(f"k.{c}")) for c in KEYS], "left_anti")
        new.mapInPandas(_parse, ENTRY).write.mode("append").parquet(self.path)
        return self.entries()


def has_digit(raw: Column) -> Column:
    """Texts without any digit state no time; they never reach the dictionary."""
    return F.coalesce(raw.rlike(r"\p{Nd}"), F.lit(False))


def attach_instants(rows: DataFrame, raw: str, offset: str, zone: str | None = None, order: str | None = None, into: str = "utc_micros", store: str | None = None) -> DataFrame:
    """``rows`` plus column ``into``: the instant of ``raw`` in UTC microseconds.

    Null where no single instant follows (also for a null or empty text).  Rows
    are kept one for one, in any number and with any other columns; names clash
    with nothing because the dictionary side is renamed.  ``store`` names a
    dictionary to reuse and extend; without it a new one is made in the shared
    folder.  Rows whose text has no digit skip the join, so a hot text such as
    ``unknown`` costs nothing.
    """
    spark = rows.sparkSession
    null_text = F.lit(None).cast("string")
    marked = rows.select(
        "*",
        F.col(raw).alias("__raw"),
        F.col(offset).cast("int").alias("__off"),
        (F.col(zone) if zone else null_text).alias("__zone"),
        (F.col(order) if order else null_text).alias("__order"),
    )
    keys = marked.where(has_digit(F.col("__raw"))).select(F.col("__raw").alias("raw"), F.col("__off").alias("offset_sec"), F.col("__zone").alias("zone_name"), F.col("__order").alias("date_order"))
    entries = InstantDictionary(spark, store or scratch_path(spark, "instants")).extend(keys)
    book = entries.where("utc_micros is not null").select(
        F.col("raw").alias("__k_raw"),
        F.coalesce("offset_sec", F.lit(-(2**31))).alias("__k_off"),
        F.coalesce("zone_name", F.lit("")).alias("__k_zone"),
        F.coalesce("date_order", F.lit("")).alias("__k_order"),
        F.col("utc_micros").alias(into),
    )
    # null offsets and zones have stand-ins so that the join stays an equi-join
    found = marked.where(has_digit(F.col("__raw"))).join(
        book,
        (F.col("__raw") == F.col("__k_raw"))
        & (F.coalesce("__off", F.lit(-(2**31))) == F.col("__k_off"))
        & (F.coalesce("__zone", F.lit("")) == F.col("__k_zone"))
        & (F.coalesce("__order", F.lit("")) == F.col("__k_order")),
        "left",
    ).drop("__k_raw", "__k_off", "__k_zone", "__k_order")
    rest = marked.where(~has_digit(F.col("__raw"))).withColumn(into, F.lit(None).cast("bigint"))
    return found.unionByName(rest).drop("__raw", "__off", "__zone", "__order")


def written_times(messages: DataFrame, bank_feed: DataFrame, feeds: DataFrame) -> DataFrame:
    """Both kinds of written time in one shape, for one dictionary."""
    mails = messages.select(
        F.lit("mail").alias("record_kind"),
        F.col("delivery_id").alias("record_id"),
        F.col("sent_raw").alias("raw"),
        F.col("sent_offset_sec").alias("offset_sec"),
        F.lit(None).cast("string").alias("zone_name"),
        F.lit(None).cast("string").alias("date_order"),
    )
    zones = feeds.groupBy("feed_code").agg(F.min("zone_name").alias("zone_name"), F.min("date_order").alias("date_order"))
    lines = bank_feed.join(zones, "feed_code", "left").select(
        F.lit("feed").alias("record_kind"),
        F.col("feed_line_id").alias("record_id"),
        F.col("occurred_raw").alias("raw"),
        F.col("occurred_offset_sec").alias("offset_sec"),
        "zone_name",
        "date_order",
    )
    return mails.unionByName(lines)


def normalised_times(messages: DataFrame, bank_feed: DataFrame, feeds: DataFrame, store: str | None = None) -> DataFrame:
    """(record_kind, record_id, utc_micros), distinct; undeterminable times give no row."""
    rows = written_times(messages, bank_feed, feeds).where(has_digit(F.col("raw")))
    found = attach_instants(rows, "raw", "offset_sec", "zone_name", "date_order", store=store)
    return found.where("utc_micros is not null").select("record_kind", "record_id", "utc_micros").distinct()
