from datetime import datetime, timedelta

from ledgerloom.operators.redelivery import canonical_message_id, deliver_once, surplus_deliveries
from pyspark.sql import functions as F

DDL = "delivery_id bigint, message_id string, mailbox_id string, received_at timestamp, sent_raw string, sent_offset_sec int, body string, kept string"
T = datetime(2024, 1, 1)


def rows():
    a = "Mon, 01 Jan 2024 12:33:56 +0000"
    return [
        (1, "<m1@x>", "b1", T + timedelta(hours=2), a, None, "p", "k"), (2, "m1@x:2,S", "b1", T + timedelta(hours=1), "2024-01-01T12:33:56Z", None, "q", "k"),
        (3, "m1@x", "b2", T, a, None, "r", "k"), (4, "m1@x", "b1", T, "Mon, 01 Jan 2024 12:33:57 +0000", None, "s", "k"),
        (5, "m2@x", "b1", T, "unknown", None, "t", "k"), (6, "m2@x", "b1", T, "unknown", None, "u", "k"), (7, "m2@x", "b1", T, None, None, "v", "k"), (8, "<m2@x>", "b1", None, None, None, "w", None),
    ]


def test_surplus_and_whole_rows(spark):
    df = spark.createDataFrame(rows(), DDL)
    assert {r[0] for r in surplus_deliveries(df).collect()} == {1, 6, 8}
    kept = deliver_once(df)
    assert kept.columns == df.columns and {r.delivery_id for r in kept.collect()} == {2, 3, 4, 5, 7}


def test_hot_identifier_and_repeats(spark):
    many = spark.range(2000).select(F.col("id").alias("delivery_id"), F.lit("<hot@x>").alias("message_id"), F.lit("b").alias("mailbox_id"), F.timestamp_seconds(F.col("id") + 10).alias("received_at"), F.lit("1704112436").alias("sent_raw"), F.lit(None).cast("int").alias("sent_offset_sec"), F.lit("x").alias("body"), F.lit("y").alias("kept"))
    assert surplus_deliveries(many.unionByName(many.where("id = 0"))).count() == 1999


def test_empty(spark):
    df = spark.createDataFrame([], DDL)
    assert surplus_deliveries(df).count() == 0 and deliver_once(df).count() == 0


def test_canonical_id(spark):
    df = spark.createDataFrame([("<a@b>",), (" a@b:2,FS ",), ("a@b",), ("<a@b>:2,",)], "m string")
    assert {r[0] for r in df.select(canonical_message_id(F.col("m"))).collect()} == {"a@b"}
