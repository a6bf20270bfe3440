import os

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions.instants import instant_micros
from ledgerloom.operators.instants import InstantDictionary, attach_instants, normalised_times

UTC = 1_704_112_436_000_000  # 2024-01-01T12:33:56Z

SAME = [
    ("Mon, 01 Jan 2024 12:33:56 +0000", None, None, None), ("Tue, 1 Jan 2024 13:33:56 +0100 (CET)", None, None, None), ("mon,  1 JAN 2024  07:33:56 EST", None, None, None),
    ("1 Jan 24 12:33:56 -0000", None, None, None), ("Mon Jan  1 12:33:56 2024", 0, None, None), ("Mon Jan  1 14:33:56 2024", 7200, None, None), ("2024-01-01T12:33:56Z", None, None, None),
    ("2024-01-01 18:18:56+05:45", None, None, None), ("20240101T123356Z", None, None, None), ("20240101123356", 0, None, None), ("1704112436", None, None, None), ("1704112436000", None, None, None),
    ("1704112436000000", None, None, None), ("1704112436000000000", None, None, None), ("1704112436.00", None, None, None), ("01/01/2024 12:33:56 pm", None, "Europe/London", "dmy"), ("2024/01/01 21:33:56", None, "Asia/Tokyo", "ymd"),
    ("01-Jan-2024 12:33:56 GMT", None, None, None), ("2024-01-01T13:33:56 Europe/Berlin", None, None, None), ("2024-01-01T07:33:56[America/New_York]", None, None, None), ("2024-01-01T06:33:56 America/Chicago", None, "Asia/Tokyo", None),
    ("\t2024-01-01T12:33:56,000 +00 \n", None, None, None),
]
MINUTE = [("1 janvier 2024 à 13h33", "Europe/Paris"), ("1. Januar 2024, 13:33 Uhr", "Europe/Berlin"), ("1 de enero de 2024, 13:33", "Europe/Madrid"), ("January 1, 2024 07:33 AM", "America/New_York"), ("1 January 2024 12:33", "Europe/London"), ("01.01.24 13:33", "Europe/Berlin")]
NOTHING = [
    (None, 0, None), ("", 0, None), ("unknown", 0, None), ("(no date)", 0, None), ("2024-01-01", 0, "UTC"), ("2024-02-30T10:15:00Z", None, None), ("2024-13-01 10:00:00", 0, None), ("2024-01-01 25:00:00", 0, None),
    ("2024-01-01 12:33:56", None, None), ("2024-03-31 02:30:00", None, "Europe/Berlin"), ("2024-10-27 02:30:00", None, "Europe/Berlin"), ("Xyz, 41 Jan 2024 11:28:52 +0000", None, None), ("0000-00-00 00:00:00", 0, None), ("13/13/2024 10:00", 0, "Europe/Paris"),
]


@pytest.mark.parametrize("raw,off,zone,order", SAME)
def test_one_instant_many_notations(raw, off, zone, order):
    assert instant_micros(raw, off, zone, order) == UTC


@pytest.mark.parametrize("raw,zone", MINUTE)
def test_month_names(raw, zone):
    assert instant_micros(raw, None, zone, "dmy") == UTC - 56_000_000


@pytest.mark.parametrize("raw,off,zone", NOTHING)
def test_undeterminable(raw, off, zone):
    assert instant_micros(raw, off, zone, "dmy") is None


def test_offset_column_decides_over_zone_and_fractions_are_cut():
    assert instant_micros("2024-10-27 02:30:00", 7200, "Europe/Berlin") == instant_micros("2024-10-27T00:30:00Z")
    assert instant_micros("2024-01-01T12:33:56.123456789Z") == UTC + 123_456
    assert instant_micros("12/01/2024 10:00", 0, None, "mdy") == instant_micros("2024-12-01T10:00:00Z")


@given(st.text(max_size=40), st.one_of(st.none(), st.integers(-90000, 90000)))
def test_never_fails(raw, off):
    out = instant_micros(raw, off, "Europe/Paris", "dmy")
    assert out is None or isinstance(out, int)


def test_attach_keeps_rows_and_extends_dictionary(spark, tmp_path):
    rows = [(1, "2024-01-01T12:33:56Z", None, "x"), (2, "2024-01-01T12:33:56Z", None, "y"), (3, None, None, "z"), (4, "unknown", 5, None), (4, "unknown", 5, None)]
    df = spark.createDataFrame(rows, "id bigint, raw string, off int, utc_micros_x string")
    store = f"file://{tmp_path}/book"
    out = attach_instants(df, "raw", "off", store=store)
    assert out.count() == 5 and set(out.columns) == {"id", "raw", "off", "utc_micros_x", "utc_micros"}
    assert {(r.id, r.utc_micros) for r in out.collect()} == {(1, UTC), (2, UTC), (3, None), (4, None)}
    before = len(os.listdir(tmp_path / "book"))
    more = spark.createDataFrame([(9, "2024-01-01T12:33:56Z", None), (10, "1704112436", None)], "id bigint, raw string, off int")
    assert attach_instants(more, "raw", "off", store=store).where("utc_micros is not null").count() == 2
    book = InstantDictionary(spark, store).entries()
    assert book.count() == 2 and len(os.listdir(tmp_path / "book")) >= before


def test_empty_tables(spark):
    mails = spark.createDataFrame([], "delivery_id bigint, sent_raw string, sent_offset_sec int")
    feed = spark.createDataFrame([], "feed_line_id bigint, feed_code string, occurred_raw string, occurred_offset_sec int")
    feeds = spark.createDataFrame([("a", "Europe/Paris", "dmy")], "feed_code string, zone_name string, date_order string")
    assert normalised_times(mails, feed, feeds).count() == 0
    feed = spark.createDataFrame([(1, "a", "01/02/2024 10:00", None), (2, "zzz", "01/02/2024 10:00", None), (3, None, "1704112436", None)], feed.schema)
    got = {(r.record_id, r.utc_micros) for r in normalised_times(mails, feed, feeds).collect()}
    assert got == {(1, instant_micros("2024-02-01T09:00:00Z")), (3, UTC)}
    assert F is not None
