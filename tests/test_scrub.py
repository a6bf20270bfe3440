import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import scrub as S


def apply(spark, f, *texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return [r[0] for r in df.select(f(F.col("t"))).collect()]


def test_patterns_and_audit(spark):
    raw = "Dear Mr John Smith, ship to 12 Green Lane Road, Leeds, LS1 4AB. Order YWW12345 x@hotmail.com +44 7700 900123 Volunteer Name"
    (out,) = apply(spark, S.scrub, raw)
    assert "Smith" not in out and "LS1" not in out and "hotmail" not in out and "YWW1" not in out and "7700" not in out
    (found,) = apply(spark, S.findings, raw)
    assert found[0] == "uk_postcode" and "dear_name" in found and "toolstation_order" in found and found[-1] == "dictionary_literal"
    assert apply(spark, S.is_clean, "nothing here") == [True]


def test_fixture_scrub_keeps_merchants(spark):
    (out,) = apply(spark, S.scrub_fixture, "From: orders@shop.co.uk To: me@outlook.com Hi John")
    assert "orders@shop.co.uk" in out and "outlook" not in out and "Hi, REDACTED_NAME" in out
    block = S.Blocklist(("jsmith",), ("Leeds",), ("john",))
    (out,) = apply(spark, lambda c: S.scrub_fixture(c, block), "a.jsmith@work.org in leeds")
    assert out == "REDACTED_EMAIL@example.com in REDACTED_AREA"


def test_export_raises(spark):
    assert apply(spark, S.export, "plain text") == ["plain text"]
    with pytest.raises(Exception, match="personal data remain"):
        apply(spark, lambda c: S.export(c), "order AB at @hotmail.com")


def test_slugs(spark):
    assert apply(spark, S.slug, "/a/Confirmation of Order YWW1234.eml", "??.eml", "x" * 80 + ".eml") == ["confirmation-of-order-order", "fixture", "x" * 64]
    assert apply(spark, S.merchant_of, "from a@screwfix.com", "nobody") == ["screwfix", None]
