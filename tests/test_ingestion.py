from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import documents as DOC
from ledgerloom.functions import text as X
from ledgerloom.operators.extraction import BUILT_IN, Extractor, classified, extract, fields, from_domain
from ledgerloom.operators.families import resolve_families
from ledgerloom.plans.ingest import ingest
from ledgerloom.plans.smoke import run_smoke
from ledgerloom.synth.corpus import labelled_corpus, minimal_pdf

DDL = "ordinal bigint, message_id string, sender string, subject string, body_text string, body_html string, attachments array<struct<filename:string,content_type:string,content:binary>>, issued_at timestamp, issued_offset_sec int"
DAY = datetime(2026, 1, 15, 9)


def mails(spark, rows):
    return spark.createDataFrame([(i, f"m{i}", s, sub, t, h, a, DAY, 0) for i, (s, sub, t, h, a) in enumerate(rows)], DDL)


def test_fields_by_merchant(spark):
    pdf = [("invoice.pdf", "application/pdf", bytearray(minimal_pdf("Invoice Total: £34.00")))]
    scan = [("scan.pdf", "application/pdf", bytearray(b"%PDF-1.4 no text"))]
    df = mails(spark, [
        ("o@amazon.co.uk", "Your order", "Order #AMZ-7 \nOrder total: £24.99\nPens £20.00\nshipment id 9", None, None),
        ("r@screwfix.com", "Slip", "Order ref: SF12\nTotal £45.00\nDrill £37.50", None, None),
        ("n@toolstation.com", "order YWW55", None, "<p>Slip</p><table><tr><td>Total</td><td>£22.50</td></tr></table>", None),
        ("f@shell.com", "Slip", "Total paid: £60.00", None, None),
        ("b@octopus.energy", "Invoice", None, '<p>Account ref: ACC9</p><table><tr><td>Total</td><td>£120.00</td></tr></table>', None),
        ("a@trader.example", "Invoice", None, None, pdf),
        ("a@trader.example", "Invoice", None, None, scan),
        ("n@shop.example", "Weekly newsletter", "unsubscribe", None, None),
    ])
    got = {r.source_message_id: r for r in extract(classified(df)).collect()}
    assert "m7" not in got
    assert (got["m0"].order_ref, got["m0"].total_minor) == ("AMZ-7-SHIP-9", 2499)
    assert (got["m1"].order_ref, got["m1"].total_minor, got["m1"].vat_minor) == ("SF12", 4500, 750)
    assert (got["m2"].order_ref, got["m2"].total_minor) == ("YWW55", 2250)
    assert (got["m3"].supplier, got["m3"].grade, got["m3"].vat_minor) == ("Shell", "itemised", 1000)
    assert (got["m4"].supplier, got["m4"].order_ref, got["m4"].total_minor) == ("Octopus Energy", "ACC9", 12000)
    assert (got["m5"].supplier, got["m5"].total_minor, got["m5"].field_provenance["total"]) == ("Trader", 3400, "pdf_text")
    assert (got["m6"].grade, got["m6"].attachment_refs) == ("requires_ocr", ["scan.pdf"])


def test_custom_extractor_comes_first(spark):
    mine = Extractor("mine", from_domain("trader.example"), lambda: fields(F.lit("Mine"), F.lit("R1"), F.lit(5), F.array().cast(X.LINE_TYPE), "materials", {}))
    df = mails(spark, [("a@trader.example", "Invoice", "Total £1.00", None, None)])
    assert extract(classified(df), (mine,)).first().supplier == "Mine"
    assert BUILT_IN[-1].name == "generic"


def test_corpus_gate(spark):
    r = run_smoke(labelled_corpus(spark))
    assert (r["corpus_size"], r["corpus_hash"], r["exact_precision"], r["requires_ocr"], r["passed"]) == (560, "1033f9b13209b04d", 1.0, 0, True)


@pytest.mark.parametrize("html,price", [
    ('<script type="application/ld+json">{"price":"£9.99"}</script>', "9.99"), ('<script type="application/ld+json">{"a":{"offers":[{"price":"3.00"}]},"b":{"price":"1.00"}}</script>', "3.00"),
    ('<script type="application/ld+json">{"price":9.99}</script>', None), ('<script type="application/ld+json">{bad</script>', None), (None, None),
])
def test_json_ld(html, price):
    assert DOC.json_ld_price(html) == price


def test_pdf_text():
    import zlib

    assert "Total: £5.00" in DOC.pdf_text(minimal_pdf("Total: £5.00"))
    assert DOC.pdf_text(b"%PDF /Encrypt (x) Tj") == "" and DOC.pdf_text(b"nope") == "" and DOC.pdf_text(None) == ""
    z = zlib.compressobj(wbits=-15)
    raw = z.compress(b"(Total 3) Tj") + z.flush()
    assert "Total 3" in DOC.pdf_text(b"%PDF-1\nstream\n" + raw + b"\nendstream")


def test_line_items_on_collapsed_text(spark):
    df = spark.createDataFrame([("Order #AMZ-1001 Order total: £24.99 Widget pack £20.82 VAT £4.17",), ("Drill bit £37.50 Total £45.00",)], "b string")
    got = [[(i.description, i.net_minor) for i in r[0]] for r in df.select(X.line_items(F.col("b"))).collect()]
    assert got == [[("Order #AMZ-1001 Order total:", 2499), ("Widget pack £20.82 VAT", 417)], [("Drill bit £37.50 Total", 4500)]]


FAMILY_DDL = "ordinal bigint, source_message_id string, kind string, grade string, supplier string, order_ref string, family_key string, total_minor bigint, currency string, issued_at timestamp, issued_offset_sec int"


def fam(spark, rows):
    return resolve_families(spark.createDataFrame([(i, m, k, g, "Shop", ref, key, 100, "GBP", DAY, 0) for i, (m, k, g, ref, key) in enumerate(rows)], FAMILY_DDL))


def test_family_table(spark):
    buy, back = "purchase_receipt", "credit_note"
    one = fam(spark, [("confirm-1", "unknown", "partial", "A", "k"), ("invoice-1", buy, "partial", "A", "k")]).collect()
    assert [(r.source_message_id, r.merged_from) for r in one] == [("invoice-1", ["confirm-1"])]
    assert fam(spark, [("a", buy, "partial", "X-SHIP-1", "k"), ("b", buy, "partial", "X-SHIP-2", "k")]).count() == 2
    assert fam(spark, [("a", buy, "partial", "", "k"), ("b", buy, "partial", "", "k")]).count() == 2
    both = fam(spark, [("i", buy, "itemised", "A", "k"), ("c", back, "partial", "A", "k")]).collect()
    assert {r.source_message_id for r in both} == {"i", "c"}
    lost = fam(spark, [("i", buy, "itemised", "A", "k"), ("i", buy, "partial", "A", "k"), ("c", back, "partial", "A", "k")]).collect()
    assert [r.source_message_id for r in lost] == ["i"]
    assert fam(spark, [("a", buy, "partial", "A", ""), ("b", buy, "partial", "A", "")]).count() == 2


def test_since_and_empty(spark):
    df = mails(spark, [("r@screwfix.com", "Slip", "Order ref: SF12\nTotal £45.00", None, None)])
    assert ingest(df, since=datetime(2026, 1, 15, 9)).slips.count() == 1
    assert ingest(df, since=datetime(2026, 1, 16)).slips.count() == 0
