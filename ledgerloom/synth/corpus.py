"""A labelled corpus of messages: 28 patterns in 20 variants each.

A pattern is a sender, one of a few forms of body, and a label.  Its texts are put
together from the form; amounts, references and times follow from the number of the
message.  Texts of PDF attachments are put into minimal files.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.amount import fifth, pounds_text

VARIANTS = 20

# The labels and strata of the patterns in their order, as counts of neighbours; the published hash covers ids and labels.
SEQUENCE = (
    ("priority_merchant", "purchase_receipt", 13),
    ("priority_merchant", "credit_note", 2),
    ("long_tail", "purchase_receipt", 5),
    ("hard_negative", "marketing", 3),
    ("hard_negative", "dispatch_notice", 2),
    ("hard_negative", "statement", 2),
    ("hard_negative", "credit_note", 1),
)


@dataclass(frozen=True)
class Form:
    """Where a message says what: slots are {id}, {v}, {item}, {net}, {vat} and {total}."""

    subject: str
    html: str = ""
    text: str = ""
    pdf: str = ""


def _rows(*pairs: tuple[str, str]) -> str:
    return "<table>" + "".join(f"<tr><td>{name}</td><td>{value}</td></tr>" for name, value in pairs) + "</table>"


def _linked_data(body: str) -> str:
    return f'<script type="application/ld+json">{body}</script>'


_LINES = (("{item}", "£{net}"), ("VAT", "£{vat}"), ("Total", "£{total}"))
FORMS = {
    "table": Form("Your order {id}", "<h2>Thank you</h2>" + _rows(*_LINES) + "<p>{ref}</p>"),
    "nested": Form("Invoice for {id}", _rows(("Goods", _rows(_LINES[0])), _LINES[2]) + "<div>{ref}</div>"),
    "lines": Form("Payment received", text="{ref}\n{item} £{net}\nVAT £{vat}\nOrder total: £{total}\n"),
    "data": Form("Invoice {id}", _linked_data('{"@type":"Order","price":"{total}"}') + "<p>{ref}</p>" + _rows(_LINES[2])),
    "nested data": Form("Invoice {id}", _linked_data('{"@type":"Invoice","accountNumber":"{id}","totalPaymentDue":{"price":"{total}"}}') + _rows(*_LINES)),
    "bare data": Form("Invoice", _linked_data('{"price":"{total}"}')),
    "file": Form("Your invoice {id}", "<p>Please see the enclosed file.</p>", pdf="Invoice {id} Order total £{total}"),
    "both": Form("Order confirmation {id}", "<p>{ref}</p>" + _rows(_LINES[2]), "{ref}, in all £{total}"),
    "one line": Form("Order confirmation", _rows(("{item}", "£{total}"), _LINES[2])),
    "back table": Form("Refund confirmation", "<p>{ref}</p>" + _rows(("Refund total", "£{total}"))),
    "back lines": Form("Return processed", text="{ref}\nRefund: £{total}\n"),
    "call": Form("Complete your purchase", "<p>Things you looked at are waiting.</p><p>unsubscribe</p>"),
    "news": Form("Week {id} at a glance", "<p>Our newsletter: a limited time offer every day.</p>"),
    "last day": Form("Sale ends soon", text="limited time offer\nunsubscribe\n"),
    "tracked": Form("Parcel {id} was dispatched", "<p>Follow it under TRK{id}.</p>"),
    "sent": Form("Shipped today", "<p>It is on its way.</p>"),
    "balance": Form("Monthly statement", "<p>Your figures are ready.</p>"),
    "period": Form("Account summary", pdf="Period {id}"),
}
#: Sender, form and how the sender words a reference, in the order of SEQUENCE.
SENDERS = (
    ("shop@amazon.co.uk", "table", "Order #{id}-{v}"), ("digital@amazon.co.uk", "data", "Order #B{id}"), ("business@amazon.co.uk", "file", ""),
    ("trade@screwfix.com", "nested", "Order ref: W{id}"), ("web@screwfix.com", "lines", "Order ref: W{id}"),
    ("web@toolstation.com", "table", "Order number: {id}"), ("parts@toolstation.com", "one line", ""),
    ("store@diy.com", "nested", ""), ("garden@diy.com", "one line", ""),
    ("forecourt@shell.com", "one line", ""), ("forecourt@bp.com", "lines", "Pump {v}"),
    ("accounts@octopus.energy", "nested data", ""), ("accounts@edfenergy.com", "table", "Account ref: E{id}"),
    ("returns@amazon.co.uk", "back table", "Order #B{id}"), ("returns@screwfix.com", "back lines", "Credit note W{id}"),
    ("desk{v}@lamp-house.example", "bare data", ""), ("till{v}@rope-yard.example", "table", "Order {id}"), ("hello@seed-barn.example", "lines", "Order {id}"), ("web@clay-works.example", "both", "Order {id}"), ("office@tile-shed.example", "file", ""),
    ("crew@lamp-house.example", "call", ""), ("crew@rope-yard.example", "news", ""), ("crew@seed-barn.example", "last day", ""),
    ("parcels@amazon.co.uk", "tracked", ""), ("parcels@van-line.example", "sent", ""),
    ("statements@river-bank.example", "balance", ""), ("statements@hill-bank.example", "period", ""),
    ("returns@clay-works.example", "back table", "Credit note C{id}"),
)
ITEMS = ("garden twine", "door hook", "work lamp", "seed tray", "chalk line")


@dataclass(frozen=True)
class Pattern:
    name: str
    stratum: str
    label: str
    sender: str
    form: Form
    reference: str


def _patterns() -> tuple[Pattern, ...]:
    kinds = [(stratum, label) for stratum, label, n in SEQUENCE for _ in range(n)]
    return tuple(Pattern(f"{sender.split('@')[1].split('.')[0]} {form}", stratum, label, sender, FORMS[form], reference) for (stratum, label), (sender, form, reference) in zip(kinds, SENDERS, strict=True))


PATTERNS = _patterns()


def minimal_pdf(text: str) -> bytes:
    """The smallest file that shows one line of text."""
    shown = text.replace("(", r"\(").replace(")", r"\)")
    stream = f"BT /F1 11 Tf 50 700 Td ({shown}) Tj ET".encode()
    head = b"%PDF-1.4\n1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj\n2 0 obj<</Type/Pages/Kids[3 0 R]/Count 1>>endobj\n3 0 obj<</Type/Page/Parent 2 0 R/Contents 4 0 R>>endobj\n"
    return head + b"4 0 obj<</Length %d>>stream\n" % len(stream) + stream + b"\nendstream\nendobj\ntrailer<</Root 1 0 R>>\n%%EOF"


def _filled(template: str, slots: dict[str, Column]) -> Column:
    out = F.lit(template)
    for name, value in slots.items():
        if "{" + name + "}" in template:
            out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def labelled_corpus(spark: SparkSession) -> DataFrame:
    """Messages with label, stratum and pattern; ids run from msg-00001."""
    to_pdf = F.pandas_udf(lambda s: pd.Series([None if x is None else minimal_pdf(x) for x in s], dtype=object), "binary")
    out = None
    for n, p in enumerate(PATTERNS):
        v = F.col("id").cast("int")
        number = F.lit(n * VARIANTS + 1) + v
        net = F.lit(800) + F.pmod(number * 137 + v * v * 41, F.lit(9_000))
        vat = fifth(net)
        total = (net + vat) * (-1 if p.label == "credit_note" else 1)
        slots = {"item": F.element_at(F.array(*[F.lit(x) for x in ITEMS]), F.pmod(number, F.lit(len(ITEMS))) + 1), "id": number.cast("string"), "v": v.cast("string"), "total": pounds_text(total), "net": pounds_text(net), "vat": pounds_text(vat)}
        filled = lambda template: _filled(template.replace("{ref}", p.reference), slots)  # noqa: B023, E731
        pdf = filled(p.form.pdf) if p.form.pdf else F.lit(None).cast("string")
        mid = F.concat(F.lit("msg-"), F.lpad(number.cast("string"), 5, "0"))
        rows = spark.range(VARIANTS).select(
            number.cast("bigint").alias("ordinal"), mid.alias("message_id"), filled(p.sender).alias("sender"), filled(p.form.subject).alias("subject"), filled(p.form.text).alias("body_text"), filled(p.form.html).alias("body_html"),
            F.lit(p.label.split("_")[0] + ".pdf").alias("pdf_name"), pdf.alias("pdf"), F.timestamp_seconds(F.lit(1_767_254_400) + number * 5_400).alias("issued_at"), F.lit(0).alias("issued_offset_sec"),
            F.lit(p.label).alias("label"), F.lit(p.stratum).alias("stratum"), F.lit(p.name).alias("pattern"), total.cast("bigint").alias("true_total"),
        )
        out = rows if out is None else out.unionByName(rows)
    none = F.array().cast("array<struct<filename:string,content_type:string,content:binary>>")
    file = F.array(F.struct(F.col("pdf_name").alias("filename"), F.lit("application/pdf").alias("content_type"), to_pdf("pdf").alias("content")))
    return out.withColumn("attachments", F.when(F.col("pdf").isNotNull(), file).otherwise(none)).drop("pdf", "pdf_name")


def corpus_fingerprint(corpus: DataFrame) -> DataFrame:
    """First 16 hex digits of SHA-256 over the sorted id|label list as JSON."""
    ids = corpus.agg(F.to_json(F.array_sort(F.collect_list(F.concat("message_id", F.lit("|"), "label")))).alias("j"))
    return ids.select(F.substring(F.sha2("j", 256), 1, 16).alias("hash"))
