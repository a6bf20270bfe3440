"""Registered queries over small fixtures whose results are stated in full.

For formats that SQL can't read: MIME parts, PDF text, structured data, and the
extractors of the merchants; and for blocklists, repeats of the gate and the figures
of the ingestion report.
"""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import GateThresholds, MatchConfig
from ..functions import documents as D
from ..functions import scrub as SC
from ..operators import corpus_metrics as CM
from ..operators import extraction as EX
from ..sources import maildir as MD
from ..synth import scenarios as SY
from ..synth.corpus import labelled_corpus, minimal_pdf
from ..workspace import settle
from .gate import run_gate
from .ingest import ingest
from .smoke import run_smoke

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


def _values(columns: str, *rows: tuple) -> str:
    """SQL that states rows in full."""
    literal = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(literal(v) for v in r) + ")" for r in rows) + f") v({columns})"


def _b64(text: str) -> str:
    return base64.b64encode(text.encode()).decode()


# ------------------------------------------------------------------------- mail files

_NESTED = f"""From: Shop <shop@tile-shed.example>
To: a@b.example, c@d.example
Subject: Your parcel
Content-Type: multipart/mixed; boundary="outer"

--outer
Content-Type: multipart/alternative; boundary="inner"

--inner
Content-Type: text/plain; charset=utf-8
Content-Transfer-Encoding: quoted-printable

Caf=C3=A9 total =C2=A35.00, a long line that goes =
on
--inner
Content-Type: text/html; charset=utf-8
Content-Transfer-Encoding: base64

{_b64("<p>Café total £5.00</p>")}
--inner--
--outer
Content-Type: application/pdf; name="bill.pdf"
Content-Transfer-Encoding: base64
Content-Disposition: attachment; filename="bill.pdf"

{_b64("%PDF-1.4")}
--outer--
"""
_SINGLE = """From: news@rope-yard.example
Subject: Hello
Content-Type: text/html
Content-Transfer-Encoding: quoted-printable

<p>1 =3D 1</p>"""
_BARE = """From: x@y.example
Subject: No type

plain words"""


@query("s5_mime_parts", _values("message_id, sender, subject, body_text, body_html, files", ("m1", "Shop <shop@tile-shed.example>", "Your parcel", "Café total £5.00, a long line that goes on", "<p>Café total £5.00</p>", "bill.pdf"), ("m2", "news@rope-yard.example", "Hello", "", "<p>1 = 1</p>", ""), ("m3", "x@y.example", "No type", "plain words", "", "")))
def s5_mime_parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts within parts, quoted-printable with a soft line break, base64, a named file, a single part, no type at all."""
    raw = [("/m/m1", _NESTED), ("/m/m2:2,S", _SINGLE), ("/m/m3", _BARE)]
    files = spark.createDataFrame([(p, bytearray(t.replace("\n", "\r\n").encode())) for p, t in raw], "path string, content binary")
    names = F.array_join(F.transform("attachments", lambda a: a["filename"]), ",")
    return MD.parse_files(files, "box").select("message_id", "sender", "subject", F.trim("body_text").alias("body_text"), F.trim("body_html").alias("body_html"), names.alias("files"))


# ------------------------------------------------------------- structured data and PDF

_LD = '<script type="application/ld+json">{}</script>'


@query("x2_linked_data", _values("id, total", (1, 1299), (2, 4050), (3, None), (4, 700), (5, None)))
def x2_linked_data(spark: SparkSession, d: str) -> DataFrame:
    """Own price, nested price with its currency sign, unreadable block, second block, a JSON number."""
    rows = [
        (1, _LD.format('{"@type":"Order","price":"12.99"}')), (2, _LD.format('{"@type":"Order","offers":[{"price":"£40.50"}]}')), (3, _LD.format("{not json")),
        (4, _LD.format("{not json") + _LD.format('{"price":"7"}')), (5, _LD.format('{"price":12.5}')),
    ]
    return spark.createDataFrame(rows, "id int, html string").select("id", D.json_ld_total(F.col("html")).alias("total"))


@query("x13_pdf_text", _values("id, text, total", (1, "Bill 7 Order total £12.50", 1250), (2, "(in brackets) Total: £3.00", 300), (3, "nothing due", None), (4, "", None)))
def x13_pdf_text(spark: SparkSession, d: str) -> DataFrame:
    rows = [(1, minimal_pdf("Bill 7 Order total £12.50")), (2, minimal_pdf("(in brackets) Total: £3.00")), (3, minimal_pdf("nothing due")), (4, b"no file of this kind")]
    df = spark.createDataFrame([(n, [("a.pdf", "application/pdf", bytearray(b))]) for n, b in rows], "id int, attachments array<struct<filename:string,content_type:string,content:binary>>")
    read = df.select("id", F.get(D.pdf_texts(F.col("attachments")), F.lit(0))["text"].alias("raw"))
    return read.select("id", F.trim("raw").alias("text"), D.pdf_total(F.col("raw")).alias("total"))


# -------------------------------------------------------------------------- extractors

_DATED = "timestamp_seconds(1767261600)"


def _extracted(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """rows: (sender, subject, body_text, body_html)."""
    df = spark.createDataFrame([(n, f"m{n}", *r) for n, r in enumerate(rows, 1)], "ordinal bigint, message_id string, sender string, subject string, body_text string, body_html string")
    none = F.array().cast("array<struct<filename:string,content_type:string,content:binary>>")
    df = df.select("*", none.alias("attachments"), F.expr(_DATED).alias("issued_at"), F.lit(0).alias("issued_offset_sec"))
    out = EX.extract(EX.classified(df))
    return out.select(F.col("ordinal").cast("int").alias("id"), "extractor", "supplier", "order_ref", "total_minor", F.size("line_items").alias("lines"))


_TABLE = "<table><tr><td>Saw</td><td>£10.00</td></tr><tr><td>Total</td><td>£12.00</td></tr></table>"


@query("c9_extractors", _values("id, extractor, supplier, order_ref, total_minor, lines", (1, "amazon", "Amazon", "123-4567", 1200, 1), (2, "screwfix", "Screwfix", "W77", 1200, 1), (3, "toolstation", "Toolstation", "4711", 1200, 1), (4, "toolstation", "Toolstation", "YWW55", 1200, 1), (5, "bandq", "B&Q", "981", 1200, 1), (6, "fuel", "BP", "", 1200, 1), (7, "utility", "EDF", "E99", 1200, 1), (8, "utility", "Octopus Energy", "A1", 4200, 0), (9, "generic", "Rope-yard", "900", 1200, 1)))
def c9_extractors(spark: SparkSession, d: str) -> DataFrame:
    """One message for each built-in extractor, with the reference where that merchant puts it."""
    return _extracted(spark, [
        ("a@amazon.co.uk", "Your order", None, "<p>Order #123-4567</p>" + _TABLE), ("a@screwfix.com", "Your order", None, "<p>Order ref: W77</p>" + _TABLE), ("a@toolstation.com", "Your order", None, "<p>Order number: 4711</p>" + _TABLE),
        ("a@toolstation.com", "Order YWW55 confirmed: your order", None, _TABLE), ("a@diy.com", "Your order", None, "<p>Receipt no: 981</p>" + _TABLE), ("a@bp.com", "Your invoice", None, _TABLE), ("a@edfenergy.com", "Your invoice", None, "<p>Account ref: E99</p>" + _TABLE),
        ("a@octopus.energy", "Your invoice", _LD.format('{"accountNumber":"A1","totalPaymentDue":{"price":"42.00"}}'), None), ("till@rope-yard.example", "Your order", None, "<p>Order no. 900</p>" + _TABLE),
    ])


@query("e7_ingested_corpus", _values("kind, n, n_right, total", ("credit_note", 60, 60, -372372), ("purchase_receipt", 360, 340, 2317272)))
def e7_ingested_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Extracted rows of the labelled corpus by kind, and how many have the total they were made with.

    Extractors of known merchants read no files, so twenty totals that stand in a file alone are not found.
    """
    corpus = settle(labelled_corpus(spark))
    got = ingest(corpus).extracted.join(corpus.select(F.col("message_id").alias("source_message_id"), "true_total"), "source_message_id")
    return got.where("kind in ('credit_note', 'purchase_receipt')").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(F.col("total_minor")) == F.abs(F.col("true_total"))).alias("n_right"), F.sum("true_total").alias("total"))


# ------------------------------------------------------------------------------ reports


@query("e3_report", _values("exact_precision, exact_recall, bearing_precision, bearing_recall, hard_negative, long_tail, priority_merchant", (1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)).replace("SELECT *", "SELECT " + ", ".join(f"{c}::DOUBLE AS {c}" for c in ("exact_precision", "exact_recall", "bearing_precision", "bearing_recall", "hard_negative", "long_tail", "priority_merchant"))))
def e3_report(spark: SparkSession, d: str) -> DataFrame:
    r = run_smoke(labelled_corpus(spark))
    figures = {k: float(r[k]) for k in ("exact_precision", "exact_recall", "bearing_precision", "bearing_recall")} | r["stratum_accuracy"]
    return spark.createDataFrame([tuple(figures.values())], ", ".join(f"{k} double" for k in figures))


@query("j7_field_accuracy", "SELECT 0.5::DOUBLE AS accuracy, 1.0::DOUBLE AS without_labels")
def j7_field_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Right, wrong total, missing slip, right."""
    labels = spark.createDataFrame([("a", "X", 1), ("b", "Y", 2), ("c", "Z", 3), ("d", "W", 4)], "message_id string, supplier string, total_minor bigint")
    got = spark.createDataFrame([("a", "X", 1), ("b", "Y", 9), ("d", "W", 4)], "slip_id string, supplier string, total_minor bigint")
    return CM.field_accuracy(labels, got).crossJoin(CM.field_accuracy(labels.limit(0), got).withColumnRenamed("accuracy", "without_labels"))


@query("e5_five_repeats", "SELECT true AS deterministic, 16::BIGINT AS scenarios")
def e5_five_repeats(spark: SparkSession, d: str) -> DataFrame:
    """Five more runs of the hand-written suite, each under another number of partitions, agree with the first."""
    run = run_gate(SY.hand_written(spark), MatchConfig(), GateThresholds(), repeats=5)
    return spark.createDataFrame([(run.deterministic, run.per_scope.count())], "deterministic boolean, scenarios bigint")


# ---------------------------------------------------------------------------- blocklists

_BLOCK = SC.Blocklist(email_local_parts=("jo.smith",), area_names=("North Hill",), literal_names=("Jo Smith",))


@query("scrub3_blocklist", _values("id, clean", (1, "collected in REDACTED_AREA today"), (2, "write to REDACTED_EMAIL@example.com now"), (3, "shop@tile-shed.example stays"), (4, "")))
def scrub3_blocklist(spark: SparkSession, d: str) -> DataFrame:
    rows = [(1, "collected in north hill today"), (2, "write to the.jo.smith1@post.example now"), (3, "shop@tile-shed.example stays"), (4, "")]
    return spark.createDataFrame(rows, "id int, raw string").select("id", SC.scrub_fixture(F.col("raw"), _BLOCK).alias("clean"))


@query("scrub9_findings", _values("id, found", (1, "collection_area"), (2, "blocked:jo.smith"), (3, "blocked:jo smith"), (4, "")))
def scrub9_findings(spark: SparkSession, d: str) -> DataFrame:
    rows = [(1, "near North Hill"), (2, "JO.SMITH@post.example"), (3, "for Jo Smith"), (4, "a clean line")]
    return spark.createDataFrame(rows, "id int, raw string").select("id", F.array_join(SC.findings(F.col("raw"), _BLOCK), ",").alias("found"))
