"""Routing messages to merchant extractors; every field is a built-in expression.

An extractor is a name, a condition on the message and an expression that builds
the extracted fields.  The first whose condition holds takes the message; further
extractors given to ``extract`` come before the built-in ones.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, documents, text
from ..functions.amount import fuel_net
from ..functions.grade import grade, vat_sum
from ..workspace import settle

# Patterns of references by merchant.
AMAZON_ORDER = r"(?i)order\s*#\s*([A-Z0-9\-]{3,})"
AMAZON_URL = r"(?i)orderID=3D?([0-9]{8,})"
AMAZON_SHIPMENT = r"(?i)shipment\s*(?:id|#)?\s*([A-Z0-9]+)"
SCREWFIX_ORDER = r"(?i)(?:order\s*ref[:\s]*|credit\s*note\s+)([A-Z0-9]+)"
TOOLSTATION_ORDER = r"(?i)(?:order\s+(YWW[0-9]+|REDACTED_ORDER)|order\s*number[:\s]*([0-9]+)|of\s+order\s+([0-9]+))"
TOOLSTATION_SUBJECT = r"(?i)order\s+(YWW[0-9]+|REDACTED_ORDER)"
BANDQ_ORDER = r"(?i)receipt\s*no[:\s]*([0-9]+)"
ACCOUNT_REF = r"""(?i)(?:account\s*ref[:\s]*|accountNumber["\s:]+)([A-Z0-9]+)"""

FIELDS = (
    "supplier string, order_ref string, total_minor bigint, currency string, vat_minor bigint, vat_exempt boolean, category string, "
    "line_items array<struct<description:string,net_minor:bigint,vat_minor:bigint>>, field_provenance map<string,string>, attachment_refs array<string>, given_grade string"
)
_TYPE = "struct<" + FIELDS.replace(" string", ":string").replace(" bigint", ":bigint").replace(" boolean", ":boolean").replace(" array<", ":array<").replace(" map<", ":map<").replace(", ", ",") + ">"


@dataclass(frozen=True)
class Extractor:
    name: str
    matches: Column | Callable[[], Column]
    build: Callable[[], Column]

    def condition(self) -> Column:
        return self.matches() if callable(self.matches) else self.matches


def _sender() -> Column:
    return F.lower(F.coalesce("sender", F.lit("")))


def from_domain(*domains: str) -> Callable[[], Column]:
    def condition() -> Column:
        hit = F.lit(False)
        for d in domains:
            hit = hit | F.contains(_sender(), F.lit(d))
        return hit

    return condition


def fields(supplier: Column, ref: Column, total: Column, items: Column, category: str, provenance: dict[str, Column], vat: Column | None = None, refs: Column | None = None, given: Column | None = None) -> Column:
    """The struct every extractor builds; provenance holds only what was found."""
    none = F.create_map().cast("map<string,string>")
    prov = F.map_filter(F.map_from_arrays(F.array(*[F.lit(k) for k in provenance]), F.array(*provenance.values())), lambda k, v: v.isNotNull()) if provenance else none
    return F.struct(
        supplier.alias("supplier"), F.coalesce(ref, F.lit("")).alias("order_ref"), F.coalesce(total, F.lit(0)).cast("bigint").alias("total_minor"), F.lit("GBP").alias("currency"),
        F.coalesce(vat if vat is not None else vat_sum(items), F.lit(0)).cast("bigint").alias("vat_minor"), F.lit(False).alias("vat_exempt"), F.lit(category).alias("category"), items.alias("line_items"),
        prov.alias("field_provenance"), (refs if refs is not None else F.array().cast("array<string>")).alias("attachment_refs"), (given if given is not None else F.lit("")).alias("given_grade"),
    ).cast(_TYPE)


def _found(value: Column, how: str) -> Column:
    return F.when(value.isNotNull(), how)


def _some(items: Column, how: str = "html") -> Column:
    return F.when(F.size(items) > 0, how)


def _body() -> Column:
    return F.col("__body")


def _seen() -> Column:
    return F.col("__seen")


def _bodies_total() -> Column:
    return text.first_total(F.col("__text"), F.col("__visible"))


def staged(messages: DataFrame, extra: tuple[Extractor, ...] = ()) -> DataFrame:
    """Route and texts that many fields are read from, computed once a message and carried as columns.

    Structured data and PDF files are read in Python, and only of messages whose route needs them.
    """
    rows = messages.withColumns({"extractor": route(extra), "__text": F.coalesce("body_text", F.lit("")), "__html": F.coalesce("body_html", F.lit(""))})
    rows = rows.withColumn("__visible", text.visible(F.col("__html")))
    rows = rows.withColumn("__body", text.merged_body(F.col("__text"), F.col("__html"), F.col("__visible")))
    rows = rows.withColumn("__seen", text.visible(F.col("__body")))
    linked = F.when(F.col("extractor") == "generic", F.col("__html")).when(F.col("extractor") == "utility", F.col("__body"))
    return rows.withColumns({"__schema": documents.json_ld_total(linked), "__pdfs": documents.pdf_texts(F.when(F.col("extractor") == "generic", F.col("attachments")))})


def _amazon() -> Column:
    body = _body()
    order, ship, url = (text.capture(body, p) for p in (AMAZON_ORDER, AMAZON_SHIPMENT, AMAZON_URL))
    joined = F.concat(F.coalesce(order, F.lit("")), F.when(ship.isNotNull(), F.concat(F.lit("-SHIP-"), ship)).otherwise(""))
    ref = F.when(joined != "", joined).otherwise(url)
    total, items = _bodies_total(), text.line_items(_seen(), drop_vat=False)
    return fields(F.lit("Amazon"), ref, total, items, "materials", {"order_ref": F.coalesce(_found(order, "html"), F.when(joined == "", _found(url, "html"))), "shipment": _found(ship, "html"), "total": _found(total, "html"), "line_items": _some(items)})


def _shop(supplier: str, pattern: str, groups: int = 1, subject: str | None = None) -> Callable[[], Column]:
    def build() -> Column:
        body = _body()
        ref = F.coalesce(*[text.capture(body, pattern, g) for g in range(1, groups + 1)])
        if subject:
            ref = F.coalesce(ref, text.capture(F.coalesce("subject", F.lit("")), subject))
        total, items = _bodies_total(), text.line_items(_seen(), with_vat=True)
        return fields(F.lit(supplier), ref, total, items, "materials", {"order_ref": _found(ref, "html"), "total": _found(total, "html"), "line_items": _some(items)})

    return build


def _fuel() -> Column:
    s = _sender()
    supplier = F.when(F.contains(s, F.lit("bp.com")), "BP").when(F.contains(s, F.lit("shell.com")), "Shell").when(F.contains(s, F.lit("esso.com")), "Esso").otherwise("Fuel")
    found = text.body_total(_body())
    total = F.coalesce(found, F.lit(0)).cast("bigint")
    net = fuel_net(total)
    items = F.array(F.struct(F.lit("Fuel").alias("description"), net.alias("net_minor"), (total - net).alias("vat_minor"))).cast(text.LINE_TYPE)
    return fields(supplier, F.lit(""), total, items, "motor", {"total": _found(found, "html")}, vat=total - net)


def _utility() -> Column:
    s = _sender()
    supplier = F.when(F.contains(s, F.lit("edf")), "EDF").when(F.contains(s, F.lit("octopus")), "Octopus Energy").when(F.contains(s, F.lit("britishgas")), "British Gas").otherwise("Utility")
    body = _body()
    schema, plain = F.col("__schema"), text.body_total(body)
    ref = text.capture(body, ACCOUNT_REF)
    items = text.line_items(_seen(), with_vat=True)
    how = F.when(schema.isNotNull(), "schema_org").when(plain.isNotNull(), "html")
    return fields(supplier, ref, F.coalesce(schema, plain), items, "overheads", {"total": how, "line_items": _some(items), "order_ref": _found(ref, "html")})


def _generic() -> Column:
    html, plain, seen = F.col("__html"), F.col("__text"), F.col("__visible")
    schema, tabled = F.col("__schema"), text.table_total(html)
    from_html = F.coalesce(schema, tabled)
    empty = F.coalesce(from_html, F.lit(0)) == 0
    from_text = F.when(empty & (plain != ""), text.inline_total(plain))
    total = F.when(~empty, from_html).otherwise(F.coalesce(from_text, from_html))
    ref = text.capture(seen, text.ORDER_REF)
    pdfs = F.col("__pdfs")
    readable = F.filter(pdfs, lambda p: p["text"] != "")
    blank = F.transform(F.filter(pdfs, lambda p: p["text"] == ""), lambda p: p["filename"])
    pdf_totals = F.filter(F.transform(readable, lambda p: documents.pdf_total(p["text"])), lambda x: x.isNotNull() & (x != 0))
    pdf_total = F.when(F.coalesce(total, F.lit(0)) == 0, F.get(pdf_totals, F.lit(0)))
    html_items = text.line_items(seen)
    pdf_lines = F.filter(F.transform(readable, lambda p: text.line_items(p["text"])), lambda x: F.size(x) > 0)
    pdf_items = F.coalesce(F.get(pdf_lines, F.lit(0)), F.array().cast(text.LINE_TYPE))
    items = F.when(F.size(html_items) > 0, html_items).otherwise(pdf_items)
    how = F.when(pdf_total.isNotNull(), "pdf_text").when(from_text.isNotNull(), "html").when(schema.isNotNull(), "schema_org").when(tabled.isNotNull(), "html")
    line_how = F.when(F.size(html_items) > 0, "html").when(F.size(pdf_items) > 0, "pdf_text")
    given = F.when(F.size(blank) > 0, "requires_ocr").otherwise("")
    return fields(text.supplier_from_sender(F.coalesce("sender", F.lit(""))), ref, F.coalesce(pdf_total, total), items, "", {"total": how, "order_ref": _found(ref, "html"), "line_items": line_how}, vat=F.lit(0), refs=blank, given=given)


BUILT_IN = (
    Extractor("amazon", from_domain("amazon."), _amazon),
    Extractor("screwfix", from_domain("screwfix.com"), _shop("Screwfix", SCREWFIX_ORDER)),
    Extractor("toolstation", from_domain("toolstation.com"), _shop("Toolstation", TOOLSTATION_ORDER, 3, TOOLSTATION_SUBJECT)),
    Extractor("bandq", from_domain("diy.com", "bandq"), _shop("B&Q", BANDQ_ORDER)),
    Extractor("fuel", from_domain("bp.com", "shell.com", "esso.com"), _fuel),
    Extractor("utility", from_domain("edfenergy", "octopus.energy", "britishgas"), _utility),
    Extractor("generic", lambda: F.lit(True), _generic),
)
REGISTRY_VERSION = "registry-1"


def route(extra: tuple[Extractor, ...] = ()) -> Column:
    """Name of the extractor that takes a message."""
    out = F.lit(None).cast("string")
    for e in reversed((*extra, *BUILT_IN)):
        out = F.when(e.condition(), e.name).otherwise(out)
    return out


def classified(messages: DataFrame) -> DataFrame:
    """Messages (sender, subject, body_text, body_html, attachments, ...) with their kind."""
    return messages.withColumn("kind", classify.kind(F.col("sender"), F.col("subject"), F.col("body_text"), F.col("body_html"), F.col("attachments")))


def extract(messages: DataFrame, extra: tuple[Extractor, ...] = ()) -> DataFrame:
    """Extracted slips of classified messages; marketing and statements give none.

    Routes and texts are worked out once and written; every route then reads its own
    messages.  One expression for all routes would be too long a method to be compiled.
    """
    open_ = settle(staged(messages.where(classify.should_extract(F.col("kind"))), extra))
    out = None
    for e in (*extra, *BUILT_IN):
        rows = open_.where(F.col("extractor") == e.name).select("ordinal", "message_id", "kind", "extractor", "issued_at", "issued_offset_sec", e.build().alias("f"))
        out = rows if out is None else out.unionByName(rows)
    flat = out.select("ordinal", F.col("message_id").alias("source_message_id"), "kind", "extractor", "issued_at", "issued_offset_sec", "f.*")
    flat = flat.withColumn("grade", grade(F.col("given_grade"), F.col("supplier"), F.col("issued_at"), F.col("total_minor"), F.col("line_items"), F.col("vat_exempt"), F.col("vat_minor"), F.col("attachment_refs")))
    key = text.family_key(F.col("supplier"), F.col("order_ref"), F.col("issued_at"), F.col("issued_offset_sec"), F.col("total_minor"), F.col("currency"))
    return flat.withColumn("family_key", key).drop("given_grade")


def pending_ocr(extracted: DataFrame) -> DataFrame:
    return extracted.agg(F.count_if(F.col("grade") == "requires_ocr").alias("n"))
