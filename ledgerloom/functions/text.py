"""Amounts, references and line items out of message text, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .amount import matched_minor
from .temporal import local_date

# Patterns of totals, references and lines.
TOTAL = r"(?i)total[:\s]*£\s*(-?[0-9]+(?:\.[0-9]{2})?)"
TOTAL_INC_VAT = r"(?i)total\s*\(inc\.?\s*vat\)[^£\d]{0,24}£\s*([0-9]+(?:\.[0-9]{2})?)"
TOTAL_PAID = r"(?i)total\s+paid[:\s]*£?\s*(-?[0-9]+(?:\.[0-9]{2})?)"
TOTAL_GBP = r"(?is)total\s+(-?[0-9]+(?:\.[0-9]{2})?)\s+gbp"
REFUND = r"(?i)refund[:\s]*£\s*(-?[0-9]+(?:\.[0-9]{2})?)"
ORDER_REF = r"(?i)order\s*(?:#|no\.?|number)[:\s]*([A-Z0-9\-]+)"
LINE_ITEM = r"(?i)([A-Za-z0-9][^\n]{2,40})\s+£\s*(-?[0-9]+\.[0-9]{2})"
MONEY = r"£\s*(-?[0-9]+(?:\.[0-9]{2})?)"
TABLE_ROW = r"(?is)<tr[^>]*>(.*?)</tr>"
TABLE_CELL = r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"

SPACES = r"[\s\u0085   -     　]+"


def visible(html: Column) -> Column:
    """Tags to blanks, two entities, blanks collapsed; script contents stay."""
    bare = F.regexp_replace(html, "<[^>]+>", " ")
    bare = F.replace(F.replace(bare, F.lit("&nbsp;"), F.lit(" ")), F.lit("&pound;"), F.lit("£"))
    return F.trim(F.regexp_replace(bare, SPACES, " "))


def capture(text: Column, pattern: str, group: int = 1) -> Column:
    """First capture, null where nothing or an empty text is captured."""
    found = F.regexp_extract(text, pattern, group)
    return F.when(found != "", found)


def money_token(text: Column) -> Column:
    return matched_minor(capture(text, MONEY))


def inline_total(text: Column) -> Column:
    return matched_minor(capture(text, TOTAL))


def table_total(html: Column) -> Column:
    """Amount of the last table row whose label says total, not subtotal and not without VAT."""
    rows = F.regexp_extract_all(html, F.lit(TABLE_ROW), F.lit(1))
    cells = F.transform(rows, lambda row: F.regexp_extract_all(row, F.lit(TABLE_CELL), F.lit(1)))
    label = lambda c: F.lower(visible(F.get(c, F.lit(0))))
    fits = F.filter(
        cells,
        lambda c: (F.size(c) >= 2) & F.contains(label(c), F.lit("total")) & ~F.contains(label(c), F.lit("subtotal")) & ~(F.contains(label(c), F.lit("ex.")) & F.contains(label(c), F.lit("vat"))),
    )
    amounts = F.filter(F.transform(fits, lambda c: money_token(visible(F.element_at(c, -1)))), lambda x: x.isNotNull())
    return F.try_element_at(amounts, F.lit(-1))


def body_total(body: Column) -> Column:
    """Total including VAT, inline, table, paid, GBP, refund; the last three end the search once they match."""
    paid, gbp, refund = (capture(body, p) for p in (TOTAL_PAID, TOTAL_GBP, REFUND))
    late = F.when(paid.isNotNull(), matched_minor(paid)).when(gbp.isNotNull(), matched_minor(gbp)).when(refund.isNotNull(), matched_minor(refund))
    return F.coalesce(matched_minor(capture(body, TOTAL_INC_VAT)), inline_total(body), table_total(body), late)


def first_total(text: Column, html_visible: Column) -> Column:
    """From the text part, else from the visible HTML."""
    return F.coalesce(F.when(text != "", body_total(text)), F.when(html_visible != "", body_total(html_visible)))


def order_ref(text: Column) -> Column:
    return F.coalesce(capture(text, ORDER_REF), F.lit(""))


LINE_TYPE = "array<struct<description:string,net_minor:bigint,vat_minor:bigint>>"


def line_items(body: Column, drop_vat: bool = True, with_vat: bool = False) -> Column:
    """Descriptions with amounts; VAT lines are left out unless ``drop_vat`` is off."""
    names = F.regexp_extract_all(body, F.lit(LINE_ITEM), F.lit(1))
    sums = F.regexp_extract_all(body, F.lit(LINE_ITEM), F.lit(2))
    made = F.zip_with(names, sums, lambda d, m: F.struct(F.trim(d).alias("description"), matched_minor(m).alias("net_minor")))
    low = lambda x: F.lower(x["description"])
    keep = lambda x: x["net_minor"].isNotNull() & (~((low(x) == "vat") | F.startswith(low(x), F.lit("vat "))) if drop_vat else F.lit(True))
    vat = lambda x: (F.signum(x["net_minor"]).cast("bigint") * F.floor(F.abs(x["net_minor"]) / 5)) if with_vat else F.lit(0).cast("bigint")
    items = F.transform(F.filter(made, keep), lambda x: F.struct(x["description"].alias("description"), x["net_minor"].alias("net_minor"), vat(x).alias("vat_minor")))
    return F.coalesce(items, F.array()).cast(LINE_TYPE)


def merged_body(text: Column, html: Column, html_visible: Column) -> Column:
    """Text part and visible HTML, the text part first; no argument is null."""
    return F.when((text != "") & (html != ""), F.concat(text, F.lit("\n"), html_visible)).when(html != "", html_visible).otherwise(text)


def supplier_from_sender(sender: Column) -> Column:
    """Second-level part of the sender's domain, first letter in capitals."""
    low = F.lower(sender)
    domain = F.regexp_replace(F.substring_index(low, "@", -1), ">$", "")
    parts = F.split(domain, r"\.")
    name = F.try_element_at(parts, F.lit(-2))
    named = F.when(name == "", domain).otherwise(F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 1_000_000)))
    return F.when(~F.contains(low, F.lit("@")), F.trim(low)).when(F.size(parts) >= 2, named).otherwise(domain)


def family_key(supplier: Column, ref: Column, issued: Column, offset: Column, total: Column, currency: Column) -> Column:
    """Supplier and order reference, else supplier, local day, total and currency."""
    by_day = F.concat_ws("|", F.lower(supplier), F.coalesce(local_date(issued, offset), F.lit("0001-01-01")), F.coalesce(total, F.lit(0)).cast("string"), F.upper(currency))
    return F.when(F.coalesce(ref, F.lit("")) != "", F.concat_ws("|", F.lower(supplier), F.upper(ref))).otherwise(by_day)


def fingerprint(supplier: Column, issued: Column, offset: Column, total: Column) -> Column:
    return F.concat_ws("|", F.lower(supplier), F.coalesce(local_date(issued, offset), F.lit("0001-01-01")), F.coalesce(total, F.lit(0)).cast("string"))


# Tax category of known merchants.
CATEGORIES = {
    "Amazon": "materials", "Screwfix": "materials", "Toolstation": "materials", "B&Q": "materials",
    "Shell": "motor", "BP": "motor", "Esso": "motor", "Octopus": "overheads", "EDF": "overheads",
}


def merchant_category(merchant: Column) -> Column:
    pairs = [F.lit(x) for kv in CATEGORIES.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), merchant)
