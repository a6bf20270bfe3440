"""Redaction and audit of personal data by dictionaries and patterns."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Literals with their replacements.
DICTIONARY = {
    "Volunteer Name": "REDACTED_NAME",
    "volunteer@example.com": "REDACTED_EMAIL@example.com",
    "1 Example Street, London, SW1A 1AA": "REDACTED_ADDRESS",
    "+44 7700 900123": "REDACTED_PHONE",
    "12345678": "REDACTED_ACCOUNT",
}
# Word borders count ASCII letters only, as the patterns are meant.
_B, _E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
# Patterns, by label, in the order of the audit.
POSTCODE = "(?i)" + _B + r"([A-Z]{1,2}\d[A-Z\d]?\s+\d[A-Z]{2})" + _E
DEAR = "(?i)" + _B + r"Dear\s+(?:Mr|Mrs|Ms|Miss|Dr)\.?\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+"
HI = "(?i)" + _B + r"Hi,?\s+[A-Z][a-z]+" + _E
THANKS = r"(?i)(?:Thanks for your order|anks for your order),?\s+[A-Z][a-z]+!"
NAME_CITY = _B + r"[A-Z][a-z]+\s+(?:=E2=80=93\s*|[–—-]\s*)[A-Z]{2,}" + _E
STREET = "(?i)" + _B + r"\d+\s+[A-Z][A-Za-z\s,]{3,40}(?:Road|Street|Lane|Way|Close|Avenue|Drive|Hill)(?![A-Za-z0-9_])[^,\n]{0,80}(?:,\s*[A-Za-z\s]{2,30})?\s*,?\s*[A-Z]{1,2}\d[A-Z\d]?\s+\d[A-Z]{2}" + _E
ENCODED_CITY = _B + r"[A-Z][a-z]+\s*=E2=80=93\s*[A-Za-z=]+"
TOOLSTATION = "(?i)" + _B + r"YWW\d+" + _E
SCREWFIX = "(?i)" + _B + r"A\d{8,}" + _E
AMAZON_ID = r"(?i)orderID=3D?[A-Z0-9]{8,}"
ORDER_LINE = r"(?i)(?:Order\s+(?:number|#|ref)[:\s]*)(?:A\d{8,}|YWW\d+)"
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
PHONE = r"\+?\d[\d\s\-()]{8,}\d"
PRIVATE_MAIL = ("@hotmail.com", "@outlook.com", "@live.com")
SLUG_ORDERS = r"(?i)(?:yww\d+|a\d{8,}|confirmation-of-your-order-a\d+)"
SLUG_MOST = 64


@dataclass(frozen=True)
class Blocklist:
    email_local_parts: tuple[str, ...] = ()
    area_names: tuple[str, ...] = ()
    literal_names: tuple[str, ...] = ()


def by_dictionary(text: Column, words: dict[str, str] | None = None) -> Column:
    for literal, replacement in (DICTIONARY if words is None else words).items():
        text = F.replace(text, F.lit(literal), F.lit(replacement))
    return text


def _area(name: str) -> str:
    return "(?i)" + _B + "".join(c if c.isalnum() or c in " _" else "\\" + c for c in name) + _E


def by_area(text: Column, block: Blocklist) -> Column:
    for name in block.area_names:
        if name:
            text = F.regexp_replace(text, _area(name), "REDACTED_AREA")
    return text


def by_pattern(text: Column, block: Blocklist = Blocklist()) -> Column:
    """In a fixed order: names, addresses before postcodes, then order numbers."""
    for pattern, replacement in (
        (DEAR, "Dear REDACTED_NAME"), (HI, "Hi, REDACTED_NAME"), (THANKS, "Thanks for your order, REDACTED_NAME!"), (NAME_CITY, "REDACTED_NAME – REDACTED_CITY"),
        (STREET, "REDACTED_ADDRESS"), (ENCODED_CITY, "REDACTED_NAME =E2=80=93 REDACTED_CITY"),
    ):
        text = F.regexp_replace(text, pattern, replacement)
    text = by_area(text, block)
    for pattern, replacement in (
        (POSTCODE, "REDACTED_POSTCODE"), (TOOLSTATION, "REDACTED_ORDER"), (SCREWFIX, "REDACTED_ORDER"), (AMAZON_ID, "orderID=REDACTED"), (ORDER_LINE, "Order number: REDACTED_ORDER"),
    ):
        text = F.regexp_replace(text, pattern, replacement)
    return text


def scrub(text: Column, block: Blocklist = Blocklist(), words: dict[str, str] | None = None) -> Column:
    out = by_pattern(by_dictionary(text, words), block)
    return F.regexp_replace(F.regexp_replace(out, EMAIL, "REDACTED_EMAIL@example.com"), PHONE, "REDACTED_PHONE")


def private_emails(text: Column, block: Blocklist = Blocklist()) -> Column:
    """Only addresses of private mail providers or with a listed local part."""
    local, domain = r"[a-zA-Z0-9._%+\-]", r"[a-zA-Z0-9.\-]"
    # the provider's name must follow the @ at once, as in the whole address
    private = rf"(?i){local}+@(?:hotmail|outlook|live)\.{domain}*[a-zA-Z]{{2,}}"
    text = F.regexp_replace(text, private, "REDACTED_EMAIL@example.com")
    for part in block.email_local_parts:
        if part:
            listed = rf"(?i){local}*{re.escape(part)}{local}*@{domain}+\.[a-zA-Z]{{2,}}"
            text = F.regexp_replace(text, listed, "REDACTED_EMAIL@example.com")
    return text


def scrub_fixture(text: Column, block: Blocklist = Blocklist(), words: dict[str, str] | None = None) -> Column:
    """Keeps the senders of merchants, by which messages are routed."""
    out = by_pattern(private_emails(by_dictionary(text, words), block), block)
    return F.regexp_replace(out, PHONE, "REDACTED_PHONE")


def findings(text: Column, block: Blocklist = Blocklist(), words: dict[str, str] | None = None) -> Column:
    """Labels of what is still there, in a fixed order."""
    words = DICTIONARY if words is None else words
    out = [
        F.when(text.rlike(p), label)
        for label, p in (("uk_postcode", POSTCODE), ("dear_name", DEAR), ("hi_name", HI), ("thanks_order_name", THANKS), ("name_dash_city", NAME_CITY), ("street_address", STREET), ("encoded_name_dash", ENCODED_CITY))
    ]
    area = F.lit(False)
    for name in block.area_names:
        if name:
            area = area | text.rlike(_area(name))
    out.append(F.when(area, "collection_area"))
    out += [F.when(text.rlike(TOOLSTATION), "toolstation_order"), F.when(text.rlike(SCREWFIX), "screwfix_order")]
    ids = F.regexp_extract_all(text, F.lit(f"({AMAZON_ID})"), F.lit(1))
    out.append(F.when(F.exists(ids, lambda x: ~F.contains(F.upper(x), F.lit("REDACTED"))), "amazon_order_id"))
    for p in (*PRIVATE_MAIL, *[x.lower() for x in block.email_local_parts if x], *[x.lower() for x in block.literal_names if x]):
        out.append(F.when(F.contains(F.lower(text), F.lit(p)), f"blocked:{p}"))
    left = F.lit(False)
    for literal in words:
        left = left | F.contains(text, F.lit(literal))
    out.append(F.when(left, "dictionary_literal"))
    return F.array_compact(F.array(*[F.coalesce(c, F.lit(None).cast("string")) for c in out]))


def is_clean(text: Column) -> Column:
    return F.size(findings(text)) == 0


def export(text: Column, block: Blocklist = Blocklist()) -> Column:
    """Scrubbed text; an error where the audit still finds something."""
    out = scrub_fixture(text, block)
    left = findings(out)
    return F.when(F.size(left) == 0, out).otherwise(F.raise_error(F.concat(F.lit("personal data remain: "), F.array_join(left, ", "))))


def merchant_of(raw: Column) -> Column:
    """Folder of a raw message; null where no known merchant occurs."""
    low = F.lower(raw)
    out = F.lit(None).cast("string")
    for words, name in reversed((
        (("toolstation.com",), "toolstation"), (("screwfix.com",), "screwfix"), (("amazon.co.uk", "amazon.com"), "amazon"), (("diy.com", "bandq"), "bandq"),
        (("shell.com",), "shell"), (("bp.com",), "bp"), (("octopus.energy",), "octopus"), (("edfenergy",), "edf"),
    )):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, name).otherwise(out)
    return out


def slug(name: Column) -> Column:
    """Stable base name without order numbers."""
    base = F.regexp_replace(name, "^.*/", "")
    base = F.lower(F.regexp_replace(base, r"\.[^.]*$", ""))
    base = F.regexp_replace(F.regexp_replace(F.regexp_replace(base, SLUG_ORDERS, "order"), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    cut = F.when(F.length(base) > SLUG_MOST, F.regexp_replace(F.substring(base, 1, SLUG_MOST), "-+$", "")).otherwise(base)
    return F.when(base == "", "fixture").otherwise(cut)


def is_plain_slug(name: Column) -> Column:
    return name.rlike("^[A-Za-z0-9-]*$")


def fixture_path(merchant: Column, base: Column) -> Column:
    return F.concat(F.lit("merchants/"), merchant, F.lit("/"), base, F.lit(".eml"))
