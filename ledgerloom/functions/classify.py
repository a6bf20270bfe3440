"""Kind of a message from sender, subject, body and attachments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RULES = "kinds-by-signal-1"
# Words that speak for a kind.
MARKETING = ("unsubscribe", "sale ends", "limited time offer", "newsletter", "your receipt awaits", "complete your purchase")
CREDIT = ("credit note", "refund confirmation", "return processed")
PURCHASE = ("receipt", "invoice", "order confirmation", "your order", "payment received")
EXTRACTED_KINDS = ("purchase_receipt", "credit_note", "dispatch_notice", "unknown")
BEARING_KINDS = ("purchase_receipt", "credit_note", "dispatch_notice")


def _any(text: Column, words: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(text, F.lit(w))
    return hit


def is_marketing(sender: Column, subject: Column, body: Column) -> Column:
    return _any(subject, MARKETING) | _any(body, MARKETING) | _any(sender, ("marketing@", "news@"))


def is_statement(sender: Column, subject: Column) -> Column:
    return _any(subject, ("monthly statement", "account summary")) | _any(sender, ("statements@",))


def is_credit_note(subject: Column, body: Column) -> Column:
    back = (_any(subject, ("money back",)) | _any(body, ("money back",))) & ~_any(body, ("money back guarantee",))
    return _any(subject, CREDIT) | _any(body, CREDIT) | back


def is_dispatch(subject: Column, body: Column) -> Column:
    total = _any(body, ("order total", "total paid")) | (_any(body, ("total",)) & _any(body, ("£",)))
    return _any(subject, ("dispatched", "shipped")) & ~total


def is_purchase(subject: Column, body: Column, attachments: Column) -> Column:
    named = F.coalesce(F.exists(attachments, lambda a: _any(F.lower(F.coalesce(a["filename"], F.lit(""))), ("invoice", "receipt"))), F.lit(False))
    return _any(subject, PURCHASE) | _any(body, PURCHASE) | _any(body, ("order total", "total paid")) | named


def kind(sender: Column, subject: Column, text: Column, html: Column, attachments: Column) -> Column:
    """marketing, statement, credit_note, dispatch_notice, purchase_receipt or unknown; first that fits."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    f, s = low(sender), low(subject)
    b = F.concat(low(text), F.lit(" "), low(html))
    return (
        F.when(is_marketing(f, s, b), "marketing").when(is_statement(f, s), "statement").when(is_credit_note(s, b), "credit_note")
        .when(is_dispatch(s, b), "dispatch_notice").when(is_purchase(s, b, attachments), "purchase_receipt").otherwise("unknown")
    )


def should_extract(kind: Column) -> Column:
    return kind.isin(*EXTRACTED_KINDS)


def is_bearing(kind: Column) -> Column:
    return kind.isin(*BEARING_KINDS)
