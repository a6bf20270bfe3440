"""How complete an extracted slip is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOLERANCE = 2


def line_sum(items: Column) -> Column:
    """Net amounts and positive VAT."""
    return F.aggregate(items, F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x["net_minor"], F.lit(0)) + F.greatest(F.coalesce(x["vat_minor"], F.lit(0)), F.lit(0)))


def vat_sum(items: Column) -> Column:
    return F.aggregate(items, F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x["vat_minor"], F.lit(0)))


def adds_up(items: Column, total: Column) -> Column:
    return F.abs(line_sum(items) - F.coalesce(total, F.lit(0))) <= TOLERANCE


def is_itemised(items: Column) -> Column:
    return F.coalesce(F.size(items) > 0, F.lit(False))


def grade(given: Column, supplier: Column, issued: Column, total: Column, items: Column, vat_exempt: Column, vat: Column, attachment_refs: Column) -> Column:
    """requires_ocr, envelope, partial or itemised."""
    identity = (F.coalesce(supplier, F.lit("")) != "") & issued.isNotNull() & (F.coalesce(total, F.lit(0)) > 0)
    has_vat = F.coalesce(vat_exempt, F.lit(False)) | (F.coalesce(vat, F.lit(0)) > 0) | F.coalesce(F.exists(items, lambda x: x["vat_minor"] > 0), F.lit(False))
    pending = F.coalesce(F.size(attachment_refs) > 0, F.lit(False))
    return (
        F.when(F.coalesce(given, F.lit("")) == "requires_ocr", "requires_ocr")
        .when(~identity, F.when(pending, "requires_ocr").otherwise("envelope"))
        .when(~is_itemised(items), "envelope").when(~has_vat, "partial").when(~adds_up(items, total), "partial").otherwise("itemised")
    )


GRADE_RANK = {"itemised": 4, "partial": 3, "envelope": 2, "requires_ocr": 1}
KIND_RANK = {"purchase_receipt": 3, "credit_note": 2, "dispatch_notice": 1}


def rank(value: Column, table: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for name, n in table.items():
        out = F.when(value == name, n).otherwise(out)
    return out
