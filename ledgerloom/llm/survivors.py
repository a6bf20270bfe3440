"""Best representative of each group of duplicate records, field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import component_labels, star_edges

FIELDS = ("supplier", "order_ref", "total_minor", "vat_minor", "issued_at", "category")
#: Best first.
PROVENANCE = ("schema_org", "html", "pdf_text", "subject", "header", "none")
GRADES = ("itemised", "partial", "envelope", "requires_ocr")

_BLANK = r"[\s\p{Z}\p{C}]+"


def _filled(text: Column) -> Column:
    return F.coalesce(F.regexp_replace(text, _BLANK, "") != "", F.lit(False))


def _folded(text: Column) -> Column:
    """Letters and digits only, lower case."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{M}\p{N}]+", ""))


def _order_key(supplier: Column, number: Column) -> Column:
    s, n = _folded(supplier), _folded(number)
    return F.when((s != "") & (n != ""), F.concat(F.lit("o:"), s, F.lit("|"), n))


def purchase_links(extracted: DataFrame) -> DataFrame:
    """(extracted_id, k): the keys by which rows other than credit notes hang together.

    Merged-from entries count only where some row has that source message, so two
    rows that name the same lost mail are not linked by it.
    """
    rows = extracted.where("kind is null or kind <> 'credit_note'").select("extracted_id", "source_message_id", "supplier", "order_ref", "family_key", "merged_from")
    mail = rows.where(_filled(F.col("source_message_id"))).select("extracted_id", F.concat(F.lit("m:"), "source_message_id").alias("k"))
    merged = rows.select("extracted_id", F.explode("merged_from").alias("m")).where(_filled(F.col("m"))).select("extracted_id", F.concat(F.lit("m:"), "m").alias("k"))
    merged = merged.join(mail.select("k").distinct(), "k", "left_semi").select("extracted_id", "k")
    pieces = F.split("family_key", r"\|", -1)
    by_family = F.when(_filled(F.col("family_key")), F.when(F.size(pieces) == 2, _order_key(pieces[0], F.get(pieces, F.lit(1)))))
    by_order = F.when(~_filled(F.col("family_key")) & _filled(F.col("supplier")) & _filled(F.col("order_ref")), _order_key(F.col("supplier"), F.col("order_ref")))
    order = rows.select("extracted_id", F.coalesce(by_family, by_order).alias("k")).where("k is not null")
    return mail.unionByName(merged).unionByName(order)


def families(extracted: DataFrame) -> DataFrame:
    """(extracted_id, family_id) of purchases with two or more rows."""
    labels = component_labels(star_edges(purchase_links(extracted), "extracted_id", "k"))
    members = labels.select(F.col("u").alias("extracted_id"), F.col("v").alias("family_id"))
    return members.unionByName(members.select(F.col("family_id").alias("extracted_id"), "family_id").distinct())


def _place(value: Column, order: tuple[str, ...]) -> Column:
    place = F.lit(len(order))
    for n, name in reversed(list(enumerate(order))):
        place = F.when(value == name, F.lit(n)).otherwise(place)
    return place


def field_sources(extracted: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(family_id, field_name, extracted_id): where each field of a survivor comes from.

    Rows with a value that is neither null nor blank are ranked by provenance of
    the field (a missing or unknown entry counts as none), grade (unknown last),
    latest issued_at (null last) and smallest extracted_id.  The window asks for
    rank one only, which Spark also applies before the shuffle, so a group of any
    size reaches its task as one row per upstream task.  Families where no row has
    a value for a field give no row; an empty table gives an empty result.
    """
    members = families(extracted) if members is None else members
    entry = lambda f: F.coalesce(F.lower(F.element_at("field_provenance", F.lit(f))), F.lit("none"))
    has = {f: _filled(F.col(f)) if f in ("supplier", "order_ref", "category") else F.col(f).isNotNull() for f in FIELDS}
    offers = F.array_compact(F.array(*[F.when(has[f], F.struct(F.lit(f).alias("field_name"), _place(entry(f), PROVENANCE).alias("provenance"))) for f in FIELDS]))
    rows = extracted.select("extracted_id", "issued_at", _place(F.col("grade"), GRADES).alias("grade_place"), offers.alias("offers"))
    offered = rows.join(members, "extracted_id").select("family_id", "extracted_id", "issued_at", "grade_place", F.explode("offers").alias("o"))
    best = Window.partitionBy("family_id", "field_name").orderBy("provenance", "grade_place", F.col("issued_at").desc_nulls_last(), "extracted_id")
    ranked = offered.select("family_id", "extracted_id", "issued_at", "grade_place", "o.*").withColumn("__rank", F.row_number().over(best))
    return ranked.where("__rank = 1").select("family_id", "field_name", "extracted_id")


def surviving_records(extracted: DataFrame) -> DataFrame:
    """One built record per purchase of two or more rows, with its source rows."""
    members = families(extracted)
    chosen = field_sources(extracted, members)
    values = extracted.select("extracted_id", *FIELDS)
    taken = chosen.join(values, "extracted_id")
    built = taken.groupBy("family_id").agg(
        *[F.max(F.when(F.col("field_name") == f, F.col(f))).alias(f) for f in FIELDS],
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("field_name", "extracted_id")))).alias("field_sources"),
    )
    return built.join(members.groupBy("family_id").agg(F.count(F.lit(1)).alias("n_rows")), "family_id")
