"""From messages to canonical slips."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.extraction import Extractor, classified, extract
from ..operators.families import canonical_slips, resolve_families
from ..workspace import settle


@dataclass
class Ingested:
    classified: DataFrame
    extracted: DataFrame
    resolved: DataFrame
    slips: DataFrame
    pending_ocr: DataFrame


def ingest(messages: DataFrame, since=None, extra: tuple[Extractor, ...] = ()) -> Ingested:
    """``messages``: ordinal, message_id, sender, subject, body_text, body_html, attachments, issued_at, issued_offset_sec.

    ``since`` keeps messages at or after it.
    """
    if since is not None:
        messages = messages.where(F.col("issued_at") >= F.lit(since))
    seen = classified(messages)
    found = settle(extract(seen, extra))  # read several times below
    resolved = resolve_families(found)
    return Ingested(seen, found, resolved, canonical_slips(resolved), found.where("grade = 'requires_ocr'"))
