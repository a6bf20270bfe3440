"""Prices in JSON-LD and text in PDF files: the two formats no built-in function reads."""

from __future__ import annotations

import json
import re
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .amount import pounds_to_minor
from .text import money_token

_LD = re.compile(r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>")
_SHOWN = re.compile(rb"\(([^)\\]*(?:\\.[^)\\]*)*)\)\s*Tj", re.S)


def _price(node) -> tuple[bool, str | None]:
    """(search ended, price text).  An own price ends the search of its object even if unreadable."""
    if isinstance(node, dict):
        if "price" in node:
            p = node["price"]
            return True, p.removeprefix("£") if isinstance(p, str) else None
        order = (["offers"] if "offers" in node else []) + sorted(node)
        for key in order:
            ended, found = _price(node[key])
            if ended and found is not None:
                return True, found
    elif isinstance(node, list):
        for item in node:
            ended, found = _price(item)
            if ended and found is not None:
                return True, found
    return False, None


def json_ld_price(html: str | None) -> str | None:
    for m in _LD.finditer(html or ""):
        try:
            doc = json.loads(m[1].strip())
        except ValueError:
            continue
        _, found = _price(doc)
        if found is not None:
            return found
    return None


def json_ld_total(html: Column) -> Column:
    """Price of the first structured-data block with one; JSON numbers are not taken."""
    udf = F.pandas_udf(lambda s: pd.Series([json_ld_price(x) for x in s], dtype=object), "string")
    looks = F.coalesce(F.contains(F.lower(html), F.lit("ld+json")), F.lit(False))
    return pounds_to_minor(udf(F.when(looks, html)))


def _literals(data: bytes) -> str:
    out = []
    for m in _SHOWN.finditer(data):
        s = m[1].decode("utf-8", "replace")
        for a, b in ((r"\n", "\n"), (r"\r", "\r"), (r"\t", "\t"), (r"\(", "("), (r"\)", ")"), ("\\\\", "\\")):
            s = s.replace(a, b)
        out.append(s + " ")
    return "".join(out)


def _streams(data: bytes):
    at = 0
    while (i := data.find(b"stream", at)) >= 0:
        start = i + 6
        start += data[start : start + 1] == b"\r"
        start += data[start : start + 1] == b"\n"
        end = data.find(b"endstream", start)
        if end < 0:
            return
        try:
            d = zlib.decompressobj(-15)
            text = d.decompress(data[start:end])
            if d.eof:
                yield text
        except zlib.error:
            pass
        at = end


def pdf_text(data: bytes | None) -> str:
    """Shown text of a PDF with a text layer; '' for encrypted, scanned and other files."""
    if data is None or len(data) < 5 or not data.startswith(b"%PDF") or b"/Encrypt" in data:
        return ""
    parts = [_literals(data)]
    for chunk in _streams(data):
        parts += [_literals(chunk), chunk.decode("utf-8", "replace")]
    return "".join(parts)


def pdf_texts(attachments: Column) -> Column:
    """Texts of the PDF attachments, in order, with their file names."""

    def run(lists: pd.Series) -> pd.Series:
        out = []
        for items in lists:
            found = []
            for a in items if items is not None else []:
                if "pdf" in (a["content_type"] or "").lower():
                    data = a["content"]
                    found.append({"filename": a["filename"], "text": pdf_text(bytes(data) if data is not None else None)})
            out.append(found)
        return pd.Series(out)

    udf = F.pandas_udf(run, "array<struct<filename:string,text:string>>")
    none = F.array().cast("array<struct<filename:string,text:string>>")
    return F.when(F.size(F.coalesce(attachments, F.array().cast("array<struct<filename:string,content_type:string,content:binary>>"))) > 0, udf(attachments)).otherwise(none)


def pdf_total(text: Column) -> Column:
    at = F.locate("total", F.lower(text))
    return F.coalesce(F.when(at > 0, money_token(F.substr(text, at))), money_token(text))
