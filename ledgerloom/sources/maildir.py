"""Maildir folders and single RFC 822 files as message tables."""

from __future__ import annotations

import base64
import binascii
import email
import email.policy
import email.utils
import os
import quopri
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARSED = (
    "sender string, to_raw string, subject string, date_micros bigint, date_offset_sec int, body_text string, body_html string, headers map<string,string>, "
    "attachments array<struct<filename:string,content_type:string,content:binary>>, failure string"
)


def _text(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


def _decoded(raw: bytes, encoding: str) -> str:
    """Transfer encoding undone; undecodable bytes come out as they are."""
    encoding = encoding.strip().lower()
    try:
        if encoding == "quoted-printable":
            return _text(quopri.decodestring(raw))
        if encoding == "base64":
            return _text(base64.b64decode(b"".join(raw.split()), validate=True))
    except (ValueError, binascii.Error):
        pass
    return _text(raw)


def _raw(part) -> bytes:
    payload = part.get_payload(decode=False)
    return payload.encode("utf-8", "surrogateescape") if isinstance(payload, str) else b""


def _walk(message, found: dict, decode_attachments: bool) -> None:
    for part in message.get_payload():
        kind = part.get_content_type()
        if part.is_multipart() and kind.startswith("multipart/"):
            _walk(part, found, decode_attachments)
            continue
        disposition = part.get("Content-Disposition", "") or ""
        name = part.get_param("name") or ""
        raw = _raw(part)
        encoding = part.get("Content-Transfer-Encoding", "") or ""
        if "attachment" in disposition or name:
            # quoted-printable is undone for every part; base64 only on request
            content = quopri.decodestring(raw) if encoding.strip().lower() == "quoted-printable" else raw
            if decode_attachments and encoding.strip().lower() == "base64":
                content = base64.b64decode(b"".join(raw.split()))
            found["attachments"].append({"filename": part.get_filename() or str(name), "content_type": kind, "content": content})
            continue
        body = _decoded(raw, encoding)
        for slot in ("html", "plain"):
            if kind == f"text/{slot}" and len(body) > len(found[slot]):
                found[slot] = body


def parse_rfc822(data: bytes, decode_attachments: bool = False) -> dict:
    """Header values as sent (first of each), the longest text and HTML part, attachments."""
    message = email.message_from_bytes(data, policy=email.policy.compat32)
    headers: dict[str, str] = {}
    for k, v in message.items():
        headers.setdefault(k.title(), str(v))
    found = {"html": "", "plain": "", "attachments": []}
    kind = message.get("Content-Type", "") or ""
    if kind.lower().startswith("multipart/"):
        if not message.get_boundary():
            raise ValueError("multipart without boundary")
        if message.is_multipart():
            _walk(message, found, decode_attachments)
    else:
        found["html" if "html" in kind.lower() else "plain"] = _decoded(_raw(message), message.get("Content-Transfer-Encoding", "") or "")
    micros = offset = None
    try:
        at = email.utils.parsedate_to_datetime(headers["Date"])
        offset = int(at.utcoffset().total_seconds()) if at.tzinfo else 0
        at = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
        gap = at - datetime(1970, 1, 1, tzinfo=timezone.utc)
        micros = (gap.days * 86400 + gap.seconds) * 1_000_000 + gap.microseconds
    except (KeyError, ValueError, TypeError):
        pass
    return {
        "sender": headers.get("From", ""), "to_raw": headers.get("To", ""), "subject": headers.get("Subject", ""), "date_micros": micros, "date_offset_sec": offset,
        "body_text": found["plain"], "body_html": found["html"], "headers": headers, "attachments": found["attachments"], "failure": None,
    }


def split_addresses(raw: Column) -> Column:
    """At every comma; empty pieces are dropped."""
    return F.filter(F.transform(F.split(raw, ","), lambda x: F.trim(x)), lambda x: x != "")


def message_name(path: Column) -> Column:
    """File name without its flag suffix."""
    name = F.regexp_extract(path, "[^/]+$", 0)
    plain = F.split_part(name, F.lit(":2,"), F.lit(1))
    return F.when(plain != "", plain).otherwise("fixture")


def parse_files(files: DataFrame, mailbox_id: str, strict: bool = True, decode_attachments: bool = False) -> DataFrame:
    """Messages of (path, content); one bad file fails all unless ``strict`` is off."""

    def run(batches):
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    row = parse_rfc822(bytes(content), decode_attachments)
                except Exception as e:
                    if strict:
                        raise ValueError(f"parse {path}: {e}") from e
                    row = dict.fromkeys(("sender", "to_raw", "subject", "date_micros", "date_offset_sec", "body_text", "body_html", "headers", "attachments")) | {"failure": str(e)}
                rows.append({"path": path, **row})
            frame = pd.DataFrame(rows, columns=["path", *[c.split()[0] for c in _columns()]])
            frame["date_micros"] = frame["date_micros"].astype("Int64")
            frame["date_offset_sec"] = frame["date_offset_sec"].astype("Int32")
            yield frame

    parsed = files.select("path", "content").mapInPandas(run, "path string, " + PARSED)
    return parsed.select(
        "path", message_name(F.col("path")).alias("message_id"), F.lit(mailbox_id).alias("mailbox_id"), "sender", split_addresses(F.col("to_raw")).alias("to_addrs"), "subject",
        F.timestamp_micros("date_micros").alias("issued_at"), F.col("date_offset_sec").alias("issued_offset_sec"), "body_text", "body_html", "headers", "attachments", "failure",
    )


def _columns() -> list[str]:
    return ["sender s", "to_raw s", "subject s", "date_micros b", "date_offset_sec i", "body_text s", "body_html s", "headers m", "attachments a", "failure s"]


def _contents(batches):
    for pdf in batches:
        data = []
        for path in pdf["path"]:
            with open(path, "rb") as f:
                data.append(f.read())
        yield pd.DataFrame({"path": pdf["path"], "content": data})


def read_maildir(spark: SparkSession, root: str, mailbox_id: str, since=None, strict: bool = True) -> DataFrame:
    """Messages of cur/ and new/ dated at or after ``since``; missing folders are empty, sub-folders skipped.

    Names of the files are listed here and their contents read by the executors, as
    names with flags hold colons, which Hadoop's paths don't take.  A message whose
    date can't be read counts as oldest.
    """
    paths = []
    for sub in ("cur", "new"):
        folder = os.path.join(root, sub)
        if os.path.isdir(folder):
            with os.scandir(folder) as entries:
                paths += [e.path for e in entries if e.is_file()]
    listed = spark.createDataFrame([(p,) for p in sorted(paths)], "path string")
    files = listed.repartition(max(1, min(len(paths) // 200 + 1, 10_000))).mapInPandas(_contents, "path string, content binary")
    out = parse_files(files, mailbox_id, strict)
    return out if since is None else out.where(F.col("issued_at") >= F.lit(since))


def read_eml_folder(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content, raw) of the .eml files of one folder, whatever the case of the suffix."""
    files = spark.read.format("binaryFile").load(folder).where(F.col("path").rlike(r"(?i)\.eml$"))
    return files.select("path", "content", F.col("content").cast("string").alias("raw"))
