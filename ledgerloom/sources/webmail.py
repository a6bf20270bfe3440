"""Mailboxes behind two web interfaces, as Python data sources.

The driver lists message ids (first page, at most 100), executors fetch and parse
them.  ``base_url`` points elsewhere in tests.
"""

from __future__ import annotations

import base64
import json
import urllib.parse
import urllib.request
from dataclasses import dataclass
from datetime import datetime, timezone
from urllib.error import HTTPError

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .maildir import PARSED, parse_rfc822

PAGE = 100
ERROR_BYTES = 4096


class NotConfigured(RuntimeError):
    """No token file or no access token in it."""


class TokenExpired(RuntimeError):
    pass


@dataclass(frozen=True)
class Token:
    access_token: str
    token_type: str = "Bearer"
    expiry: datetime | None = None

    def expired(self, now: datetime) -> bool:
        """A token without expiry never expires."""
        return self.expiry is not None and now > self.expiry

    def header(self) -> str:
        return f"{self.token_type} {self.access_token}"


def load_token(path: str) -> Token:
    try:
        with open(path) as f:
            raw = json.load(f)
    except FileNotFoundError as e:
        raise NotConfigured(path) from e
    if not raw.get("access_token"):
        raise NotConfigured("access token missing")
    expiry = raw.get("expiry")
    at = datetime.fromisoformat(expiry.replace("Z", "+00:00")) if expiry else None
    return Token(raw["access_token"], raw.get("token_type") or "Bearer", at)


def _get(url: str, auth: str) -> bytes:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"Authorization": auth}), timeout=60) as r:
            return r.read()
    except HTTPError as e:
        raise RuntimeError(f"HTTP {e.code}: {e.read(ERROR_BYTES).decode('utf-8', 'replace')}") from e


def padded_base64url(text: str) -> bytes:
    return base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))


class _Page(InputPartition):
    def __init__(self, ids: list[str]):
        self.ids = ids


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.base = options.get("base_url", self.BASE).rstrip("/")
        self.mailbox = options.get("mailbox_id", "")
        self.since = datetime.fromisoformat(options["since"]) if options.get("since") else None
        if self.since is not None and self.since.tzinfo is None:
            self.since = self.since.replace(tzinfo=timezone.utc)
        token = load_token(options.get("token_path", ""))
        if token.expired(datetime.now(timezone.utc)):
            raise TokenExpired(options.get("token_path", ""))
        self.auth = token.header()
        self.per_task = int(options.get("messages_per_task", "10"))

    def partitions(self):
        ids = self.list_ids()
        return [_Page(ids[i : i + self.per_task]) for i in range(0, len(ids), self.per_task)] or [_Page([])]

    def read(self, partition):
        for mid in partition.ids:
            row = parse_rfc822(self.fetch(mid))
            if self.since is not None and (row["date_micros"] is None or row["date_micros"] < int(self.since.timestamp() * 1_000_000)):
                continue
            yield (mid, self.mailbox, row["sender"], row["to_raw"], row["subject"], row["date_micros"], row["date_offset_sec"], row["body_text"], row["body_html"], row["headers"], [(a["filename"], a["content_type"], a["content"]) for a in row["attachments"]], None)


class GmailReader(_Reader):
    BASE = "https://gmail.googleapis.com/gmail/v1/users/me"

    def list_ids(self) -> list[str]:
        query = {"maxResults": PAGE}
        if self.since is not None:
            query["q"] = self.since.strftime("after:%Y/%m/%d")
        found = json.loads(_get(f"{self.base}/messages?{urllib.parse.urlencode(query)}", self.auth))
        return [m["id"] for m in found.get("messages", [])]

    def fetch(self, mid: str) -> bytes:
        return padded_base64url(json.loads(_get(f"{self.base}/messages/{urllib.parse.quote(mid)}?format=raw", self.auth))["raw"])


class GraphReader(_Reader):
    BASE = "https://graph.microsoft.com/v1.0/me"

    def list_ids(self) -> list[str]:
        query = {"$top": PAGE, "$select": "id"}
        if self.since is not None:
            query["$filter"] = "receivedDateTime ge " + self.since.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        found = json.loads(_get(f"{self.base}/messages?{urllib.parse.urlencode(query)}", self.auth))
        return [m["id"] for m in found.get("value", [])]

    def fetch(self, mid: str) -> bytes:
        return _get(f"{self.base}/messages/{urllib.parse.quote(mid)}/$value", self.auth)


class _MailSource(DataSource):
    READER: type[_Reader]

    def schema(self) -> str:
        return "message_id string, mailbox_id string, " + PARSED

    def reader(self, schema):
        return self.READER(self.options)


class GmailSource(_MailSource):
    READER = GmailReader

    @classmethod
    def name(cls) -> str:
        return "ledgerloom-gmail"


class GraphSource(_MailSource):
    READER = GraphReader

    @classmethod
    def name(cls) -> str:
        return "ledgerloom-graph"


def register(spark) -> None:
    for source in (GmailSource, GraphSource):
        spark.dataSource.register(source)
