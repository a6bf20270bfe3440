import base64
import json
import threading
from datetime import datetime, timedelta, timezone
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from ledgerloom.plans.scrub_mail import scrubbed
from ledgerloom.sources import maildir, scenarios, sinks, webmail

PLAIN = b"From: a@b.example\r\nTo: x@y.example, z@y.example\r\nSubject: Hello\r\nDate: Mon, 01 Jan 2024 12:00:00 +0100\r\n\r\nbody"
PARTS = (
    b'From: a@b.example\r\nDate: Tue, 02 Jan 2024 12:00:00 +0000\r\nContent-Type: multipart/mixed; boundary="q"\r\n\r\n--q\r\nContent-Type: multipart/alternative; boundary="r"\r\n\r\n'
    b"--r\r\nContent-Type: text/plain\r\nContent-Transfer-Encoding: quoted-printable\r\n\r\nTotal =C2=A39.99\r\n--r\r\nContent-Type: text/html\r\nContent-Transfer-Encoding: base64\r\n\r\n" + base64.b64encode(b"<p>hi</p>") + b"\r\n--r--\r\n"
    b'--q\r\nContent-Type: application/pdf; name="i.pdf"\r\nContent-Disposition: attachment; filename="j.pdf"\r\nContent-Transfer-Encoding: base64\r\n\r\nJVBERg==\r\n--q--\r\n'
)


def test_parse():
    m = maildir.parse_rfc822(PARTS)
    assert m["body_text"].strip() == "Total £9.99" and m["body_html"] == "<p>hi</p>"
    assert m["attachments"][0]["filename"] == "j.pdf" and m["attachments"][0]["content"].strip() == b"JVBERg=="
    assert maildir.parse_rfc822(PARTS, decode_attachments=True)["attachments"][0]["content"] == b"%PDF"
    with pytest.raises(ValueError):
        maildir.parse_rfc822(b"Content-Type: multipart/mixed\r\n\r\nx")
    assert maildir.parse_rfc822(b"Subject: x\r\nDate: never\r\n\r\nb")["date_micros"] is None


def test_maildir(spark, tmp_path):
    for sub, name, data in (("cur", "m1:2,S", PLAIN), ("new", "m2", PARTS), ("tmp", "m3", PLAIN)):
        (tmp_path / sub).mkdir()
        (tmp_path / sub / name).write_bytes(data)
    df = maildir.read_maildir(spark, str(tmp_path), "box")
    got = {r.message_id: r for r in df.collect()}
    assert set(got) == {"m1", "m2"} and got["m1"].to_addrs == ["x@y.example", "z@y.example"] and got["m1"].issued_offset_sec == 3600
    assert maildir.read_maildir(spark, str(tmp_path), "box", datetime(2024, 1, 2)).count() == 1
    assert maildir.read_maildir(spark, str(tmp_path / "none"), "box").count() == 0
    (tmp_path / "cur" / "bad").write_bytes(b"Content-Type: multipart/mixed\r\n\r\nx")
    with pytest.raises(Exception, match="parse"):
        maildir.read_maildir(spark, str(tmp_path), "box").collect()
    assert maildir.read_maildir(spark, str(tmp_path), "box", strict=False).where("failure is not null").count() == 1


def test_scrub_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in ("Slip.eml", "slip.EML"):
        (tmp_path / "in" / n).write_bytes(b"From: a@screwfix.com\r\n\r\nHi John")
    rows = scrubbed(maildir.read_eml_folder(spark, str(tmp_path / "in")))
    assert sinks.write_fixtures(rows, str(tmp_path / "out")) == 2
    assert {p.name for p in (tmp_path / "out" / "screwfix").iterdir()} == {"slip.eml", "slip-2.eml"}


def test_scenarios(spark, tmp_path):
    one = {"name": "s", "transactions": [{"id": "t", "merchant": "M", "amount_minor": 5, "currency": "GBP", "occurred_at": "2024-01-01T10:00:00+02:00"}], "slips": [{"id": "r", "supplier": "M", "amount_minor": 5, "currency": "GBP", "issued_at": "2024-01-01T08:00:00Z", "itemised": True}], "labels": [{"transaction_id": "t", "slip_id": "r"}]}
    (tmp_path / "s.json").write_text(json.dumps(one))
    s = scenarios.read_scenarios(spark, str(tmp_path / "s.json"))
    t, r = scenarios.scenario_transactions(s).first(), scenarios.scenario_slips(s).first()
    assert (t.occurred_offset_sec, r.source, r.n_lines) == (7200, "email", 1) and scenarios.scenario_labels(s).count() == 1
    assert scenarios.load_blocklist(str(tmp_path / "none.json")).area_names == ()


class _Mailbox(BaseHTTPRequestHandler):
    def do_GET(self):
        assert self.headers["Authorization"] == "Bearer tok"
        if "bad" in self.path:
            self.send_response(403)
            self.end_headers()
            self.wfile.write(b"no" * 5000)
            return
        if "/messages/" in self.path:
            body = PLAIN if self.path.endswith("$value") else json.dumps({"raw": base64.urlsafe_b64encode(PLAIN).decode().rstrip("=")}).encode()
        else:
            body = json.dumps({"messages": [{"id": "a"}, {"id": "b"}], "value": [{"id": "c"}]}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *a):
        pass


def test_web_sources(spark, tmp_path):
    server = HTTPServer(("127.0.0.1", 0), _Mailbox)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    (tmp_path / "t.json").write_text(json.dumps({"access_token": "tok"}))
    webmail.register(spark)
    base = f"http://127.0.0.1:{server.server_port}"
    opts = {"base_url": base, "token_path": str(tmp_path / "t.json"), "mailbox_id": "box"}
    assert spark.read.format("ledgerloom-gmail").options(**opts).load().select("message_id", "subject").count() == 2
    assert spark.read.format("ledgerloom-graph").options(**opts, since="2024-01-01T11:00:00+00:00").load().count() == 1
    assert spark.read.format("ledgerloom-graph").options(**opts, since="2024-01-02T00:00:00+00:00").load().count() == 0
    with pytest.raises(Exception, match="HTTP 403"):
        spark.read.format("ledgerloom-gmail").options(**{**opts, "base_url": base + "/bad"}).load().collect()
    server.shutdown()


def test_tokens(tmp_path):
    with pytest.raises(webmail.NotConfigured):
        webmail.load_token(str(tmp_path / "none"))
    (tmp_path / "t").write_text(json.dumps({"access_token": "x", "expiry": "2020-01-01T00:00:00Z"}))
    token = webmail.load_token(str(tmp_path / "t"))
    assert token.expired(datetime.now(timezone.utc)) and not webmail.Token("x").expired(datetime.now(timezone.utc) + timedelta(days=9))
    assert F is not None
