"""One UTC instant from one written time, or nothing.

``instant_micros`` reads the notations that mail headers and bank exports use:
RFC 5322 dates with comments, C-library dates, ISO 8601 in basic and extended
form, numeric dates whose field order the feed declares, month names in English,
German, French and Spanish, twelve-hour clocks, and Unix times in seconds,
milli-, micro- or nanoseconds.  It returns ``None`` wherever no single instant
follows: no time of day, impossible fields, no zone, or a local time that its
zone skips or has twice.
"""

from __future__ import annotations

import re
import unicodedata
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

# Month names by language, in calendar order.
MONTHS_EN = "january february march april may june july august september october november december"
MONTHS_DE = "januar februar märz april mai juni juli august september oktober november dezember"
MONTHS_FR = "janvier février mars avril mai juin juillet août septembre octobre novembre décembre"
MONTHS_ES = "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre"

# Zone abbreviations, hours east of UTC.
ABBREVIATIONS = {
    "z": 0, "ut": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 1, "bst": 1, "cet": 1, "cest": 2, "eet": 2, "eest": 3,
    "msk": 3, "npt": 5.75, "jst": 9, "kst": 9, "aest": 10, "aedt": 11, "nzst": 12, "nzdt": 13,
    "nst": -3.5, "ndt": -2.5, "ast": -4, "adt": -3, "est": -5, "edt": -4, "cst": -6, "cdt": -5, "mst": -7, "mdt": -6, "pst": -8, "pdt": -7,
}


def _month_index() -> dict[str, int]:
    index: dict[str, int] = {}
    for names in (MONTHS_EN, MONTHS_DE, MONTHS_FR, MONTHS_ES):
        for number, name in enumerate(names.split(), 1):
            bare = "".join(c for c in unicodedata.normalize("NFD", name) if not unicodedata.combining(c))
            for form in (name, bare):
                index.setdefault(form, number)
    for number, name in enumerate(MONTHS_EN.split(), 1):
        index[name[:3]] = number
    for number, name in enumerate(MONTHS_DE.split(), 1):
        index.setdefault(name[:3], number)
    for short, number in {"sept": 9, "janv": 1, "févr": 2, "fevr": 2, "avr": 4, "juil": 7, "déc": 12, "ene": 1, "abr": 4, "ago": 8, "dic": 12}.items():
        index.setdefault(short, number)
    return index


_MONTH = _month_index()
_CLOCK = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?(?:\s*(?P<ap>[ap])\.?m\b\.?)?"
_ZONE = r"(?:\s*(?P<z>[+-]\d{1,2}(?::?\d{2})?(?::?\d{2})?|\[?[a-z]+(?:/[a-z_+\-0-9]+)+\]?|[a-z]{1,5}(?![a-z])))?(?:\s*\[(?P<z2>[a-z_+\-0-9/]+)\])?"
_WEEKDAY = r"(?:[^\W\d_]{2,10}\.?\s*,?\s+)?"
_NAME = r"(?P<mon>[^\W\d_]{3,10})\.?"

_ISO = re.compile(r"(?P<y>\d{4})[-/.](?P<m>\d{1,2})[-/.](?P<d>\d{1,2})(?:\s*t\s*|[ ,]+)" + _CLOCK + _ZONE)
_BASIC = re.compile(r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})[t ](?P<h>\d{2}):?(?P<mi>\d{2})(?::?(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?(?P<ap>(?!))?" + _ZONE)
_DAY_NAME = re.compile(_WEEKDAY + r"(?P<d>\d{1,2})(?:\.|st|nd|rd|th|er)?[ \-/]*(?:de )?" + _NAME + r"[ \-/,]*(?:de )?(?P<y>\d{4}|\d{2})(?:,|\s+à|\s+um|\s+at|\s+a las)?[ ]+" + _CLOCK + r"(?:\s*uhr)?" + _ZONE)
_FRENCH = re.compile(_WEEKDAY + r"(?P<d>\d{1,2})(?:er)? " + _NAME + r" (?P<y>\d{4})(?: à|,)? (?P<h>\d{1,2}) ?h ?(?P<mi>\d{2})(?P<s>(?!))?(?P<f>(?!))?(?P<ap>(?!))?" + _ZONE)
_NAME_DAY = re.compile(_WEEKDAY + _NAME + r" (?P<d>\d{1,2})(?:st|nd|rd|th)?,? (?P<y>\d{4})(?:,| at)? " + _CLOCK + _ZONE)
_CLIB = re.compile(r"[a-z]{3,9},? " + _NAME + r" (?P<d>\d{1,2}) " + _CLOCK + r"(?: (?P<z>[+-]\d{4}|[a-z]{1,5}))? (?P<y>\d{4})(?: (?P<z2>[+-]\d{4}))?")
_NUMERIC = re.compile(r"(?P<a>\d{1,4})(?P<sep>[./-])(?P<b>\d{1,2})(?P=sep)(?P<c>\d{4}|\d{2})(?:,| t)? +" + _CLOCK + r"(?:\s*uhr)?" + _ZONE)
_NUMBER = re.compile(r"[+-]?\d+(?:\.\d+)?")


@lru_cache(maxsize=256)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except Exception:
        return None


@lru_cache(maxsize=4096)
def _zone_named(lowered: str) -> ZoneInfo | None:
    """IANA names are matched without letter case."""
    parts = ["_".join(w if w in ("of", "es") else w.capitalize() for w in p.split("_")) for p in lowered.split("/")]
    return _zone("/".join(parts)) or _zone("/".join("-".join(x.capitalize() for x in p.split("-")) for p in parts))


def _offset_seconds(text: str) -> int | None:
    digits = text[1:].replace(":", "")
    if len(digits) == 3:
        digits = "0" + digits
    hours, minutes, seconds = int(digits[:2]), int(digits[2:4] or 0), int(digits[4:6] or 0)
    if minutes > 59 or seconds > 59 or hours > 18:
        return None
    total = hours * 3600 + minutes * 60 + seconds
    return -total if text[0] == "-" else total


def _in_zone(local: datetime, zone: ZoneInfo) -> datetime | None:
    """The UTC time of a local one; None where the zone skips it or has it twice."""
    first = local.replace(tzinfo=zone, fold=0)
    if first.utcoffset() != local.replace(tzinfo=zone, fold=1).utcoffset():
        return None
    return (local - first.utcoffset()).replace(tzinfo=timezone.utc)


_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def _unix(text: str) -> int | None:
    sign = -1 if text[0] == "-" else 1
    whole, _, part = text.lstrip("+-").partition(".")
    whole = whole.lstrip("0") or "0"
    scale = 6 if len(whole) <= 11 else 3 if len(whole) <= 14 else 0 if len(whole) <= 17 else -3
    if len(whole) > 20:
        return None
    nanos = int(whole + (part + "0" * 9)[: scale + 3])
    return sign * (nanos // 1000)


def _fields(m: re.Match) -> tuple[int, int, int, int, int] | None:
    """Hour, minute, second, microsecond and carried days of a clock match."""
    h, mi, s = int(m["h"]), int(m["mi"]), int(m["s"] or 0)
    micros = int(((m["f"] or "") + "000000")[:6])
    if m["ap"]:
        if not 1 <= h <= 12:
            return None
        h = h % 12 + (12 if m["ap"] == "p" else 0)
    carried = 0
    if h == 24 and mi == 0 and s == 0 and micros == 0:
        h, carried = 0, 1
    if h > 23 or mi > 59 or s > 59:
        return None
    return h, mi, s, micros, carried


def instant_micros(raw: str | None, offset_sec: int | None = None, zone_name: str | None = None, date_order: str | None = None) -> int | None:
    """Microseconds since 1970, cut, or None where no single instant follows.

    A zone or offset inside the text decides, else ``offset_sec`` (seconds east),
    else ``zone_name``.  ``date_order`` (dmy, mdy, ymd) reads purely numeric dates.
    """
    if raw is None:
        return None
    text = unicodedata.normalize("NFKC", raw)
    while True:  # comments nest
        bare = re.sub(r"\([^()]*\)", " ", text)
        if bare == text:
            break
        text = bare
    text = " ".join(text.lower().split())
    if not text or not any(c.isdigit() for c in text):
        return None
    if _NUMBER.fullmatch(text):
        if len(text) != 14 or not text.isdigit():
            return _unix(text)
        text = f"{text[:8]}t{text[8:]}"
    for pattern in (_ISO, _BASIC, _DAY_NAME, _CLIB, _FRENCH, _NAME_DAY, _NUMERIC):
        m = pattern.fullmatch(text)
        if m:
            break
    else:
        return None
    g = m.groupdict()
    clock = _fields(m)
    if clock is None:
        return None
    if pattern is _NUMERIC:
        a, b, c = g["a"], g["b"], g["c"]
        order = (date_order or "").lower()
        if len(a) > 2:
            return None
        if order not in ("dmy", "mdy", "ymd"):
            return None
        if len(c) == 4 and order == "ymd":
            return None
        y, mo, d = {"dmy": (c, b, a), "mdy": (c, a, b), "ymd": (a, b, c)}[order]
        mo = int(mo)
    else:
        y, d = g["y"], g["d"]
        mo = int(g["m"]) if g.get("m") else _MONTH.get(g["mon"], 0)
    year = int(y)
    if len(y) <= 2:
        year += 2000 if year < 70 else 1900
    h, mi, s, micros, carried = clock
    try:
        local = datetime(year, mo, int(d), h, mi, s, micros) + timedelta(days=carried)
    except (ValueError, OverflowError):
        return None
    written = [z for z in (g.get("z"), g.get("z2")) if z]
    try:
        if written:
            found = None
            for z in written:
                if z[0] in "+-":
                    sec = _offset_seconds(z)
                    if sec is None:
                        return None
                    found = (local - timedelta(seconds=sec)).replace(tzinfo=timezone.utc)
                elif "/" in z:
                    zone = _zone_named(z.strip("[]"))
                    found = _in_zone(local, zone) if zone else None
                elif z in ABBREVIATIONS:
                    found = (local - timedelta(hours=ABBREVIATIONS[z])).replace(tzinfo=timezone.utc)
                elif z == "ist" and zone_name == "Asia/Kolkata":
                    found = (local - timedelta(hours=5.5)).replace(tzinfo=timezone.utc)
                if found is None:
                    return None
                break
        elif offset_sec is not None:
            found = (local - timedelta(seconds=int(offset_sec))).replace(tzinfo=timezone.utc)
        elif zone_name:
            zone = _zone(zone_name)
            found = _in_zone(local, zone) if zone else None
        else:
            return None
        if found is None:
            return None
        gap = found - _EPOCH
        return (gap.days * 86400 + gap.seconds) * 1_000_000 + gap.microseconds
    except (ValueError, OverflowError):
        return None


