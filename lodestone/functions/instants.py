"""Parsing of one raw timestamp string; pure Python so that it runs once per distinct value inside an Arrow batch."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

# Month names of the corpus's languages, as written in dates.
MONTHS = {
    "en": "january february march april may june july august september october november december",
    "sv": "januari februari mars april maj juni juli augusti september oktober november december",
    "de": "januar februar märz april mai juni juli august september oktober november dezember",
    "da": "januar februar marts april maj juni juli august september oktober november december",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "fi": "tammikuuta helmikuuta maaliskuuta huhtikuuta toukokuuta kesäkuuta heinäkuuta elokuuta syyskuuta lokakuuta marraskuuta joulukuuta",
    "ru": "января февраля марта апреля мая июня июля августа сентября октября ноября декабря",
}
# Zone abbreviations with one common meaning, minutes from UTC.
ZONES = {
    "UTC": 0, "GMT": 0, "Z": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180,
    "MSK": 180, "IST": 330, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "NST": -210, "NDT": -150, "AST": -240, "ADT": -180, "JST": 540,
}
MONTH_NO: dict[str, int] = {}
for _names in MONTHS.values():
    for _i, _name in enumerate(_names.split(), 1):
        MONTH_NO[_name] = _i
        if _name[:3] not in ("mar", "jui", "мар"):
            MONTH_NO.setdefault(_name[:3], _i)
MONTH_NO |= {"mar": 3, "jun": 6, "jul": 7, "мар": 3, "sept": 9, "мая": 5}

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
_TIME = r"(?P<h>\d{1,2}):(?P<mi>\d\d)(?::(?P<s>\d\d)(?:[.,](?P<f>\d+))?)?(?:\s*(?P<ap>[AaPp])\.?[Mm]\.?)?"
_ZONE = r"\s*(?:(?P<off>[+-]\d\d:?(?:\d\d)?)|(?P<abbr>[A-Za-z]{1,5}))?(?:\s*\[(?P<region>[A-Za-z_+\-/0-9]+)\])?(?:\s*\([A-Za-z ]+\))?"
_TAIL = rf"(?:(?:[T ,]|,?\s+(?:kl\.?|at|um|klo|à|a las|в)\s+|\s+)\s*{_TIME}{_ZONE})?"
_FORMS = [
    re.compile(p + "$")
    for p in (
        r"(?P<y>\d{4})-(?P<m>\d{1,2})-(?P<d>\d{1,2})" + _TAIL,
        r"(?P<y>\d{4})/(?P<m>\d{1,2})/(?P<d>\d{1,2})" + _TAIL,
        r"(?P<y>\d{4})\.(?P<m>\d{1,2})\.(?P<d>\d{1,2})\.?" + _TAIL,
        r"(?P<y>\d{4})(?P<m>\d\d)(?P<d>\d\d)(?:[T ]?(?P<h>\d\d)(?P<mi>\d\d)(?:(?P<s>\d\d)(?:[.,](?P<f>\d+))?)?" + _ZONE + ")?",
        r"(?P<y>\d{4})-?W(?P<w>\d\d)-?(?P<wd>\d)" + _TAIL,
        r"(?P<p1>\d{1,2})[/.-](?P<p2>\d{1,2})[/.-](?P<y>\d{4})" + _TAIL,
        r"(?:[^\W\d_]+\.?,?\s+)?(?:den\s+)?(?P<d>\d{1,2})(?:\.|st|nd|rd|th)?\s*(?:de\s+|-)?(?P<mon>[^\W\d_]+)\.?,?\s*(?:de\s+|-)?(?P<y>\d{4})(?:\s*г\.?)?" + _TAIL,
        r"(?:[^\W\d_]+\.?,?\s+)?(?P<mon>[^\W\d_]+)\.?\s+(?P<d>\d{1,2})(?:st|nd|rd|th)?,?\s+(?P<y>\d{4})" + _TAIL,
    )
]
_EPOCH = re.compile(r"-?\d{9,10}(?:\.\d+)?$|\d{12,13}(?:\.\d+)?$|\d{15,16}$|\d{18,19}$")
PLAIN_DAY = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


@lru_cache(maxsize=256)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except Exception:
        return None


def _render(at: datetime) -> str:
    return at.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ") if at.year >= 1000 else None


def local_instant(wall: datetime, zone: ZoneInfo) -> datetime:
    """A doubled local time is the earlier instant; a skipped one takes the offset in force before the change (both are fold=0)."""
    return wall.replace(tzinfo=zone, fold=0)


def _epoch(raw: str) -> str | None:
    head, _, frac = raw.partition(".")
    digits = len(head.lstrip("-"))
    power = 0 if digits <= 10 else 3 if digits <= 13 else 6 if digits <= 16 else 9
    # integer arithmetic: the value in units of 10**-power seconds, then microseconds with the rest cut off
    micro = int(head) * 10**6 // 10**power
    if frac:
        micro += int((frac + "000000")[:6]) // 10**power
    try:
        return _render(EPOCH + timedelta(microseconds=micro))
    except OverflowError:
        return None


def normalise(raw: str | None, tz_name: str | None = "UTC", day_first: bool | None = True) -> str | None:
    """The UTC instant or plain day that raw denotes; None for null, empty or senseless values.

    tz_name and day_first (a null counts as UTC and day first) settle what the value itself leaves open.
    """
    text = " ".join(raw.split()) if raw else ""
    if not text:
        return None
    if _EPOCH.match(text):
        return _epoch(text)
    for form in _FORMS:
        if found := form.match(text):
            out = _build(found.groupdict(), tz_name, day_first is not False)
            if out:
                return out
    return None


def _build(g: dict, tz_name: str | None, day_first: bool) -> str | None:
    try:
        year = int(g["y"])
        if g.get("w"):
            day = date.fromisocalendar(year, int(g["w"]), int(g["wd"]))
        else:
            if g.get("mon"):
                month, dom = MONTH_NO.get(g["mon"].lower(), 0), int(g["d"])
            elif g.get("p1"):
                dom, month = (int(g["p1"]), int(g["p2"])) if day_first else (int(g["p2"]), int(g["p1"]))
            else:
                month, dom = int(g["m"]), int(g["d"])
            day = date(year, month, dom)
        if not g.get("h"):
            return day.isoformat()
        hour, ap = int(g["h"]), (g.get("ap") or "").lower()
        if ap:
            if not 1 <= hour <= 12:
                return None
            hour = hour % 12 + (12 if ap == "p" else 0)
        wall = datetime(day.year, day.month, day.day, hour, int(g["mi"]), int(g.get("s") or 0), int(((g.get("f") or "") + "000000")[:6]))
        if off := g.get("off"):
            sign, body = (-1 if off[0] == "-" else 1), off[1:].replace(":", "")
            minutes = int(body[:2]) * 60 + int(body[2:] or 0)
            if int(body[2:] or 0) > 59 or minutes > 18 * 60:
                return None
            return _render(wall.replace(tzinfo=timezone(timedelta(minutes=sign * minutes))))
        if abbr := g.get("abbr"):
            if abbr.upper() not in ZONES:
                return None
            return _render(wall.replace(tzinfo=timezone(timedelta(minutes=ZONES[abbr.upper()]))))
        zone = _zone(g.get("region") or tz_name or "UTC")
        return _render(local_instant(wall, zone)) if zone else None
    except (ValueError, OverflowError):
        return None
