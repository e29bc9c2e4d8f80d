"""Dates in text, resolved against an injected time."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

DAY_MS = 86_400_000
#: Fixed values.
MONTHS = "january february march april may june july august september october november december".split()
UNITS = {"second": 1_000, "minute": 60_000, "hour": 3_600_000, "day": DAY_MS, "week": 7 * DAY_MS, "month": 30 * DAY_MS, "year": 365 * DAY_MS}
_MONTH = "(" + "|".join(m[:3] + ("(?:" + m[3:] + ")?" if m[3:] else "") for m in MONTHS) + ")"


def _ms(year: int, month: int = 1, day: int = 1, hour: int = 0, minute: int = 0, second: int = 0) -> int | None:
    try:
        return int(datetime(year, month, day, hour, minute, second, tzinfo=UTC).timestamp() * 1000)
    except ValueError:
        return None


def _month(name: str) -> int:
    return next(i for i, m in enumerate(MONTHS, 1) if m.startswith(name.lower()[:3]))


def parse_date(text: str, now_ms: int) -> int | None:
    """Epoch milliseconds of one date, or None."""
    t = text.strip()
    if re.fullmatch(r"\d{9,}", t):
        return int(t)
    if m := re.fullmatch(r"(\d{4})-(\d{1,2})-(\d{1,2})(?:[T ](\d{1,2}):(\d{2})(?::(\d{2}))?(?:\.\d+)?Z?)?", t):
        return _ms(*[int(x or 0) for x in m.groups()])
    if m := re.fullmatch(r"(\d{1,2}):(\d{2}) ?(am|pm) on (\d{1,2}) (\w+),? (\d{4})", t, re.I):
        if re.fullmatch(_MONTH, m[5], re.I):
            return _ms(int(m[6]), _month(m[5]), int(m[4]), int(m[1]) % 12 + 12 * (m[3].lower() == "pm"), int(m[2]))
        return None
    if m := re.fullmatch(rf"(\d{{1,2}})(?:st|nd|rd|th)? {_MONTH},? (\d{{4}})", t, re.I):
        return _ms(int(m[3]), _month(m[2]), int(m[1]))
    if m := re.fullmatch(rf"{_MONTH}(?: (\d{{1,2}})(?:st|nd|rd|th)?)?,? (\d{{4}})", t, re.I):
        return _ms(int(m[3]), _month(m[1]), int(m[2] or 1))
    if m := re.fullmatch(r"(\d{4})-(\d{1,2})", t):
        return _ms(int(m[1]), int(m[2]))
    if m := re.fullmatch(r"\d{4}", t):
        return _ms(int(t))
    if m := re.fullmatch(r"(\d+|an?) (second|minute|hour|day|week|month|year)s? ago", t, re.I):
        return now_ms - UNITS[m[2].lower()] * (1 if m[1].lower() in ("a", "an") else int(m[1]))
    if m := re.fullmatch(r"last (day|week|month|year)", t, re.I):
        return now_ms - UNITS[m[1].lower()]
    start = now_ms - now_ms % DAY_MS
    return {"now": now_ms, "today": start, "yesterday": start - DAY_MS, "tomorrow": start + DAY_MS}.get(t.lower())


def parse_date_range(text: str, now_ms: int) -> tuple[int | None, int | None]:
    """Start and end; an open end is None."""
    t = text.strip()
    if m := re.fullmatch(r"(before|until|after|since) (.+)", t, re.I):
        at = parse_date(m[2], now_ms)
        return (None, at) if m[1].lower() in ("before", "until") else (at, None)
    if re.fullmatch(r"\d{4}", t):
        return _ms(int(t)), _ms(int(t) + 1) - 1
    if m := re.fullmatch(r"(\d{4})-(\d{1,2})", t) or re.fullmatch(rf"{_MONTH},? (\d{{4}})", t, re.I):
        year, month = (int(m[1]), int(m[2])) if m[1].isdigit() else (int(m[2]), _month(m[1]))
        return _ms(year, month), _ms(year + month // 12, month % 12 + 1) - 1
    at = parse_date(t, now_ms)
    if at is None:
        return None, None
    if re.search(r"last (week|month|year)", t, re.I):
        return at, now_ms
    day = at - at % DAY_MS
    return day, day + DAY_MS - 1


def extract_dates(text: str, now_ms: int) -> list[int]:
    """All dates of a text in order, without overlaps."""
    pattern = rf"\d{{4}}-\d{{1,2}}-\d{{1,2}}|\d{{1,2}}(?:st|nd|rd|th)? {_MONTH},? \d{{4}}|{_MONTH} \d{{1,2}}(?:st|nd|rd|th)?,? \d{{4}}|{_MONTH} \d{{4}}|(?:\d+|an?) (?:day|week|month|year)s? ago|last (?:week|month|year)|yesterday|today"
    return [at for m in re.finditer(pattern, text or "", re.I) if (at := parse_date(m[0], now_ms)) is not None]


def resolve_time(word: str, minus: str | None, now_ms: int) -> int:
    """NOW(), NOW() - 7d, TODAY and YESTERDAY."""
    start = now_ms - int(timedelta(milliseconds=now_ms % DAY_MS) / timedelta(milliseconds=1))
    base = {"NOW": now_ms, "TODAY": start, "YESTERDAY": start - DAY_MS}[word]
    if minus:
        base -= int(minus[:-1]) * {"s": 1_000, "m": 60_000, "h": 3_600_000, "d": DAY_MS}[minus[-1]]
    return base
