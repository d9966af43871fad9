"""Spans of time in words, as (since, until) with until the day after the last."""

from __future__ import annotations

import datetime as dt
import re

_MONTHS = {m: i + 1 for i, m in enumerate("january february march april may june july august september october november december".split())}


def _month(year: int, month: int) -> dt.date:
    """The first of a month, counted on past December or before January."""
    return dt.date(year + (month - 1) // 12, (month - 1) % 12 + 1, 1)


def span(text: str, today: dt.date) -> tuple[dt.date, dt.date] | None:
    text = text.strip().lower()
    if m := re.fullmatch(r"q([1-4]) (\d{4})", text):
        first = 3 * int(m[1]) - 2
        return _month(int(m[2]), first), _month(int(m[2]), first + 3)
    if m := re.fullmatch(r"last (\d+) (day|week|month|year)s?", text):
        n = int(m[1])
        if m[2] in ("day", "week"):
            return today - dt.timedelta(days=n * (7 if m[2] == "week" else 1)), today + dt.timedelta(days=1)
        start = _month(today.year, today.month - n * (12 if m[2] == "year" else 1))
        last = (_month(start.year, start.month + 1) - dt.timedelta(days=1)).day
        return start.replace(day=min(today.day, last)), today + dt.timedelta(days=1)
    if (m := re.fullmatch(r"([a-z]+) (\d{4})", text)) and m[1] in _MONTHS:
        return _month(int(m[2]), _MONTHS[m[1]]), _month(int(m[2]), _MONTHS[m[1]] + 1)
    if m := re.fullmatch(r"\d{4}", text):
        return dt.date(int(text), 1, 1), dt.date(int(text) + 1, 1, 1)
    if m := re.fullmatch(r"(\d{4})-(\d\d)(?: to (\d{4})-(\d\d))?", text):
        return _month(int(m[1]), int(m[2])), _month(int(m[3] or m[1]), int(m[4] or m[2]) + 1)
    if m := re.fullmatch(r"(\d{4}-\d\d-\d\d) to (\d{4}-\d\d-\d\d)", text):
        return dt.date.fromisoformat(m[1]), dt.date.fromisoformat(m[2]) + dt.timedelta(days=1)
    return None
