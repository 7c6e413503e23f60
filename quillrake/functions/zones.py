"""Local-time intervals of time zones, from the tz database of the Python installation."""

from __future__ import annotations

import functools
from calendar import isleap
from collections.abc import Iterable
from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo, available_timezones

#: Years that the interval table covers: from before the first change of any zone's clock to where all of them follow a
#: yearly rule, and on until a year of each kind (leap or not, weekday of its first day) has come.
YEARS = (1800, 2130)
RULED = 2088


def year_kinds() -> dict[int, int]:
    """A covered year that follows the yearly rules, for each kind of year: weekday of its first day, from Sunday 0, and 7 more if it is a leap year."""
    out: dict[int, int] = {}
    for y in range(RULED, YEARS[1]):
        out.setdefault((date(y, 1, 1).weekday() + 1) % 7 + 7 * isleap(y), y)
    return out

#: Usual abbreviations of zones for which the tz database has numeric names only, in minutes.
NUMERIC_ZONE_ABBREVIATIONS = {
    "America/Sao_Paulo": {"BRT": -180, "BRST": -120},
    "America/Argentina/Buenos_Aires": {"ART": -180, "ARST": -120},
    "America/Bogota": {"COT": -300},
    "America/Lima": {"PET": -300},
    "America/Santiago": {"CLT": -240, "CLST": -180},
    "Asia/Dubai": {"GST": 240},
    "Asia/Singapore": {"SGT": 480},
    "Asia/Dhaka": {"BST": 360},
    "Asia/Kathmandu": {"NPT": 345},
    "Asia/Tashkent": {"UZT": 300},
    "Europe/Istanbul": {"TRT": 180},
}

_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


@functools.cache
def _names() -> frozenset[str]:
    return frozenset(available_timezones())


def names() -> list[str]:
    """All zones of the tz database, some 600."""
    return sorted(_names())


def known(name: str) -> bool:
    return name in _names()


def _state(zone: ZoneInfo, sec: int) -> tuple[int, str]:
    t = (_EPOCH + timedelta(seconds=sec)).astimezone(zone)
    return int(t.utcoffset().total_seconds()), t.tzname()


@functools.lru_cache(maxsize=1024)
def utc_intervals(name: str, years: tuple[int, int] = YEARS) -> tuple[tuple[int, int, int, str], ...]:
    """(from, to, offset, abbreviation) in seconds of UTC, without gaps, over the years and a year around them."""
    zone = ZoneInfo(name)
    at = lambda y: int((datetime(y, 1, 1, tzinfo=timezone.utc) - _EPOCH).total_seconds())
    first, last, step = at(years[0] - 1), at(years[1] + 1), 7 * 86400
    out, begun, state, t = [], first, _state(zone, first), first
    while t < last:
        nxt = min(t + step, last)
        if (there := _state(zone, nxt)) != state:
            lo, hi = t, nxt
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if _state(zone, mid) == state else (lo, mid)
            out.append((begun, hi, *state))
            begun, state, t = hi, _state(zone, hi), hi
            continue
        state, t = there, nxt
    out.append((begun, last, *state))
    return tuple(out)


def local_intervals(names: Iterable[str], years: tuple[int, int] = YEARS) -> list[tuple]:
    """Rows (zone, year, intervals): each interval of local time, exploded to the local years that it meets.

    ``intervals`` holds (lo_ms, hi_ms, offset_ms, abbreviation), the bounds in local milliseconds.
    Two intervals of a zone overlap where clocks are set back and leave a gap where they are set forward.
    """
    rows = []
    for name in sorted(set(names)):
        by_year: dict[int, list[tuple[int, int, int, str]]] = {}
        alias = NUMERIC_ZONE_ABBREVIATIONS.get(name, {})
        for lo, hi, off, abbr in utc_intervals(name, years):
            shown = next((a for a, m in alias.items() if m * 60 == off), abbr)
            a, b = lo + off, hi + off
            ya, yb = ((_EPOCH + timedelta(seconds=x)).year for x in (a, b - 1))
            for y in range(max(ya, years[0]), min(yb, years[1]) + 1):
                by_year.setdefault(y, []).append((a * 1000, b * 1000, off * 1000, shown))
        rows += [(name, y, spans) for y, spans in sorted(by_year.items())]
    return rows
