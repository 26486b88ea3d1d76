"""Timestamps: microseconds since 1970, UTC, and their text."""

from __future__ import annotations

import calendar
import re
from datetime import date

from .errors import ConfigError

MICROS = 1_000_000
LAST_YEAR = 250_000
_FORMAT = re.compile(r"(\d{4,6})-(\d\d)-(\d\d)T(\d\d):(\d\d):(\d\d)(?:\.(\d{1,6}))?Z", re.ASCII)
_CYCLE_YEARS, _CYCLE_DAYS = 400, 146_097  # the calendar repeats


def is_leap(year: int) -> bool:
    return calendar.isleap(year)


def days_in_month(year: int, month: int) -> int:
    return 29 if month == 2 and is_leap(year) else (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[month - 1]


def ymd_to_days(year: int, month: int, day: int) -> int:
    """Days since 1970-01-01; years beyond 9999 are moved back by whole calendar cycles."""
    cycles = max(0, -(-(year - 9999) // _CYCLE_YEARS))
    return date(year - cycles * _CYCLE_YEARS, month, day).toordinal() - date(1970, 1, 1).toordinal() + cycles * _CYCLE_DAYS


def days_to_ymd(days: int) -> tuple[int, int, int]:
    cycles = max(0, -(-(days - date(9999, 12, 31).toordinal() + date(1970, 1, 1).toordinal()) // _CYCLE_DAYS))
    d = date.fromordinal(days - cycles * _CYCLE_DAYS + date(1970, 1, 1).toordinal())
    return d.year + cycles * _CYCLE_YEARS, d.month, d.day


def parse_rfc3339(text: str) -> int:
    """``YYYY-MM-DDTHH:MM:SS[.ffffff]Z`` and nothing else, from 1970 on, in microseconds."""
    m = _FORMAT.fullmatch(text)
    if not m:
        raise ConfigError(f"{text!r} is not a timestamp like 2000-01-01T00:00:00Z")
    year, month, day, hour, minute, second = map(int, m.groups()[:6])
    if not (1970 <= year <= LAST_YEAR and 1 <= month <= 12 and 1 <= day <= days_in_month(year, month) and hour < 24 and minute < 60 and second < 60):
        raise ConfigError(f"{text!r} is out of range")
    fraction = int((m[7] or "0").ljust(6, "0"))
    return ((ymd_to_days(year, month, day) * 24 + hour) * 60 + minute) * 60 * MICROS + second * MICROS + fraction


def format_rfc3339(us: int) -> str:
    seconds, fraction = divmod(us, MICROS)
    days, seconds = divmod(seconds, 86_400)
    year, month, day = days_to_ymd(days)
    return f"{year:04}-{month:02}-{day:02}T{seconds // 3600:02}:{seconds // 60 % 60:02}:{seconds % 60:02}.{fraction:06}Z"


def hour_partition(us: int) -> str:
    days, micros = divmod(us, 86_400 * MICROS)
    year, month, day = days_to_ymd(days)
    return f"{year:04}-{month:02}-{day:02}T{micros // (3600 * MICROS):02}"
