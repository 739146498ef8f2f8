"""Instants in epoch milliseconds: days, weeks, labels. All UTC and independent of the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000
#: fixed value: weekday names, Sunday first
WEEKDAYS = ["日", "一", "二", "三", "四", "五", "六"]


def to_ms(ts: str) -> Column:
    """Milliseconds of a timestamp_ntz column, cut, not rounded."""
    return F.expr(f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")


def instant(ms: Column) -> Column:
    return F.timestamp_add("MILLISECOND", ms, F.expr("timestamp_ntz'1970-01-01 00:00:00'"))


def day_start(ms: Column) -> Column:
    """Start of the instant's day; works on integers, so that grouping by it stays in the hash aggregate."""
    return ms - F.pmod(ms, F.lit(DAY_MS))


def week_start(ms: Column) -> Column:
    """Start of the instant's Monday; the epoch was a Thursday."""
    return ms - F.pmod(ms + 3 * DAY_MS, F.lit(7 * DAY_MS))


def day_key(ms: Column) -> Column:
    return F.date_format(instant(ms), "yyyy-MM-dd")


def month_day(ms: Column) -> Column:
    return F.date_format(instant(ms), "MM-dd")


def weekday(ms: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.dayofweek(instant(ms)))


def iso(ms: Column) -> Column:
    return F.date_format(instant(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def clock(ms: Column) -> Column:
    """Time of day as logs show it."""
    return F.substring(iso(ms), 12, 12)
