"""Sums over sessions and slices: all, today, by day, by week, the last seven days.

A session counts wholly for the day on which it starts. ``by``: columns to keep apart, such as the workspace. ``as_of_ms``
is the clock; nothing here reads the time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.format import bar_height
from ..functions.time import DAY_MS, day_key, day_start, month_day, week_start, weekday


def _total(col: str, name: str = "total_ms") -> Column:
    return F.coalesce(F.sum(col), F.lit(0)).cast("long").alias(name)


def sum_slices(slices: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return slices.groupBy(*by).agg(_total("delta_ms"))


def merge_journal(base: DataFrame, slices: DataFrame) -> DataFrame:
    """base (ws_id, total_ms) with the workspace's slices added."""
    added = sum_slices(slices, ["ws_id"]).withColumnRenamed("total_ms", "added")
    return base.join(added, "ws_id", "left").select("ws_id", (F.col("total_ms") + F.coalesce("added", F.lit(0))).alias("total_ms"))


def _periods(sessions: DataFrame, start: Column, name: str, by: Sequence[str]) -> DataFrame:
    rows = sessions.groupBy(*by, start.alias("at_ms")).agg(_total("duration_ms"), F.count(F.lit(1)).alias("session_count"))
    return rows.select(*by, day_key(F.col("at_ms")).alias(name), "total_ms", "session_count").orderBy(*by, name)


def daily_stats(sessions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return _periods(sessions, day_start(F.col("start_ms")), "date", by)


def weekly_stats(sessions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Weeks by the date of their Monday."""
    return _periods(sessions, week_start(F.col("start_ms")), "week_start", by)


def open_elapsed(as_of_ms: int, start: Column) -> Column:
    """Time of a running session; 0 when none runs (start 0)."""
    return F.when(start > 0, F.lit(as_of_ms) - start).otherwise(F.lit(0)).cast("long")


def today_ms(sessions: DataFrame, open_sessions: DataFrame, as_of_ms: int) -> DataFrame:
    """ws_id, today_ms of every workspace of ``open_sessions`` (ws_id, current_start_ms).

    Closed sessions that started today, and the open one if it started today.
    """
    day = as_of_ms - as_of_ms % DAY_MS
    today = lambda c: (F.col(c) >= day) & (F.col(c) < day + DAY_MS)
    closed = sessions.where(today("start_ms")).groupBy("ws_id").agg(_total("duration_ms", "closed"))
    running = F.when((F.col("current_start_ms") > 0) & today("current_start_ms"), F.lit(as_of_ms) - F.col("current_start_ms")).otherwise(F.lit(0))
    return open_sessions.join(closed, "ws_id", "left").select("ws_id", (F.coalesce("closed", F.lit(0)) + running).cast("long").alias("today_ms"))


def last_seven_days(sessions: DataFrame, as_of_ms: int, open_elapsed_ms: int | Column = 0) -> DataFrame:
    """at_ms, label, weekday, total_ms of today and the six days before, in order, days without sessions too.

    Today's total has the open session's whole time, whatever day it began on. Days are summed first, so seven rows meet
    the calendar.
    """
    day = as_of_ms - as_of_ms % DAY_MS
    week = sessions.where((F.col("start_ms") >= day - 6 * DAY_MS) & (F.col("start_ms") < day + DAY_MS))
    days = week.groupBy(day_start(F.col("start_ms")).alias("at_ms")).agg(_total("duration_ms", "closed"))
    calendar = sessions.sparkSession.range(day - 6 * DAY_MS, day + DAY_MS, DAY_MS, 1).withColumnRenamed("id", "at_ms")
    running = F.when(F.col("at_ms") == day, open_elapsed_ms if isinstance(open_elapsed_ms, Column) else F.lit(open_elapsed_ms)).otherwise(F.lit(0))
    total = (F.coalesce("closed", F.lit(0)) + running).cast("long")
    rows = calendar.join(F.broadcast(days), "at_ms", "left")  # seven days
    return rows.select("at_ms", month_day(F.col("at_ms")).alias("label"), weekday(F.col("at_ms")).alias("weekday"), total.alias("total_ms")).orderBy("at_ms")


def week_total(seven: DataFrame) -> DataFrame:
    """Sum of the seven rows: a rolling week."""
    return seven.agg(_total("total_ms", "week_total_ms"))


def chart(seven: DataFrame) -> DataFrame:
    """The seven rows with bar heights, the scale (1 at least), and whether all are empty."""
    scale = seven.agg(F.greatest(F.max("total_ms"), F.lit(1)).alias("scale_ms"), F.bool_and(F.col("total_ms") == 0).alias("is_empty"))
    rows = seven.join(F.broadcast(scale))  # one row
    return rows.select("at_ms", "label", "weekday", "total_ms", "scale_ms", "is_empty", bar_height(F.col("total_ms"), F.col("scale_ms")).alias("height_pct")).orderBy("at_ms")


def workspace_totals(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("ws_id").agg(_total("duration_ms"), F.count(F.lit(1)).alias("session_count"))


def split_midnight(sessions: DataFrame) -> DataFrame:
    """An extension: sessions cut at midnight, one row for each day that they touch."""
    last = F.greatest(F.col("start_ms"), F.col("end_ms") - 1)
    days = F.sequence(day_start(F.col("start_ms")), day_start(last), F.lit(DAY_MS))
    rows = sessions.select("*", F.explode(days).alias("day_"))
    start, end = F.greatest("start_ms", "day_"), F.least(F.col("end_ms"), F.col("day_") + DAY_MS)
    return rows.select(*[c for c in sessions.columns if c not in ("start_ms", "end_ms", "duration_ms")], start.alias("start_ms"), end.alias("end_ms"), (end - start).alias("duration_ms"))
