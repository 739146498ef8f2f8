"""Running timers: snapshots, checkpoints, session pairs, periods, recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import DAY_MS
from .aggregates import open_elapsed, sum_slices


def snapshot(state: DataFrame, as_of_ms: int) -> DataFrame:
    """ws_id, total_ms, session_elapsed_ms, current_total_ms. state: ws_id, total_ms, current_start_ms."""
    elapsed = open_elapsed(as_of_ms, F.col("current_start_ms"))
    return state.select("ws_id", "total_ms", elapsed.alias("session_elapsed_ms"), (F.col("total_ms") + elapsed).alias("current_total_ms"))


def checkpoint(state: DataFrame, as_of_ms: int) -> DataFrame:
    """The state with the open session in its total; the start marker stays."""
    total = F.col("total_ms") + open_elapsed(as_of_ms, F.col("current_start_ms"))
    return state.withColumns({"total_ms": total, "last_saved_ms": F.lit(as_of_ms).cast("long")})


def pairs(marks: DataFrame) -> DataFrame:
    """Sessions of start and stop marks (ws_id, at_ms, kind): a start while running and a stop while idle do nothing."""
    order = Window.partitionBy("ws_id").orderBy("at_ms", F.desc("kind"))  # at one instant a stop before a start
    changes = marks.withColumn("before", F.lag("kind", 1, "stop").over(order)).where("kind <> before")
    rows = changes.select("ws_id", "kind", F.col("at_ms").alias("start_ms"), F.lead("at_ms").over(order).alias("end_ms"))
    return rows.where("kind = 'start' and end_ms is not null").select("ws_id", "start_ms", "end_ms", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"))


def period_totals(sessions: DataFrame, periods: DataFrame) -> DataFrame:
    """ws_id, total_ms of the current period, history_ms of all. periods: ws_id, period_start_ms of each workspace.

    A new period keeps the history; only the total starts anew.
    """
    current = F.when(F.col("start_ms") >= F.col("period_start_ms"), F.col("duration_ms")).otherwise(F.lit(0))
    rows = sessions.join(periods, "ws_id")
    return rows.groupBy("ws_id").agg(F.sum(current).cast("long").alias("total_ms"), F.sum("duration_ms").cast("long").alias("history_ms"), F.count(F.lit(1)).alias("session_count"))


def compensation(as_of_ms: int, start: Column) -> Column:
    """Time since an unfinished session's start if it is more than 0 and less than a day, else 0."""
    elapsed = F.lit(as_of_ms) - start
    return F.when((start > 0) & (elapsed > 0) & (elapsed < DAY_MS), elapsed).otherwise(F.lit(0)).cast("long")


def recover(state: DataFrame, slices: DataFrame, as_of_ms: int) -> DataFrame:
    """ws_id, total_ms after a crash as the original counts: stored total, all of the journal, and the compensation.

    Counts the open session up to three times where it was checkpointed and journalled; see ``recover_exact``.
    """
    journal = sum_slices(slices, ["ws_id"]).withColumnRenamed("total_ms", "journal_ms")
    total = F.col("total_ms") + F.coalesce("journal_ms", F.lit(0)) + compensation(as_of_ms, F.col("current_start_ms"))
    return state.join(journal, "ws_id", "left").select("ws_id", total.cast("long").alias("total_ms"))


def recover_exact(state: DataFrame, slices: DataFrame) -> DataFrame:
    """ws_id, total_ms with each slice once: the checkpointed total, and slices since the checkpoint (ts_ms > last_saved_ms).

    Differs from the original on purpose: no time is counted twice, and none after the last slice.
    """
    since = slices.join(state.select("ws_id", "last_saved_ms"), "ws_id").where(F.col("ts_ms") > F.col("last_saved_ms"))
    journal = sum_slices(since, ["ws_id"]).withColumnRenamed("total_ms", "journal_ms")
    return state.join(journal, "ws_id", "left").select("ws_id", (F.col("total_ms") + F.coalesce("journal_ms", F.lit(0))).cast("long").alias("total_ms"))
