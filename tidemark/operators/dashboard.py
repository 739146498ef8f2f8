"""The dashboard's record of one workspace."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from . import aggregates, flags, timer, workspaces


def dashboard(sessions: DataFrame, state: DataFrame, log: DataFrame, ws_id: str, as_of_ms: int, config: Config | None = None) -> DataFrame:
    """One row: totals, week, overall totals, settings. sessions, state (ws_id, total_ms, current_start_ms): of all workspaces."""
    config = config or Config()
    own, mine = sessions.where(F.col("ws_id") == ws_id), state.where(F.col("ws_id") == ws_id)
    now = timer.snapshot(mine, as_of_ms).select("ws_id", F.col("current_total_ms").alias("total_ms"), "session_elapsed_ms")
    today = aggregates.today_ms(own, mine.select("ws_id", "current_start_ms"), as_of_ms).select("today_ms")
    count = own.agg(F.count(F.lit(1)).alias("sessions_count"))
    week = aggregates.week_total(aggregates.last_seven_days(own, as_of_ms))
    overall = workspaces.snapshot(log).select(F.col("total_ms").alias("global_total_ms"), "workspace_count")
    row = now
    for part in (today, count, week, overall):  # one row each
        row = row.join(F.broadcast(part))
    settings = {f: getattr(config, f) for f in ("status_bar_enabled", "journal_enabled", "backup_to_file", "ring_buffer_capacity", "journal_flush_interval_ms", "full_save_interval_ms", "max_sessions")}
    return row.select(
        "ws_id",
        "total_ms",
        "today_ms",
        "sessions_count",
        (F.col("week_total_ms") + F.col("session_elapsed_ms")).alias("week_total_ms"),
        "global_total_ms",
        "workspace_count",
        flags.state(F.lit(config.enabled), F.lit(config.global_disabled)).alias("state"),
        *[F.lit(v).alias(k) for k, v in settings.items()],
    )


def nested(row: DataFrame, seven: DataFrame, ranking: DataFrame, most: int = 1_000) -> DataFrame:
    """The record with its two lists: seven days, and the ``most`` first workspaces by rank (name, total_ms), a page's worth."""
    days = seven.agg(F.transform(F.array_sort(F.collect_list(F.struct("at_ms", "label", "weekday", "total_ms"))), lambda d: F.struct(d["label"].alias("label"), d["weekday"].alias("weekday"), d["total_ms"].alias("total_ms"))).alias("daily_stats"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("total_ms")).alias("order"), "name", "total_ms")))
    top = ranking.orderBy(F.desc("total_ms"), "name").limit(most)
    listed = top.agg(F.transform(order, lambda w: F.struct(w["name"].alias("name"), w["total_ms"].alias("total_ms"))).alias("workspace_list"))
    return row.join(F.broadcast(days)).join(F.broadcast(listed))  # one row each


def record(sessions: DataFrame, state: DataFrame, log: DataFrame, ws_id: str, as_of_ms: int, config: Config | None = None, most: int = 1_000) -> DataFrame:
    """The whole record: ``dashboard`` with both switches and both lists."""
    config = config or Config()
    own, mine = sessions.where(F.col("ws_id") == ws_id), state.where(F.col("ws_id") == ws_id)
    row = dashboard(sessions, state, log, ws_id, as_of_ms, config)
    row = row.withColumns({"is_enabled": F.lit(config.enabled), "global_disabled": F.lit(config.global_disabled)})
    since = aggregates.open_elapsed(as_of_ms, F.col("current_start_ms"))
    seven = aggregates.last_seven_days(own, as_of_ms)
    running = mine.select(since.alias("since_ms"))  # today's bar has the open session
    last = F.max("at_ms").over(Window.partitionBy())  # seven rows
    seven = seven.withColumn("last_", last).join(F.broadcast(running), how="left")
    seven = seven.withColumn("total_ms", F.col("total_ms") + F.when(F.col("at_ms") == F.col("last_"), F.coalesce("since_ms", F.lit(0))).otherwise(0))
    return nested(row, seven, workspaces.ranking(log), most)
