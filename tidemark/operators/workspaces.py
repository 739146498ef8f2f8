"""Totals over workspaces from their sync records: the latest record of each counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_sync(log: DataFrame) -> DataFrame:
    """The latest record of each workspace (of equal times the one with the larger total), and when it was first seen.

    An aggregate, not a ranking: records of one workspace are combined before the shuffle.
    """
    latest = F.max(F.struct("synced_at", "total_ms", "name", "uri")).alias("r")
    rows = log.groupBy("ws_id").agg(latest, F.min("synced_at").alias("first_seen"))
    return rows.select("ws_id", "r.name", "r.uri", "r.total_ms", "r.synced_at", "first_seen")


def sync(log: DataFrame, record: DataFrame) -> DataFrame:
    """The log with one more record."""
    return log.unionByName(record)


def snapshot(log: DataFrame) -> DataFrame:
    """total_ms, workspace_count: one row."""
    return latest_sync(log).agg(F.coalesce(F.sum("total_ms"), F.lit(0)).cast("long").alias("total_ms"), F.count(F.lit(1)).alias("workspace_count"))


def ranking(log: DataFrame) -> DataFrame:
    """ws_id, name, total_ms in order of total; ties by when a workspace was first seen, then by id."""
    return latest_sync(log).orderBy(F.desc("total_ms"), "first_seen", "ws_id").select("ws_id", "name", "total_ms")


def top(log: DataFrame, n: int) -> DataFrame:
    """The first n of the ranking with their places; the sort keeps n rows a task."""
    rows = latest_sync(log).orderBy(F.desc("total_ms"), "first_seen", "ws_id").limit(n)
    order = Window.orderBy(F.desc("total_ms"), "first_seen", "ws_id")  # n rows
    return rows.select("ws_id", "name", "total_ms", F.row_number().over(order).alias("place"))


def list_shown(log: DataFrame) -> DataFrame:
    """One row: whether there is more than one workspace to list."""
    return snapshot(log).select((F.col("workspace_count") > 1).alias("list_shown"))
