"""Sessions, slices and sync records from the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import workspace_id
from ..functions.time import to_ms  # noqa: F401

SESSION = "ws_id string, start_ms long, end_ms long, duration_ms long"
SLICE = "ws_id string, ts_ms long, delta_ms long"
SYNC = "ws_id string, name string, uri string, total_ms long, synced_at long"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _between(events: DataFrame, since_ms: int | None, until_ms: int | None) -> DataFrame:
    """A half-open range on the raw column, which reaches the Parquet scan."""
    at = lambda ms: F.expr(f"timestampadd(MILLISECOND, {ms}L, timestamp_ntz'1970-01-01 00:00:00')")
    if since_ms is not None:
        events = events.where(F.col("ts") >= at(since_ms))
    return events if until_ms is None else events.where(F.col("ts") < at(until_ms))


def sessions(events: DataFrame, since_ms: int | None = None, until_ms: int | None = None) -> DataFrame:
    """An event is a session of its user's workspace that starts at ``ts`` and lasts ``value`` seconds."""
    duration = F.round(F.col("value") * 1000).cast("long")
    rows = _between(events, since_ms, until_ms)
    ws_id = F.concat(F.lit("file:///ws/"), F.col("user_id").cast("string"))
    return rows.select(ws_id.alias("ws_id"), to_ms("ts").alias("start_ms"), (to_ms("ts") + duration).alias("end_ms"), duration.alias("duration_ms"))


def slices(sessions_: DataFrame) -> DataFrame:
    """Sessions as slices, each at its end."""
    return sessions_.select("ws_id", F.col("end_ms").alias("ts_ms"), F.col("duration_ms").alias("delta_ms"))


def sync_log(events: DataFrame) -> DataFrame:
    """Each event reports its workspace's total; uris vary in case and final slashes."""
    user = F.col("user_id").cast("string")
    uri = F.concat(F.when(F.col("event_id") % 2 == 0, "FILE:///WS/").otherwise("file:///ws/"), user, F.when(F.col("event_id") % 3 == 0, "//").otherwise(""))
    return events.select(workspace_id(uri).alias("ws_id"), F.concat(F.lit("ws "), user).alias("name"), uri.alias("uri"), F.round(F.col("value") * 1000).cast("long").alias("total_ms"), to_ms("ts").alias("synced_at"))


def open_sessions(sessions_: DataFrame) -> DataFrame:
    """ws_id, current_start_ms: the latest session of every workspace with an even number is still open; 0 elsewhere."""
    last = sessions_.groupBy("ws_id").agg(F.max("start_ms").alias("last"))
    even = F.regexp_extract("ws_id", "([0-9]+)$", 1).cast("long") % 2 == 0
    return last.select("ws_id", F.when(even, F.col("last")).otherwise(F.lit(0).cast("long")).alias("current_start_ms"))
