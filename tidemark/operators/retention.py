"""Keeping the last rows of each workspace."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _last(rows: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The last n rows of each workspace; each task drops rows beyond n before the shuffle."""
    latest = Window.partitionBy("ws_id").orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("place_", F.row_number().over(latest)).where(F.col("place_") <= n).drop("place_")


def trim(sessions: DataFrame, most: int) -> DataFrame:
    """The last ``most`` sessions of each workspace by start; 0 and less: all."""
    return sessions if most <= 0 else _last(sessions, most, ["start_ms", "end_ms", "duration_ms"])


def peek_last(slices: DataFrame, n: int) -> DataFrame:
    """The newest n slices of each workspace, oldest first; none for n of 0 and less."""
    return _last(slices, n, ["ts_ms", "delta_ms"]).orderBy("ws_id", "ts_ms", "delta_ms") if n > 0 else slices.limit(0)


def ring(slices: DataFrame, capacity: int) -> DataFrame:
    """What a ring of this capacity holds after all slices of each workspace, and how many it has overwritten."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    counts = slices.groupBy("ws_id").agg(F.count(F.lit(1)).alias("pushed"))
    held = _last(slices, capacity, ["ts_ms", "delta_ms"]).join(counts, "ws_id")
    return held.select("ws_id", "ts_ms", "delta_ms", F.greatest(F.col("pushed") - capacity, F.lit(0)).cast("long").alias("overwritten"))
