"""Switches and flush decisions as columns, and the strategies as objects for the streaming side."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F


def should_count(enabled: Column, global_disabled: Column) -> Column:
    return ~global_disabled & enabled


def state(enabled: Column, global_disabled: Column) -> Column:
    return F.when(global_disabled, "globally-disabled").when(~enabled, "workspace-disabled").otherwise("enabled")


def due_by_time(count: Column, elapsed_ms: Column, interval_ms: int = 10_000) -> Column:
    return (count > 0) & (elapsed_ms >= interval_ms)


def due_by_size(count: Column, capacity: Column, ratio: float = 0.5) -> Column:
    return F.when(capacity > 0, count / capacity >= min(1.0, max(0.0, ratio))).otherwise(False)


def due(count: Column, capacity: Column, elapsed_ms: Column, interval_ms: int = 10_000, ratio: float = 0.5) -> Column:
    return due_by_time(count, elapsed_ms, interval_ms) | due_by_size(count, capacity, ratio)


class FlushStrategy(Protocol):
    """Decides when buffered slices are written."""

    def should_flush(self, count: int, capacity: int, elapsed_ms: int) -> bool: ...
    def flushed(self, written: int) -> None: ...


@dataclass
class ByTime:
    interval_ms: int = 10_000

    def should_flush(self, count: int, capacity: int, elapsed_ms: int) -> bool:
        return count > 0 and elapsed_ms >= self.interval_ms

    def flushed(self, written: int) -> None:
        pass


@dataclass
class BySize:
    ratio: float = 0.5

    def should_flush(self, count: int, capacity: int, elapsed_ms: int) -> bool:
        return capacity > 0 and count / capacity >= min(1.0, max(0.0, self.ratio))

    def flushed(self, written: int) -> None:
        pass


@dataclass
class ByEither:
    interval_ms: int = 10_000
    ratio: float = 0.5

    def should_flush(self, count: int, capacity: int, elapsed_ms: int) -> bool:
        return ByTime(self.interval_ms).should_flush(count, capacity, elapsed_ms) or BySize(self.ratio).should_flush(count, capacity, elapsed_ms)

    def flushed(self, written: int) -> None:
        pass
