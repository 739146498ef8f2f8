"""Durations and states as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: what stands before today's time and the total, and between them
TODAY, TOTAL, BETWEEN, ICON = "今日", "累计", " · ", "$(watch) "
#: fixed values: status bar modes in the order in which they take turns
MODES = ["today-total", "total-today", "compact"]
#: fixed values: status badges
BADGES = {"globally-disabled": "全局禁用", "workspace-disabled": "已禁用", "enabled": "运行中"}


def _parts(ms: Column) -> tuple[Column, Column, Column]:
    """Hours and minutes by floor; seconds (and minutes) keep the sign of the whole, as the remainder does."""
    seconds = F.floor(ms / 1000)
    return F.floor(seconds / 3600), F.floor((seconds % 3600) / 60), seconds % 60


def _text(n: Column, unit: str) -> Column:
    return F.concat(n.cast("string"), F.lit(unit))


def duration(ms: Column) -> Column:
    """1h 1m 1s; hours and minutes only if positive."""
    h, m, s = _parts(ms)
    return F.when(ms.isNotNull(), F.concat_ws(" ", F.when(h > 0, _text(h, "h")), F.when(m > 0, _text(m, "m")), _text(s, "s")))


def compact(ms: Column) -> Column:
    """The two greatest units: 1h 1m, 1m 0s, or 5s."""
    h, m, s = _parts(ms)
    return F.when(h > 0, F.concat_ws(" ", _text(h, "h"), _text(m, "m"))).when(m > 0, F.concat_ws(" ", _text(m, "m"), _text(s, "s"))).otherwise(_text(s, "s"))


def dual(today_ms: Column, total_ms: Column) -> Column:
    return F.concat(F.lit(f"{TODAY} "), compact(today_ms), F.lit(f"{BETWEEN}{TOTAL} "), compact(total_ms))


def status_bar(mode: Column, today_ms: Column, total_ms: Column, enabled: Column) -> Column:
    """Null when disabled (hidden) or for an unknown mode."""
    swapped = F.concat(F.lit(f"{TOTAL} "), compact(total_ms), F.lit(f"{BETWEEN}{TODAY} "), compact(today_ms))
    text = F.when(mode == MODES[0], dual(today_ms, total_ms)).when(mode == MODES[1], swapped).when(mode == MODES[2], compact(today_ms))
    return F.when(enabled, F.concat(F.lit(ICON), text))


def next_mode(mode: Column) -> Column:
    """The mode that follows; the first after an unknown one."""
    at = F.array_position(F.array(*map(F.lit, MODES)), mode).cast("int")
    return F.element_at(F.array(*map(F.lit, MODES)), at % len(MODES) + 1)


def badge(state: Column) -> Column:
    return F.coalesce(*[F.when(state == k, v) for k, v in BADGES.items()])


def bar_height(total_ms: Column, scale: Column) -> Column:
    """Per cent of the chart's height, two at least."""
    return F.greatest(total_ms / scale * 100, F.lit(2.0))


def clamp(ratio: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio))
