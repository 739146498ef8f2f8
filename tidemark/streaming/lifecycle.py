"""The life of one workspace's session on storage: recovery, start, periodic saves, end; and what runs when."""

from __future__ import annotations

import logging
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..config import Config
from ..functions.time import DAY_MS
from ..sources import journal
from ..sources.state import STATE, VERSION, Registry, StorageProvider, delete_all, load_first, save_all
from .controller import Session, Timer
from .journal import BEAT_MS, Flusher

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Result:
    elapsed_ms: int
    total_ms: int
    session_count: int


class SessionManager:
    """Starts, saves and ends the sessions of one workspace.

    providers: where the state is saved, first the primary one. flusher: its journal. registry: the totals of all
    workspaces. Recovery counts as the original does (stored total, all of the journal, time since an unfinished
    session's start); with ``exact`` each slice counts once, and none after the last.
    """

    def __init__(self, spark: SparkSession, ws_id: str, name: str, providers: list[StorageProvider], flusher: Flusher, registry: Registry | None = None, config: Config | None = None, exact: bool = False):
        self.spark, self.ws_id, self.name, self.providers = spark, ws_id, name, providers
        self.flusher, self.registry, self.config, self.exact = flusher, registry, config or Config(), exact
        self.timer, self.active = Timer(), False
        self.buffer: deque[tuple[int, int]] = deque(maxlen=self.config.ring_buffer_capacity)

    def _state(self, total_ms: int, start_ms: int) -> DataFrame:
        sessions = [(s.start_ms, s.end_ms, s.duration_ms) for s in self.timer.sessions]  # bounded by retention
        return self.spark.createDataFrame([(VERSION, total_ms, start_ms, 0, self.config.enabled, sessions, None)], STATE)

    def _save(self, now_ms: int, total_ms: int, start_ms: int) -> bool:
        """Whether any place has it now."""
        return any(save_all(self._state(total_ms, start_ms), self.providers, now_ms))

    def recover(self, now_ms: int) -> int:
        """The total after what the journal holds and an unfinished session; saved, and the journal emptied."""
        stored = load_first(self.spark, self.providers).first()  # one row
        slices = journal.read(self.spark, self.flusher.path)
        if self.exact:
            slices = slices.where(slices.ts_ms > stored.last_saved_ms)
        total = stored.total_ms + int(slices.agg({"delta_ms": "sum"}).first()[0] or 0)
        elapsed = now_ms - stored.current_start_ms
        if not self.exact and stored.current_start_ms > 0 and 0 < elapsed < DAY_MS:
            total += elapsed
        self.timer = Timer(total, 0, [Session(s.start_ms, s.end_ms) for s in stored.sessions])
        if self._save(now_ms, total, 0):
            journal.truncate(self.spark, self.flusher.path)
        return total

    def start(self, now_ms: int) -> int:
        """Recovers and starts; the total it starts from. Starting twice does nothing."""
        if self.active:
            return self.timer.total_ms
        total = self.recover(now_ms)
        self.timer.start(now_ms)
        self.active = True
        return total

    def push(self, ts_ms: int, delta_ms: int) -> None:
        """A slice for the buffer; a full one loses its oldest."""
        self.buffer.append((ts_ms, delta_ms))

    def _drain(self, now_ms: int) -> None:
        """The buffer's slices to shared storage, where they wait to be written."""
        if self.buffer:
            rows = self.spark.createDataFrame(list(self.buffer), "ts_ms long, delta_ms long")
            self.flusher.take(rows, now_ms)
            self.buffer.clear()

    def try_flush(self, now_ms: int) -> int:
        if not self.config.journal_enabled:
            return 0
        self._drain(now_ms)
        return self.flusher.try_flush(now_ms)

    def checkpoint(self, now_ms: int) -> bool:
        """Saves the total with the open session in it; the session goes on."""
        return self._save(now_ms, self.timer.total_ms + self.timer.elapsed_ms(now_ms), self.timer.current_start_ms)

    def save_now(self, now_ms: int) -> bool:
        """Flushes if due, saves, and reports the total to the registry."""
        self.try_flush(now_ms)
        done = self.checkpoint(now_ms)
        self.sync(now_ms, self.timer.total_ms + self.timer.elapsed_ms(now_ms))
        return done

    def sync(self, now_ms: int, total_ms: int) -> None:
        if self.registry:
            self.registry.sync(self.ws_id, self.name, self.ws_id, total_ms, now_ms)

    def end(self, now_ms: int) -> Result:
        """Flushes all, stops, trims, saves, and empties the journal once the total is saved. Nothing without a session."""
        if not self.active:
            return Result(0, self.timer.total_ms, 0)
        if self.config.journal_enabled:
            self._drain(now_ms)
            self.flusher.flush_all(now_ms)
        elapsed = self.timer.stop(now_ms)
        self.active = False
        self.timer.trim(self.config.max_sessions)
        if self._save(now_ms, self.timer.total_ms, 0):
            journal.truncate(self.spark, self.flusher.path)
        self.sync(now_ms, self.timer.total_ms)
        return Result(elapsed, self.timer.total_ms, len(self.timer.sessions))

    def new_period(self, now_ms: int) -> None:
        """Ends the session, starts a total of 0 and a session; the sessions so far stay."""
        self.end(now_ms)
        self.timer.total_ms = 0
        self._save(now_ms, 0, 0)
        self.sync(now_ms, 0)
        self.timer.start(now_ms)
        self.active = True

    def delete_all(self) -> list[bool]:
        return delete_all(self.providers, self.flusher.path, self.spark)

    def today_ms(self, now_ms: int) -> int:
        """Of today's sessions and the open one, if it began today."""
        today = now_ms - now_ms % DAY_MS
        done = sum(s.duration_ms for s in self.timer.sessions if today <= s.start_ms < today + DAY_MS)
        return done + (self.timer.elapsed_ms(now_ms) if self.timer.current_start_ms >= today else 0)


class Scheduler:
    """Runs a session's three cadences: heartbeat, journal, full save. A failure of one is logged and stops none.

    ``run_due`` does what is due at an instant; ``run`` does so until a clock says None.
    """

    def __init__(self, session: SessionManager, on_tick: Callable[[int, int], None] | None = None, beat_ms: int = BEAT_MS):
        config = session.config
        self.session, self.on_tick = session, on_tick
        self.every = {"beat": beat_ms, "flush": config.journal_flush_interval_ms, "save": config.full_save_interval_ms}
        self.next: dict[str, int] = {}

    def start(self, now_ms: int) -> None:
        """Starting twice does nothing."""
        if not self.next:
            self.next = {k: now_ms + v for k, v in self.every.items()}

    def stop(self) -> None:
        self.next = {}

    def _beat(self, now_ms: int) -> None:
        self.session.push(now_ms, self.every["beat"])
        if self.on_tick:
            self.on_tick(self.session.timer.total_ms + self.session.timer.elapsed_ms(now_ms), self.session.today_ms(now_ms))

    def run_due(self, now_ms: int) -> list[str]:
        """What ran. An instant that was missed isn't made up for."""
        ran = []
        for name, work in (("beat", self._beat), ("flush", self.session.try_flush), ("save", self.session.checkpoint)):
            if name in self.next and now_ms >= self.next[name]:
                self.next[name] = now_ms + self.every[name]
                try:
                    work(now_ms)
                except Exception:
                    log.exception("%s failed", name)
                ran.append(name)
        return ran

    def run(self, clock: Callable[[], int | None]) -> None:
        """clock: waits for the next instant and gives it, or None to stop."""
        while (now_ms := clock()) is not None:
            self.run_due(now_ms)
        self.stop()
