"""The life cycle of a timer as a state machine: what runs follows from the switches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from ..config import Config
from ..sources.state import VERSION


@dataclass(frozen=True)
class Session:
    start_ms: int
    end_ms: int

    @property
    def duration_ms(self) -> int:
        return self.end_ms - self.start_ms


@dataclass
class Timer:
    """Start and stop of one workspace's sessions; doing either twice does nothing."""

    total_ms: int = 0
    current_start_ms: int = 0
    sessions: list[Session] = field(default_factory=list)
    version: int = VERSION

    def start(self, now_ms: int) -> None:
        if self.current_start_ms == 0:
            self.current_start_ms = now_ms

    def stop(self, now_ms: int) -> int:
        """Elapsed milliseconds; 0 if it didn't run."""
        if self.current_start_ms == 0:
            return 0
        session = Session(self.current_start_ms, now_ms)
        self.sessions.append(session)
        self.total_ms += session.duration_ms
        self.current_start_ms = 0
        return session.duration_ms

    def elapsed_ms(self, now_ms: int) -> int:
        return now_ms - self.current_start_ms if self.current_start_ms else 0

    def trim(self, most: int) -> None:
        if most > 0:
            del self.sessions[:-most]


class Controller:
    """States idle, running, disabled, saving. Re-enabling starts again; a new period keeps the sessions."""

    def __init__(self, timer: Timer | None = None, config: Config | None = None, on_state: Callable[[str], None] | None = None):
        self.timer, self.config, self.on_state, self.state = timer or Timer(), config or Config(), on_state, "idle"
        self.period_start_ms = 0

    def _to(self, state: str) -> None:
        self.state = state
        if self.on_state:
            self.on_state(state)

    @property
    def counts(self) -> bool:
        return self.config.enabled and not self.config.global_disabled

    def start(self, now_ms: int) -> None:
        if not self.counts:
            self._to("disabled")
            return
        self.timer.start(now_ms)
        self._to("running")

    def stop(self, now_ms: int) -> int:
        self._to("saving")
        elapsed = self.timer.stop(now_ms)
        self.timer.trim(self.config.max_sessions)
        self._to("idle")
        return elapsed

    def configure(self, now_ms: int, **changes) -> None:
        """New settings; the timer starts or stops if they say so."""
        self.config = replace(self.config, **changes)
        if self.counts and self.state == "disabled":
            self.start(now_ms)
        elif not self.counts and self.state in ("running", "idle"):
            if self.state == "running":
                self.stop(now_ms)
            self._to("disabled")

    def new_period(self, now_ms: int) -> None:
        self.stop(now_ms)
        self.timer.total_ms, self.period_start_ms = 0, now_ms
        self.start(now_ms)
