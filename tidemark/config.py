"""Settings with their defaults and ranges."""

from __future__ import annotations

from dataclasses import dataclass, fields
from typing import ClassVar


@dataclass(frozen=True)
class Config:
    # fixed values: the defaults of the ten settings
    enabled: bool = True
    global_disabled: bool = False
    status_bar_enabled: bool = True
    backup_to_file: bool = True
    journal_enabled: bool = True
    ring_buffer_capacity: int = 1024
    journal_flush_interval_ms: int = 10_000
    full_save_interval_ms: int = 60_000
    status_bar_format: str = "compact"
    max_sessions: int = 1000

    #: Least and most of the numeric settings (None: no bound).
    RANGES: ClassVar[dict] = {"ring_buffer_capacity": (64, 65_536), "journal_flush_interval_ms": (1_000, 300_000), "full_save_interval_ms": (5_000, 600_000), "max_sessions": (0, None)}

    def __post_init__(self):
        if self.status_bar_format not in ("compact", "detailed"):
            raise ValueError(f"status_bar_format: {self.status_bar_format!r}")
        for name, (least, most) in self.RANGES.items():
            value = getattr(self, name)
            if value < least or (most is not None and value > most):
                raise ValueError(f"{name}: {value} is out of range")

    @classmethod
    def read(cls, settings: dict) -> Config:
        """Settings by name; unknown names are left out, missing ones (and None) take the default."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in settings.items() if k in known and v is not None})
