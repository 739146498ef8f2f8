"""Sessions as CSV."""

from __future__ import annotations

from datetime import datetime, timezone
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.time import iso

#: fixed value: the columns' names in the file
HEADER = "Session Start,Session End,Duration (ms)"


def preamble(title: str, name: str, total_ms: int, as_of_ms: int) -> list[str]:
    """The lines before the sessions."""
    made = datetime.fromtimestamp(as_of_ms // 1000, timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.") + f"{as_of_ms % 1000:03d}Z"
    return [f"# {title}: {name}", f"# Generated: {made}", f"# Total: {total_ms}ms", "", HEADER]


class Exporter(Protocol):
    """A format in which the sessions of a workspace can be written."""

    format_name: str

    def export(self, sessions: DataFrame, name: str, total_ms: int, as_of_ms: int) -> str: ...


def rows(sessions: DataFrame) -> DataFrame:
    """Columns of the file: instants as ISO 8601 with milliseconds."""
    others = [c for c in sessions.columns if c not in ("start_ms", "end_ms", "duration_ms")]
    return sessions.select(*others, iso(F.col("start_ms")).alias("session_start"), iso(F.col("end_ms")).alias("session_end"), "duration_ms")


class CsvExporter:
    """``title`` opens the first comment line, before the workspace's name; ``most``: sessions that a file may have.

    Larger ones are for ``write``: they are refused here, not cut.
    """

    format_name = "csv"

    def __init__(self, title: str = "Time export", most: int = 100_000):
        self.title, self.most = title, most

    def export(self, sessions: DataFrame, name: str, total_ms: int, as_of_ms: int) -> str:
        """One workspace's file as text, in order of start.

        A name with a line break can't stand in a comment line and is refused.
        """
        if "\n" in name or "\r" in name:
            raise ValueError("the name must be one line")
        body = rows(sessions.orderBy("start_ms", "end_ms", "duration_ms")).select("session_start", "session_end", "duration_ms").limit(self.most + 1).collect()
        if len(body) > self.most:
            raise ValueError(f"more than {self.most} sessions: use write()")
        return "\n".join(preamble(self.title, name, total_ms, as_of_ms) + [f"{a},{b},{d}" for a, b, d in body])


def write(sessions: DataFrame, path: str) -> None:
    """All sessions as CSV files, without the comment lines, in parallel."""
    rows(sessions).write.mode("overwrite").option("header", True).csv(path)
