"""Slices as streams: heartbeat, journal files, batches to the journal, replay."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.flags import ByTime, FlushStrategy
from ..sources import journal
from ..storage import Manifest, delete

#: Milliseconds between batches: journal, full save, heartbeat.
FLUSH_MS, SAVE_MS, BEAT_MS = 10_000, 60_000, 1_000


def heartbeat(spark: SparkSession, delta_ms: int = BEAT_MS) -> DataFrame:
    """A slice a second; its length is the configured one, not measured."""
    beats = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return beats.select((F.unix_micros("timestamp") / 1000).cast("long").alias("ts_ms"), F.lit(delta_ms).cast("long").alias("delta_ms"))


def journal_stream(spark: SparkSession, path: str) -> DataFrame:
    """Slices of journal files as they come; broken lines go."""
    return journal.parse(spark.readStream.text(path)).select("ts_ms", "delta_ms")


def parquet_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """New files of a table. The last letter stands as a pattern, since a plain path must be a folder here, and a table may be one file."""
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")


def to_journal(slices: DataFrame, path: str, checkpoint: str, every_ms: int = FLUSH_MS, once: bool = False) -> StreamingQuery:
    """Writes slices as journal lines; the checkpoint makes each batch count once in the file sink's log."""
    writer = journal.lines(slices).writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{every_ms} milliseconds")).start()


def to_table(slices: DataFrame, path: str, checkpoint: str, every_ms: int = FLUSH_MS, once: bool = False) -> StreamingQuery:
    writer = slices.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{every_ms} milliseconds")).start()


def save_each(stream: DataFrame, save: Callable[[DataFrame, int], None], checkpoint: str, every_ms: int = SAVE_MS, once: bool = False) -> StreamingQuery:
    """Calls ``save(batch, batch_id)`` for each batch; a failure fails the batch, which then runs again."""
    writer = stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{every_ms} milliseconds")).start()


class Flusher:
    """Batches of slices that are written when the strategy says so; for use in ``save_each``.

    What is not due waits in tables on shared storage, listed in a manifest there. A new Flusher on the same folder goes
    on from it; a batch that comes again (by its number, which grows) is not taken twice; a flush that broke off is done
    again under its own name, which replaces what it had written.
    """

    def __init__(self, spark: SparkSession, folder: str, path: str, strategy: FlushStrategy | None = None, capacity: int = 1024):
        self.spark, self.path, self.capacity = spark, path, capacity
        self.strategy, self.folder = strategy or ByTime(), folder
        self.manifest = Manifest(spark, f"{folder}/manifest")
        record = self._record()
        if record["flushing"] is not None:
            self._finish(record)

    def _record(self) -> dict:
        return self.manifest.load({"waiting": [], "flushing": None, "taken_to": -1, "flushed_at_ms": None})

    @property
    def waiting(self) -> int:
        return sum(n for _, n in self._record()["waiting"])

    def push(self, batch: DataFrame, batch_id: int, now_ms: int) -> int:
        """Takes a batch; number of slices written now."""
        self.take(batch, now_ms, batch_id)
        return self.try_flush(now_ms)

    def take(self, batch: DataFrame, now_ms: int, batch_id: int | None = None) -> None:
        """Takes a batch, by default one that is new, and writes nothing yet."""
        record = self._record()
        batch_id = record["taken_to"] + 1 if batch_id is None else batch_id
        if batch_id > record["taken_to"]:
            part = f"{self.folder}/batch-{batch_id}"
            batch.write.mode("overwrite").parquet(part)
            record["waiting"].append([batch_id, self.spark.read.parquet(part).count()])
            record["taken_to"] = batch_id
            if record["flushed_at_ms"] is None:
                record["flushed_at_ms"] = now_ms
            self.manifest.save(record)

    def try_flush(self, now_ms: int) -> int:
        """Writes what waits if the strategy says so; number of slices written."""
        record = self._record()
        n = sum(n for _, n in record["waiting"])
        since = now_ms - (now_ms if record["flushed_at_ms"] is None else record["flushed_at_ms"])
        return self.flush_all(now_ms) if self.strategy.should_flush(n, self.capacity, since) else 0

    def flush_all(self, now_ms: int) -> int:
        """Writes everything that waits; all of it, a full buffer as well."""
        record = self._record()
        n = sum(n for _, n in record["waiting"])
        record["flushed_at_ms"] = now_ms
        if n:
            record["flushing"] = [i for i, _ in record["waiting"]]
            self.manifest.save(record)
            self._finish(record)
        else:
            self.manifest.save(record)
        self.strategy.flushed(n)
        return n

    def _finish(self, record: dict) -> None:
        done = set(record["flushing"])
        parts = [f"{self.folder}/batch-{i}" for i in record["flushing"]]
        journal.replace(self.spark.read.parquet(*parts), self.path, f"{max(done):012d}")
        self.manifest.save(record | {"waiting": [w for w in record["waiting"] if w[0] not in done], "flushing": None})
        for part in parts:
            delete(self.spark, part)
