"""Stored state of workspaces: JSON documents, validation, fallback and saving."""

from __future__ import annotations

import json
import logging
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Document, delete, empty

VERSION = 1
STATE = "version long, total_ms long, current_start_ms long, last_saved_ms long, is_enabled boolean, sessions array<struct<start_ms:long,end_ms:long,duration_ms:long>>, metadata map<string,string>"
_JSON = "version double, totalMs double, currentSessionStartMs double, lastSavedAtMs double, isEnabled boolean, sessions array<struct<startMs:double,endMs:double,durationMs:double>>, metadata map<string,string>"
_GLOBAL = "version double, totalMs double, workspaces map<string,struct<name:string,uri:string,totalMs:double,lastSyncedAt:double>>, lastUpdatedAt double"
log = logging.getLogger(__name__)


class StorageProvider(Protocol):
    """A place that keeps the state of one workspace."""

    def load(self) -> DataFrame | None: ...
    def save(self, state: DataFrame) -> None: ...
    def delete(self) -> None: ...
    def is_available(self) -> bool: ...


def decode(payloads: DataFrame, col: str = "value") -> DataFrame:
    """State columns of JSON payloads; those without a numeric total and version go."""
    rows = payloads.withColumn("j_", F.from_json(col, _JSON, {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}))
    rows = rows.where("j_.version is not null and j_.totalMs is not null")
    number = lambda c, to: F.coalesce(F.col(f"j_.{c}"), F.lit(0.0)).cast("long").alias(to)
    sessions = F.transform(F.coalesce("j_.sessions", F.expr("cast(array() as array<struct<startMs:double,endMs:double,durationMs:double>>)")), lambda s: F.struct(s["startMs"].cast("long").alias("start_ms"), s["endMs"].cast("long").alias("end_ms"), s["durationMs"].cast("long").alias("duration_ms")))
    kept = [c for c in payloads.columns if c != col]
    return rows.select(*kept, number("version", "version"), number("totalMs", "total_ms"), number("currentSessionStartMs", "current_start_ms"), number("lastSavedAtMs", "last_saved_ms"), F.coalesce("j_.isEnabled", F.lit(True)).alias("is_enabled"), sessions.alias("sessions"), F.col("j_.metadata").alias("metadata"))


def encode(state: DataFrame) -> DataFrame:
    sessions = F.transform("sessions", lambda s: F.struct(s["start_ms"].alias("startMs"), s["end_ms"].alias("endMs"), s["duration_ms"].alias("durationMs")))
    fields = [F.col("version"), F.col("total_ms").alias("totalMs"), F.col("current_start_ms").alias("currentSessionStartMs"), F.col("last_saved_ms").alias("lastSavedAtMs"), F.col("is_enabled").alias("isEnabled"), sessions.alias("sessions"), F.col("metadata")]
    kept = [c for c in state.columns if c not in ("version", "total_ms", "current_start_ms", "last_saved_ms", "is_enabled", "sessions", "metadata")]
    return state.select(*kept, F.to_json(F.struct(*fields), {"pretty": "true"}).alias("value"))


def decode_global(payloads: DataFrame, col: str = "value") -> DataFrame:
    """ws_id, name, uri, total_ms, synced_at of the registry; payloads without a numeric version count as empty."""
    rows = payloads.select(F.from_json(col, _GLOBAL).alias("g")).where("g.version is not null").select(F.explode("g.workspaces").alias("ws_id", "w"))
    return rows.select("ws_id", "w.name", "w.uri", F.col("w.totalMs").cast("long").alias("total_ms"), F.col("w.lastSyncedAt").cast("long").alias("synced_at"))


def fresh(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(VERSION, 0, 0, 0, True, [], None)], STATE)


class JsonFile:
    """One workspace's state as a JSON text on storage that the executors share; replaced as a whole."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.document = spark, path, Document(spark, path)

    def is_available(self) -> bool:
        return self.document.file() is not None

    def load(self) -> DataFrame | None:
        text = self.document.read()
        if text is None:
            return None
        state = decode(self.spark.createDataFrame([(text,)], "value string"))
        return None if state.isEmpty() else state

    def save(self, state: DataFrame) -> None:
        self.document.write(encode(state).select("value").first()[0])  # one workspace

    def delete(self) -> None:
        delete(self.spark, self.path)


class Registry:
    """All workspaces' latest totals as one JSON text, as its users know it; ``operators.workspaces`` has the scalable log.

    A text that is missing, broken or without a numeric version counts as an empty registry; a broken one also makes the
    registry unavailable.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.document, self.available = spark, Document(spark, path), True

    def _record(self) -> dict:
        none = {"version": VERSION, "totalMs": 0, "workspaces": {}, "lastUpdatedAt": 0}
        text = self.document.read()
        if not text:
            return none
        try:
            record = json.loads(text)
        except ValueError:
            log.exception("registry not read")
            self.available = False
            return none
        version = record.get("version") if isinstance(record, dict) else None
        return record if isinstance(version, int | float) and not isinstance(version, bool) else none

    def load(self) -> DataFrame:
        """ws_id, name, uri, total_ms, synced_at."""
        return decode_global(self.spark.createDataFrame([(json.dumps(self._record()),)], "value string"))

    def last_updated_ms(self) -> int:
        return int(self._record().get("lastUpdatedAt") or 0)

    def save(self, latest: DataFrame, as_of_ms: int) -> None:
        """Replaces the registry by these rows (ws_id, name, uri, total_ms, synced_at), stamped."""
        rows = {r.ws_id: {"name": r.name_, "uri": r.uri, "totalMs": r.total_ms, "lastSyncedAt": r.synced_at} for r in latest.select("ws_id", F.col("name").alias("name_"), "uri", "total_ms", "synced_at").toLocalIterator()}
        self._write(rows, as_of_ms)

    def sync(self, ws_id: str, name: str, uri: str, total_ms: int, as_of_ms: int) -> None:
        """One workspace's new total."""
        self._write(self._record().get("workspaces", {}) | {ws_id: {"name": name, "uri": uri, "totalMs": total_ms, "lastSyncedAt": as_of_ms}}, as_of_ms)

    def _write(self, rows: dict, as_of_ms: int) -> None:
        total = sum(r["totalMs"] for r in rows.values())
        self.document.write(json.dumps({"version": VERSION, "totalMs": total, "workspaces": rows, "lastUpdatedAt": as_of_ms}))

    def delete(self) -> None:
        delete(self.spark, self.document.path)


def load_first(spark: SparkSession, providers: list[StorageProvider]) -> DataFrame:
    """The first provider's state that is there and valid, else an empty one."""
    for provider in providers:
        found = provider.load()
        if found is not None:
            return found
    return fresh(spark)


def save_all(state: DataFrame, providers: list[StorageProvider], as_of_ms: int) -> list[bool]:
    """Stamps the state and saves it with each provider; a failure of one is logged and doesn't keep the others from saving."""
    stamped = state.withColumn("last_saved_ms", F.lit(as_of_ms).cast("long"))
    done = []
    for provider in providers:
        try:
            provider.save(stamped)
            done.append(True)
        except Exception:
            log.exception("state not saved")
            done.append(False)
    return done


def delete_all(providers: list, journal_path: str, spark: SparkSession) -> list[bool]:
    """Deletes a workspace's state everywhere and its journal; what fails is logged and keeps nothing else from going."""
    done = []
    for remove in [*[p.delete for p in providers], lambda: delete(spark, journal_path)]:
        try:
            remove()
            done.append(True)
        except Exception:
            log.exception("state not deleted")
            done.append(False)
    return done


def fallback(sources: list[DataFrame]) -> DataFrame:
    """Of several tables with ws_id, the row of the first table that has the workspace, and ``source``: the table's number."""
    union = None
    for i, df in enumerate(sources):
        df = df.withColumn("source", F.lit(i))
        union = df if union is None else union.unionByName(df)
    columns = [c for c in union.columns if c not in ("ws_id", "source")]
    best = union.groupBy("ws_id").agg(F.min_by(F.struct(*columns), "source").alias("row_"), F.min("source").alias("source"))
    return best.select("ws_id", "row_.*", "source")


def empty_sync_log(spark: SparkSession) -> DataFrame:
    from .tables import SYNC

    return empty(spark, SYNC)
