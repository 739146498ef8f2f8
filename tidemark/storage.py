"""Folders that driver and executors share."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Deletes the shared folders that are made within, at its end: for results that have been written elsewhere by then."""
    before = len(_made)
    try:
        yield
    finally:
        for path in _made[before:]:
            delete(spark, path)
        del _made[before:]


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, removed when the driver's JVM ends, or before by ``temporary``.

    Where that is unset, a local folder serves a local session; a cluster needs shared storage, and is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file:///tmp/checkpoints/tidemark"
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop)
    fs.deleteOnExit(hadoop)
    return path


class Document:
    """A small text on shared storage that is replaced as a whole: a reader finds the old one or the new one, never none.

    Each version is a file of its own, written aside and then renamed; the latest counts and older ones are removed.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._new = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._new(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        folder = self._new(self.path)
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())

    def file(self) -> str | None:
        """The latest version's file."""
        versions = self._versions()
        return f"{self.path}/{versions[-1]:012d}.json" if versions else None

    def read(self) -> str | None:
        file = self.file()
        if file is None:
            return None
        stream = self._fs.open(self._new(file))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, text: str) -> None:
        versions = self._versions()
        aside = self._new(f"{self.path}/_{uuid.uuid4().hex}")
        stream = self._fs.create(aside)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self._fs.rename(aside, self._new(f"{self.path}/{(versions or [0])[-1] + 1:012d}.json")):
            self._fs.delete(aside, False)
            raise OSError(f"{self.path}: another writer was first")
        for old in versions:
            self._fs.delete(self._new(f"{self.path}/{old:012d}.json"), False)


class Manifest(Document):
    """A JSON record."""

    def load(self, default: dict) -> dict:
        text = self.read()
        return default if text is None else json.loads(text)

    def save(self, record: dict) -> None:
        self.write(json.dumps(record))


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def delete(spark: SparkSession, path: str) -> bool:
    """Removes a table's files; False if there were none."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
