"""Exact dedup by a keyed, disk-backed stream state that never expires.

Documents land as (digest, identifier, locator): the SHA-256 of the text, the document's id, and the place of its
content (file, row in file). A stream over the landed rows keeps, for each digest, the largest identifier with its
locator, and the number of texts seen, in RocksDB state without a watermark; equal digests are combined before the
shuffle, so a text that is a third of all rows costs each task one row. New rows continue from the stored state.
Digests that were seen more than once are hits: their contents are fetched by locator (no other text leaves the scan)
and grouped by digest and full bytes, equal ones once a task. A digest with two different contents (a collision) is
split by its bytes.

``add`` lands a batch under a name: called again with that name, after a failure, it doesn't land or count it again.

Null text counts as empty; texts are compared as they are. Of equal texts the row with the largest id stays; null
ids count as smallest; among repeated rows of the same id and text the one with the last locator stays, so exactly
one row of a group has ``kept``. An empty table gives an empty result. Extra columns are not read, whatever they
are called.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import exists
from .common import located, scratch, table, whole_text, with_locator, written
from .rows import fetched, without

#: Session settings while the stream runs: state on disk, closed when a batch is done, its memory shared and bounded.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",  # else each partition's store stays in the executor
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each partition reserves megabytes of disk
}
LANDED = "digest binary, doc_id long, path string, row long"


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


class Deduplicator:
    """Landed rows, stream state and decisions in one folder; ``add`` may be called again with more documents."""

    def __init__(self, spark: SparkSession, folder: str | None = None, digest=sha256):
        self.spark, self.digest = spark, digest
        self.folder = folder or scratch(spark, "dedup")
        self.landing, self.checkpoint = f"{self.folder}/landing", f"{self.folder}/state"

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> None:
        """Lands the documents, unless a batch of this name has landed, and runs the stream over what is new."""
        rows = with_locator(docs, self.digest(whole_text(text_col)).alias("digest"), F.col(f"`{id_col}`").cast("long").alias("doc_id"))
        place = f"{self.landing}/{batch or uuid.uuid4().hex}"
        if not exists(self.spark, f"{place}/_SUCCESS"):
            rows.write.mode("overwrite").parquet(place)
        with _settings(self.spark, STATE):
            seen = self.spark.readStream.schema(LANDED).parquet(f"{self.landing}/*")
            state = seen.groupBy("digest").agg(F.max(F.struct("doc_id", "path", "row")).alias("keep"), F.count(F.lit(1)).alias("n"))
            query = state.writeStream.outputMode("update").format("noop").option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()
            query.awaitTermination()

    def landed(self) -> DataFrame:
        return self.spark.read.schema(LANDED).parquet(f"{self.landing}/*")

    def state(self) -> DataFrame:
        """digest, keep (doc_id, path, row), n: what the stream has stored."""
        with _settings(self.spark, STATE):
            stored = self.spark.read.format("statestore").load(self.checkpoint)
            keep, n = (f"value.`{f.name}`" for f in stored.schema["value"].dataType.fields)
            return stored.select("key.digest", F.col(keep).alias("keep"), F.col(n).alias("n"))

    def decisions(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """path, row, doc_id, keep_id, group_size, kept, text_sha256 of every landed row. ``docs``: the documents added."""
        state = written(self.state(), "dedup-state")
        decided = self.landed().join(state, "digest")
        hits = decided.where("n > 1").select("path", "row")
        text = whole_text(text_col)
        bytes_of = fetched(docs, hits, self.digest(text).alias("digest"), text.alias("text"), F.col(f"`{id_col}`").cast("long").alias("doc_id"))
        classes = bytes_of.groupBy("digest", "text").agg(F.max(F.struct("doc_id", "path", "row")).alias("keep_"), F.count(F.lit(1)).alias("n_"))
        collided = classes.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest")
        if not collided.isEmpty():
            split = bytes_of.join(classes.join(collided, "digest", "left_semi"), ["digest", "text"]).select("path", "row", "keep_", "n_")
            decided = decided.join(split, ["path", "row"], "left").withColumns({"keep": F.coalesce("keep_", "keep"), "n": F.coalesce("n_", "n")})
        return decided.select(
            "path",
            "row",
            "doc_id",
            F.col("keep.doc_id").alias("keep_id"),
            F.col("n").alias("group_size"),
            ((F.col("keep.path") == F.col("path")) & (F.col("keep.row") == F.col("row"))).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256) -> DataFrame:
    """Decisions on one set of documents, each row with its locator."""
    docs = located(docs)
    dedup = Deduplicator(docs.sparkSession, digest=digest)
    dedup.add(docs, id_col, text_col)
    return dedup.decisions(docs, id_col, text_col)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    docs = located(docs)
    return without(docs, decide(docs, id_col, text_col).where("not kept"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.text) AS text_sha256
FROM d JOIN g ON d.text = g.text
"""
