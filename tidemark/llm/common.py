"""Shared helpers of the training-data operators: tables, shared scratch space, text blocks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_folder as scratch

#: Characters of text that a Python worker turns into numpy arrays at once.
BLOCK_CHARS = 500_000
#: Rows and bytes of an Arrow batch; a few very long texts then stay in one batch at most.
BATCH_ROWS, BATCH_BYTES = 2_000, 4 << 20
#: A table with one row a key is broadcast up to so many rows; beyond, a key with more rows than the second is dealt to several tasks.
BROADCAST_ROWS, HOT_ROWS = 2_000, 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a file that ``written`` aims at, of tables whose most rows are known.
FILE_ROWS = 50_000


def written(df: DataFrame, label: str, most_rows: int | None = None) -> DataFrame:
    """``df`` written to shared storage and read again: cuts the lineage so that a lost executor costs a reread only.

    With ``most_rows``, a table that has few goes into few files: no task then makes more than ``FILE_ROWS`` rows.
    """
    spark = df.sparkSession
    path = f"{scratch(spark, label)}/t"
    if most_rows is not None:
        df = df.coalesce(max(1, -(-most_rows // FILE_ROWS)))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def located(docs: DataFrame) -> DataFrame:
    """``docs`` if its rows can be found again by file and row; else a copy on shared storage that can."""
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
        return docs
    except AnalysisException:
        return written(docs, "contents")


def with_locator(docs: DataFrame, *cols: Column) -> DataFrame:
    return docs.select(*cols, F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row"))


def on_all_cores(scan: DataFrame) -> DataFrame:
    """``scan`` (read from files, nothing shuffled) as it is if it has a split for each core; else its rows dealt to all cores.

    A file of one row group is one task's, whatever work its rows make. What has fewer splits than the cluster has cores
    is small beside the cluster, and only then are rows moved; results are the same.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def arrow_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches that go to Python workers by rows and bytes, unless the session asks for less."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        try:
            size = int(now)
        except (TypeError, ValueError):
            size = 0
        if not 0 < size <= most:
            spark.conf.set(key, str(most))


def worker(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``work`` over Arrow batches, after which the process gives freed memory back: Python workers live on for later stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not every C library has it
                pass

    return run


def per_key(rows: DataFrame, table_: DataFrame, key: str, spread: Column) -> DataFrame:
    """``rows`` left-joined to a written table that has one row for each ``key``.

    A table of at most ``BROADCAST_ROWS`` rows is broadcast. Else the rows of a hot key are dealt by ``spread``, about
    ``HOT_ROWS`` to a part, and the table has that key's row once for each part. There are fewer hot keys than rows by
    ``HOT_ROWS``, so their list is broadcast.
    """
    if table_.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table_), key, "left")
    hot = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n__")).where(F.col("n__") > HOT_ROWS)
    hot = written(hot.select(key, F.ceil(F.col("n__") / HOT_ROWS).cast("int").alias("parts__")), "hot")
    parts = F.coalesce("parts__", F.lit(1))
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("part__", F.pmod(F.xxhash64(spread), parts).cast("int"))
    repeated = table_.join(F.broadcast(hot), key, "left").withColumn("part__", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts__")
    return dealt.drop("parts__").join(repeated, [key, "part__"], "left").drop("part__")


def whole_text(col: str = "text"):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def blocks(batch: pa.RecordBatch, text: int, chars: int = BLOCK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch whose texts have about ``chars`` characters; a longer text makes a slice of its own."""
    column = batch.column(text)
    if not len(column):
        return
    ends = np.cumsum(np.asarray(pc.binary_length(column).fill_null(0)), dtype=np.int64)
    start = 0
    while start < len(ends):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + chars, side="right")))
        part = batch.slice(start, stop - start)
        yield part, [x or "" for x in part.column(text).to_pylist()]
        start = stop


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
