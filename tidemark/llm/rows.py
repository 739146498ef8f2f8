"""Rows of a table by their places (file, row in file): taking them and leaving them out, without a shuffle of the table.

Places become bitmaps, one for each 32,768 rows of a file, that meet the scan as a broadcast table: a bit a row, whatever
the rows hold. Where all bitmaps have more than ``GROUP_BYTES``, files are dealt into groups that have fewer each, and
each group is scanned with its own; every file is still read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Bytes of the bitmaps that are broadcast at once, and of one bitmap with its file's name.
GROUP_BYTES, BITMAP_BYTES = 32 << 20, 4_096 + 512


def _marked(docs: DataFrame, places: DataFrame, cols: list[Column]) -> list[DataFrame]:
    """``cols`` of ``docs`` with at_path__, at_row__ and hit__ (whether the row is at one of ``places``), a table for each group of files."""
    at = F.col("row") + 1  # Spark counts the bits of its bitmaps from 1
    bits = places.groupBy(F.col("path").alias("path__"), F.bitmap_bucket_number(at).alias("bucket__")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits__"))
    bits = written(bits, "places")
    group = lambda path, groups: F.pmod(F.xxhash64(path), F.lit(groups))
    n, groups = bits.count(), 1
    while n * BITMAP_BYTES > groups * GROUP_BYTES:
        groups *= 2
    here = F.col("at_row__") + 1
    byte = F.conv(F.hex(F.substring("bits__", F.floor(F.bitmap_bit_position(here) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    hit = F.coalesce(F.getbit(byte, F.bitmap_bit_position(here) % 8) == 1, F.lit(False))
    out = []
    for g in range(groups):
        some, known = docs, bits
        if groups > 1:
            some, known = docs.where(group(F.col("_metadata.file_path"), groups) == g), bits.where(group(F.col("path__"), groups) == g)
        rows = some.select(*cols, F.col("_metadata.file_path").alias("at_path__"), F.col("_metadata.row_index").alias("at_row__"))
        near = (F.col("at_path__") == F.col("path__")) & (F.bitmap_bucket_number(here) == F.col("bucket__"))
        out.append(rows.join(F.broadcast(known), near, "left").withColumn("hit__", hit).drop("path__", "bucket__", "bits__"))  # about GROUP_BYTES
    return out


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` (read from files) without the rows at ``dropped`` (path, row), all columns kept."""
    return _union([x.where("not hit__").drop("at_path__", "at_row__", "hit__") for x in _marked(docs, dropped, [F.col("*")])])


def fetched(docs: DataFrame, places: DataFrame, *cols: Column) -> DataFrame:
    """path, row and ``cols`` of the rows of ``docs`` (read from files) at ``places`` (path, row); nothing else leaves the scan."""
    parts = [x.where("hit__").drop("hit__") for x in _marked(docs, places, list(cols))]
    return _union(parts).withColumnsRenamed({"at_path__": "path", "at_row__": "row"})
