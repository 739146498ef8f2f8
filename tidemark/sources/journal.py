"""The journal: one JSON object {"t": instant, "d": duration} a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import delete, empty, exists

STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "mode": "PERMISSIVE"}
PARSED = "ts_ms double, delta_ms double"


def slice_of(line: Column) -> Column:
    """Struct t, d (double) of a line, or null unless it is one JSON object whose t and d are finite numbers.

    A line is parsed within brackets, where a second value shows, and as a member, where anything after it fails.
    """
    text = F.regexp_replace(line, r"^\s+|\s+$", "")
    several = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<struct<t:double,d:double>>", STRICT)
    single = F.from_json(F.concat(F.lit('{"w":'), text, F.lit("}")), "struct<w:struct<t:double,d:double>>", STRICT)["w"]
    first = F.get(several, F.lit(0))
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = (F.length(text) > 0) & (F.size(several) == 1) & number(first["t"]) & number(first["d"]) & number(single["t"]) & number(single["d"])
    return F.when(good, first)


def parse(lines: DataFrame, col: str = "value") -> DataFrame:
    """Adds ts_ms and delta_ms; lines that don't parse go."""
    return lines.withColumn("slice_", slice_of(F.col(col))).where("slice_ is not null").withColumns({"ts_ms": F.col("slice_.t"), "delta_ms": F.col("slice_.d")}).drop("slice_")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Slices of a journal; none if there is no file."""
    if not exists(spark, path):
        return empty(spark, PARSED)
    return parse(spark.read.option("recursiveFileLookup", "true").text(path)).select("ts_ms", "delta_ms")


def lines(slices: DataFrame) -> DataFrame:
    return slices.select(F.to_json(F.struct(F.col("ts_ms").alias("t"), F.col("delta_ms").alias("d"))).alias("value"))


def append(slices: DataFrame, path: str) -> None:
    """Adds part files; a failed write fails the caller, so that a batch is tried again."""
    lines(slices).write.mode("append").text(path)


def replace(slices: DataFrame, path: str, part: str) -> None:
    """Writes one named part of a journal; written again, it replaces itself and doesn't count twice."""
    lines(slices).write.mode("overwrite").text(f"{path}/part={part}")


def truncate(spark: SparkSession, path: str) -> None:
    delete(spark, path)
