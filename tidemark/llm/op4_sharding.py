"""Sharding by a permutation-filled lookup table.

Each shard has its own preference order of the slots of a prime-sized table (offset, then steps of a fixed skip);
shards take turns, each claiming its next free slot (a weighted shard takes as many turns as its weight), until the
table is full. A key's hash picks a slot in constant time. The table has ``size`` rows whatever the data, so it is
broadcast. Adding or removing a shard moves few keys beyond its own share.

Keys: null and missing parts count as one fixed value of their own, so that rows with null keys go to one shard
(shard by a unique key such as an id where a key value may be hot). Repeated rows go to the same shard. Keys are hashed
whole, however long. An empty table gives an empty result; an empty list of keys is refused.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Production size: a prime of at least a hundred slots for each of up to 600 shards.
SIZE, SHARDS = 65_537, 64


def _number(text: str) -> int:
    return int.from_bytes(hashlib.md5(text.encode()).digest()[:8], "big")


def _prime(n: int) -> bool:
    return n > 1 and all(n % i for i in range(2, int(n**0.5) + 1))


def fill(shards: list[str], size: int = SIZE, weights: list[int] | None = None) -> np.ndarray:
    """slot -> index of its shard in ``shards``. Names must differ; weights are positive integers."""
    weights = weights or [1] * len(shards)
    if not shards or len(set(shards)) < len(shards) or len(weights) != len(shards) or min(weights) < 1:
        raise ValueError("shards must be distinct, at least one, with positive integer weights")
    if not _prime(size) or size < sum(weights):
        raise ValueError("size must be a prime, no less than the sum of the weights")
    at = [_number(f"offset:{s}") % size for s in shards]
    skip = [_number(f"skip:{s}") % (size - 1) + 1 for s in shards]
    slots, left = np.full(size, -1, np.int32), size
    taken = bytearray(size)
    while left:
        for i, turns in enumerate(weights):
            for _ in range(turns):
                if not left:
                    break
                x = at[i]
                while taken[x]:
                    x = (x + skip[i]) % size
                taken[x], slots[x] = 1, i
                at[i] = (x + skip[i]) % size
                left -= 1
    return slots


def slot_of(*cols: str, size: int = SIZE):
    """The slot of a key: 60 bits of its MD5, modulo the table's size. Each part is marked null or given by length, so no two keys read alike."""
    parts = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in cols]
    text = F.concat_ws("|", *parts)
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long") % size).cast("int")


def place(df: DataFrame, keys: list[str], shards: list[str] | None = None, size: int = SIZE, weights: list[int] | None = None) -> DataFrame:
    """Adds ``slot`` and ``shard`` (a shard's name) to every row; columns of those names are replaced. No shuffle."""
    if not keys:
        raise ValueError("keys must name at least one column")
    shards = shards or [f"shard-{i:05d}" for i in range(SHARDS)]
    slots = fill(shards, size, weights)
    spark = df.sparkSession
    lookup = spark.createDataFrame([(i, shards[s]) for i, s in enumerate(slots.tolist())], "slot_ int, shard_ string")
    kept = [c for c in df.columns if c.lower() not in ("slot", "shard")]
    slotted = df.select(*[F.col(f"`{c}`") for c in kept], slot_of(*keys, size=size).alias("slot__"))
    out = slotted.join(F.broadcast(lookup), F.col("slot__") == F.col("slot_"))  # size rows, a parameter
    return out.select(*[F.col(f"`{c}`") for c in kept], F.col("slot__").alias("slot"), F.col("shard_").alias("shard"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"])


def oracle_sql() -> str:
    """The placement in SQL. Filling the table takes turns, which SQL can't say; tests hold fill() against a brute-force version."""
    names = ",".join(f"{s}" for s in fill([f"shard-{i:05d}" for i in range(SHARDS)]))
    slot = f"(CAST('0x' || substr(md5(CASE WHEN doc_id IS NULL THEN '-' ELSE length(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR) END), 1, 15) AS BIGINT) % {SIZE})"
    return f"""WITH t AS (SELECT string_split('{names}', ',') AS s), k AS (SELECT doc_id, CAST({slot} AS INTEGER) AS slot FROM documents)
SELECT doc_id, slot, 'shard-' || lpad(s[slot + 1], 5, '0') AS shard FROM k, t"""
