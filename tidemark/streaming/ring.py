"""A ring buffer for each workspace as stream state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

_ITEM = StructType([StructField("ts_ms", LongType()), StructField("delta_ms", LongType())])
OUTPUT = "ws_id string, ts_ms long, delta_ms long, overwritten long"
#: Session settings that the stateful operator needs.
SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class Ring(StatefulProcessor):
    """Keeps the last ``capacity`` slices of a workspace; gives what it holds after each batch."""

    def __init__(self, capacity: int):
        if capacity < 1:
            raise ValueError("capacity must be positive")
        self.capacity = capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getListState("items", _ITEM)
        self.count = handle.getValueState("count", StructType([StructField("pushed", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = list(self.items.get())
        pushed = self.count.get()[0] if self.count.exists() else 0
        for frame in rows:
            new = list(frame[["ts_ms", "delta_ms"]].itertuples(index=False, name=None))
            pushed += len(new)
            held = sorted([*held, *new])[-self.capacity :]
        self.items.put([tuple(map(int, h)) for h in held])
        self.count.update((pushed,))
        ts, delta = zip(*held, strict=True)
        yield pd.DataFrame({"ws_id": key[0], "ts_ms": ts, "delta_ms": delta, "overwritten": max(0, pushed - self.capacity)})

    def close(self) -> None:
        pass


def ring_stream(slices: DataFrame, capacity: int) -> DataFrame:
    """slices: a stream of ws_id, ts_ms, delta_ms. Needs ``SETTINGS``."""
    return slices.groupBy("ws_id").transformWithStateInPandas(statefulProcessor=Ring(capacity), outputStructType=OUTPUT, outputMode="Update", timeMode="None")
