"""Keyed count-based windows over a stream, with the results of the batch operator."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

AGGREGATES = {"mean": np.mean, "max": np.max, "p95": lambda x, axis: np.percentile(x, 95, axis=axis)}
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession):
    """Start queries with keyed_windows inside this: their state needs the RocksDB store; the session's setting is put back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


class CountWindows(StatefulProcessor):
    """Of every key: how many rows it has had, and its last size - 1 rows in a ring of as many slots.

    A row takes the slot of its number modulo size - 1, so a batch writes the rows it brings, at most size - 1 of them,
    and leaves the others where they are.
    """

    def __init__(self, order: list[str], values: list[str], columns: list[str], size: int, stride: int, how: str):
        self.order, self.values, self.columns, self.size, self.stride, self.how = order, values, columns, size, stride, how

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n long")
        self.ring = handle.getMapState("ring", "slot int", ", ".join(f"`{v}` double" for v in self.values))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows), ignore_index=True).sort_values(self.order, ignore_index=True)
        seen = self.seen.get()[0] if self.seen.exists() else 0
        ring = self.size - 1
        held = min(seen, ring)
        x = np.empty((held + len(new), len(self.values)))
        if held:
            known = {slot[0]: value for slot, value in self.ring.iterator()}
            x[:held] = [known[n % ring] for n in range(seen - held, seen)]
        x[held:] = new[self.values].to_numpy(float)
        place = seen + 1 + np.arange(len(new))  # of every row in its key, from 1
        first = max(self.size, self.stride)
        ends = np.flatnonzero((place >= first) & ((place - first) % self.stride == 0))
        out = new.iloc[ends][self.columns].reset_index(drop=True)
        if len(ends):  # a window that ends at a row starts size - 1 rows before it
            frames = np.lib.stride_tricks.sliding_window_view(x, self.size, axis=0)[ends + held - ring]
            out[self.values] = AGGREGATES[self.how](frames, axis=2)
        for i in range(max(0, len(new) - ring), len(new)):
            self.ring.updateValue(((seen + i) % ring,), tuple(map(float, x[held + i])))
        self.seen.update((seen + len(new),))
        yield out.astype({v: float for v in self.values})

    def close(self) -> None:
        pass


def keyed_windows(stream: DataFrame, key: str, order: list[str], values: list[str], size: int, stride: int = 1, how: str = "mean", keep: list[str] = ()) -> DataFrame:
    """The windows of each key in append mode; start the query inside state_store.

    The first window ends at row max(size, stride) of its key, the next ones `stride` rows later each. Rows of one
    micro-batch are put in order inside their key, so a task holds one key's rows of one batch, which the source's limit
    on files or offsets per trigger bounds; across batches the source must be in order within a key, as a partition of a
    broker is.
    """
    if how not in AGGREGATES:
        raise ValueError(f"unknown aggregate {how}; known: {', '.join(AGGREGATES)}")
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    columns = list(dict.fromkeys([key, *order, *keep, *values]))
    fields = ", ".join(f"`{c}` {'double' if c in values else kinds[c]}" for c in columns)
    return stream.select(*columns).groupBy(key).transformWithStateInPandas(CountWindows(order, values, columns, size, stride, how), fields, "append", "none")
