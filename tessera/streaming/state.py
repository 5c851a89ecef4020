"""Logs that arrive as streams: what was last of each key, and how much there is, kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = "bigint"
OUT = "key string, n long, latest_order long, latest_entry string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LatestOfKey(StatefulProcessor):
    """Of a key: the orders that it has seen, how many these are, and the entry of the greatest one.

    An entry that arrives again counts once, one that is late counts but isn't the latest. Of two entries of one order the first
    to arrive stays. The orders seen lie in the state store, not in a task's memory; `forget_ms` bounds how long.
    """

    def __init__(self, forget_ms: int | None = None):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", f"o {STATE}", "b boolean", self.forget_ms)
        self.last = handle.getValueState("last", f"n {STATE}, o {STATE}, e string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, order, entry = self.last.get() if self.last.exists() else (0, None, None)
        for batch in rows:
            for o, e in zip(batch["order"].tolist(), batch["entry"].tolist(), strict=True):
                if self.seen.containsKey((o,)):
                    continue
                self.seen.updateValue((o,), (True,))
                n += 1
                if order is None or o > order:
                    order, entry = o, e
        self.last.update((n, order, entry))
        yield pd.DataFrame({"key": [key[0]], "n": [n], "latest_order": [order], "latest_entry": [entry]})

    def close(self) -> None:
        pass


def log_rows(log: DataFrame, key: str, order: str, entry: str) -> DataFrame:
    """(key, order, entry) of the rows that have a key and an order."""
    return log.select(F.col(key).cast("string").alias("key"), F.col(order).cast("long").alias("order"), F.col(entry).cast("string").alias("entry")).where("key is not null and `order` is not null")


def latest_stream(log: DataFrame, key: str, order: str, entry: str, forget_ms: int | None = None) -> DataFrame:
    """(key, n, latest_order, latest_entry) of each key that a micro-batch touches: the last row of a key is what `latest` gives for the whole log.

    For versions of graphs (key: the graph), snapshots, and feedback (key: its type). Needs RocksDB as the state store.
    """
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = log_rows(log, key, order, entry).groupBy("key")
    return rows.transformWithStateInPandas(LatestOfKey(forget_ms), outputStructType=OUT, outputMode="Update", timeMode="ProcessingTime" if forget_ms else "None")


def latest(log: DataFrame, key: str, order: str, entry: str) -> DataFrame:
    """The same of a table: counts of distinct orders, and the entry of the greatest; entries of one order must be equal."""
    return log_rows(log, key, order, entry).groupBy("key").agg(F.count_distinct("order").alias("n"), F.max("order").alias("latest_order"), F.max_by("entry", "order").alias("latest_entry"))
