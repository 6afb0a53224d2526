"""The latest flag of each entity, kept as state of a stream."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that keeps state by key, with timers.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "key string, ts timestamp, number long, flag string"


class LatestFlag(StatefulProcessor):
    """Gives out an entity's flag whenever a later row changes which row is its latest; of equal times the greatest number.

    Once the watermark is ``idle`` milliseconds past its latest row, an entity's state goes; a row after that starts anew.
    """

    def __init__(self, idle: int) -> None:
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", "ts timestamp, number long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.best.get() if self.best.exists() else None
        best, flag = (pd.Timestamp(held[0]), held[1]) if held else None, None
        for frame in rows:
            last = frame.sort_values(["ts", "number"]).iloc[-1]
            mine = (last["ts"], int(last["number"]))
            if best is None or mine > best:
                best, flag = mine, last["flag"]
        if flag is not None:
            self.best.update((best[0].to_pydatetime(), best[1]))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(best[0].timestamp() * 1000) + self.idle)
            yield pd.DataFrame({"key": [str(key[0])], "ts": [best[0]], "number": [best[1]], "flag": [flag]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.best.clear()
        yield pd.DataFrame({"key": pd.Series([], dtype=str), "ts": pd.Series([], dtype="datetime64[us]"), "number": pd.Series([], dtype="int64"), "flag": pd.Series([], dtype=str)})

    def close(self) -> None:
        pass


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """State by key needs that store; the setting is as before afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def flag_changes(stream: DataFrame, delay: str, idle: int, processor: type[LatestFlag] = LatestFlag) -> DataFrame:
    """key, ts, number, flag: one row for each batch in which a key's latest row changed. stream: key, ts, number, flag (not null).

    The last change of a key, by ts and number, is its flag. Rows further than ``delay`` behind the latest time seen may be dropped.
    """
    by = stream.withWatermark("ts", delay).groupBy("key")
    return by.transformWithStateInPandas(processor(idle), OUT, "Append", "EventTime")
