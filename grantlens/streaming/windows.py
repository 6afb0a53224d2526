"""Event-time windows on a stream. Rows count by when they happened; a watermark closes windows and drops what comes too late.

A window is given out once, when the watermark (the latest time seen, less the delay) reaches its end. A row whose window the
watermark had reached before the row's batch is dropped; windows that are open when the stream ends are not given out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _counted(stream: DataFrame, time: str, delay: str, window: Column, keys: list[str], measures: list[Column]) -> DataFrame:
    found = stream.withWatermark(time, delay).groupBy(window.alias("w"), *keys).agg(*measures)
    return found.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *(c for c in found.columns if c != "w"))


def tumbling(stream: DataFrame, time: str, size: str, delay: str, keys: list[str], measures: list[Column]) -> DataFrame:
    """window_start, window_end, keys, measures of windows that follow one another."""
    return _counted(stream, time, delay, F.window(time, size), keys, measures)


def sliding(stream: DataFrame, time: str, size: str, step: str, delay: str, keys: list[str], measures: list[Column]) -> DataFrame:
    """The same of windows that begin every ``step``: a row is in several, and may be late for some of them only."""
    return _counted(stream, time, delay, F.window(time, size, step), keys, measures)


def sessions(stream: DataFrame, time: str, gap: str, delay: str, keys: list[str], measures: list[Column]) -> DataFrame:
    """The same of runs of rows of a key that follow one another within the gap; a session ends a gap after its last row."""
    return _counted(stream, time, delay, F.session_window(time, gap), keys, measures)
