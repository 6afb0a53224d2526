"""Shared helpers: stage tables in the cluster's shared folder, text as flat byte arrays."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, as a regular expression's class.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: The same six characters, for translate().
SPACE_CHARS = " \t\n\x0b\x0c\r"


@lru_cache(maxsize=1)
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="spark-checkpoint-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it.

    Where it is unset, Spark in one process (as in tests) takes a temporary folder; a
    cluster has no folder that would do, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_dir()


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again: its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def one_row_each(rows: DataFrame, keys: list[str], tied: str, row: str) -> DataFrame:
    """The struct ``row`` of each key, spread into its columns.

    Only keys for which ``tied`` is true have several rows; of those the row with the
    smallest hash of all its columns (but maps, which have none) is taken, after a partial
    aggregation, so that a hot key does not gather in one task.
    """
    of = rows.schema[row].dataType.fields
    order = F.xxhash64(*(F.col(f"{row}.`{f.name}`") for f in of if "map<" not in f.dataType.simpleString()))
    alone = rows.filter(~F.col(tied)).select(f"{row}.*")
    several = rows.filter(tied).groupBy(*keys).agg(F.min_by(row, order).alias(row)).select(f"{row}.*")
    return alone.unionAll(several)


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all values one after another, offsets of n + 1 entries) of a string column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = column.type in (pa.large_string(), pa.large_binary())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def by_bytes(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of at most ``limit`` bytes each, or of one row."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b
        a = b


def _trim() -> None:
    """Gives freed memory of Arrow and of the C library back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the Python worker gives unused memory back: workers outlive their stage."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _trim()

    return whole


def space_mask(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end byte, number of words in each row) of all words of flat texts."""
    solid = ~space_mask(data)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | edge[1:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:-1]
    first, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return first, end, np.diff(np.searchsorted(first, offsets))


class Numbering(dict):
    """Numbers keys in the order in which they first come."""

    def __missing__(self, key) -> int:
        self[key] = number = len(self)
        return number

    def codes(self, keys) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, keys), np.int64)


def raw_texts(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Each text's bytes."""
    raw = data[offsets[0] : offsets[-1]].tobytes()
    at = (offsets - offsets[0]).tolist()
    return [raw[a:b] for a, b in zip(at, at[1:])]
