"""A bounded stream: batches land one after another, and each is processed by a stream that goes on from its checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch, staged


def landed(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The files of a folder as a stream."""
    return spark.readStream.schema(schema).format("parquet").load(folder)


def advance(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Processes what has landed since the last time, once, and ends. The file sink's log and the checkpoint make a run that is tried again write nothing twice."""
    written = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", out)
    written.trigger(availableNow=True).start().awaitTermination()


def fed(rows: DataFrame, batch: str, build: Callable[[DataFrame], DataFrame], name: str, mode: str = "append") -> DataFrame:
    """What ``build`` makes of the rows as a stream, landing in the order of the whole numbers in ``batch`` (a few of them)."""
    spark = rows.sparkSession
    rows, root = staged(rows, f"{name}_rows"), scratch(spark, name)
    plain = rows.drop(batch)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    plain.limit(0).write.parquet(f"{root}/in")
    stream = build(landed(spark, f"{root}/in", schema))
    for (n,) in rows.select(batch).distinct().orderBy(batch).collect():
        rows.filter(F.col(batch) == n).drop(batch).write.mode("append").parquet(f"{root}/in")
        advance(stream, f"{root}/out", f"{root}/checkpoint", mode)
    return spark.read.schema(stream.schema).parquet(f"{root}/out")
