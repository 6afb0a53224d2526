"""Incremental refresh: newly landed filings replace those of their EIN and year."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sinks.tables import replace_children
from ..sources.filings import foundations, shred
from ..sources.scratch import staged

FILES = "path string, modificationTime timestamp, length long, content binary"


def refresh(spark: SparkSession, landing: str, target: str, checkpoint: str) -> StreamingQuery:
    """A file stream over XML files. Each batch writes the tax years that it touches anew, with its filings in
    place of earlier ones of their EIN and year; a batch that is tried again gives the same table. An extension of the batch job.
    """
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.xml").load(landing)

    def put(batch: DataFrame, _: int) -> None:
        replace_children(staged(foundations(shred(batch)), "filings"), target, ["ein", "tax_year"], "tax_year")

    return files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
