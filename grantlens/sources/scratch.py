"""A folder for intermediate files that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _own() -> str:
    return tempfile.mkdtemp(prefix="grantlens-")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; Spark in one process may go without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _own()
    return f"{root}/grantlens/{uuid.uuid4().hex}/{name}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written once and read again: what follows several times from it does not compute it again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
