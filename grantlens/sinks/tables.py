"""Sinks: CSV in two dialects, lists, derived columns, replaced children and the tag cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CSV = {"header": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "emptyValue": ""}


def write_quoted(df: DataFrame, path: str) -> None:
    """CSV with every value in quotes; null is an empty one."""
    df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns)).write.mode("overwrite").options(**_CSV | {"quoteAll": "true"}).csv(path)


def write_plain(df: DataFrame, path: str) -> None:
    """CSV with quotes only where a value needs them."""
    df.write.mode("overwrite").options(**_CSV).csv(path)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """One value a line, sorted: the files in order of name hold the lines in order."""
    df.select(F.col(column).cast("string").alias("value")).orderBy("value").write.mode("overwrite").text(path)


def with_field(lines: DataFrame, field: Column) -> DataFrame:
    """line with one more field: the row as it came, a comma and the quoted field ('' for null)."""
    quoted = F.coalesce(field, F.lit(""))
    shown = F.when(quoted.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(quoted, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(quoted)
    return lines.withColumn("line", F.concat_ws(",", "line", shown))


def replace_children(new: DataFrame, path: str, keys: list[str], partition: str) -> None:
    """New rows take the place of all rows of their keys; only the partitions they touch are written again.

    ``keys`` hold the partition column. What a touched partition holds of other keys is kept.
    """
    spark = new.sparkSession
    try:
        old = spark.read.parquet(path)
    except Exception as e:  # nothing was written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        new.write.partitionBy(partition).parquet(path)
        return
    touched = new.select(partition).distinct()
    kept = old.join(touched, partition, "left_semi").join(new.select(*keys).distinct(), keys, "left_anti")
    both = staged_union(kept, new)
    both.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def staged_union(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both, written aside first, since the target can't be read while it is overwritten."""
    from ..sources.scratch import staged

    return staged(old.unionByName(new, allowMissingColumns=True), "children")


def write_cache(new: DataFrame, path: str, key: str = "display_name") -> None:
    """A cache of tags by name, written anew as a whole: new entries go before old ones."""
    spark = new.sparkSession
    try:
        old = spark.read.parquet(path).join(new.select(key), key, "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = new.limit(0)
    staged_union(old, new).write.mode("overwrite").parquet(path)


def read_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The cache, or an empty one where none was written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
