"""Keep-first, latest-per-key, set differences and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__place", F.row_number().over(w)).filter("__place = 1").drop("__place")


def latest(df: DataFrame, keys: list[str], *by: str) -> DataFrame:
    """The row with the greatest ``by`` of each key; give enough columns that no ties are left."""
    return keep_first(df, keys, *(F.col(c).desc() for c in by))


def covered(df: DataFrame, by: DataFrame, key: str) -> DataFrame:
    return df.join(by, key, "left_semi")


def missing(df: DataFrame, by: DataFrame, key: str) -> DataFrame:
    return df.join(by, key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old rows of their keys; columns that either lacks are null."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def update(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Columns of old overwritten where new has the key, with its nulls and '' too."""
    side = new.select(*keys, F.lit(True).alias("__hit"), *(F.col(c).alias(f"__{c}") for c in columns))
    joined = old.join(side, keys, "left")
    return joined.select(*(F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else c for c in old.columns))


def update_counts(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """updated, skipped: how many rows of new have a row of old to update."""
    there = old.select(*keys, F.lit(1).alias("__there")).distinct()
    return new.join(there, keys, "left").agg(F.count("__there").alias("updated"), F.count_if(F.col("__there").isNull()).alias("skipped"))


def not_on_disk(index: DataFrame, disk: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(wanted eins without any filing on disk, ein and missing years, sorted and joined by ';').

    index: ein, object_id, sub_date (its first four letters are the year); disk: object_id.
    """
    mine = index.join(wanted.select("ein").distinct(), "ein", "left_semi")
    marked = mine.join(disk.select("object_id", F.lit(True).alias("here")).distinct(), "object_id", "left")
    by = marked.groupBy("ein").agg(F.max("here").alias("here"), F.sort_array(F.collect_list(F.when(F.col("here").isNull(), F.substring("sub_date", 1, 4)))).alias("years"))
    none = wanted.select("ein").distinct().join(by.filter("here"), "ein", "left_anti")
    return none, by.filter(F.size("years") > 0).select("ein", F.array_join("years", ";").alias("years"))


def first_names(index: DataFrame, eins: DataFrame) -> DataFrame:
    """ein, name: the first name that the index has (by row), else UNKNOWN."""
    names = index.groupBy("ein").agg(F.min_by("name", "row").alias("name"))
    return eins.join(names, "ein", "left").select("ein", F.coalesce("name", F.lit("UNKNOWN")).alias("name"))


def any_key(left: DataFrame, right: DataFrame, keys: list, key: str, value: str) -> DataFrame:
    """left with ``value`` of right by the first of several keys (columns of left) that is found."""
    out, names = left, []
    for i, k in enumerate(keys):
        names.append(f"__v{i}")
        out = out.withColumn("__k", k).join(right.select(F.col(key).alias("__k"), F.col(value).alias(names[-1])), "__k", "left").drop("__k")
    return out.withColumn(value, F.coalesce(*names)).drop(*names)


def with_columns(df: DataFrame, defaults: dict[str, tuple[str, object]]) -> DataFrame:
    """Adds the columns that are missing: name to (type, default)."""
    return df.withColumns({n: F.lit(v).cast(t) for n, (t, v) in defaults.items() if n not in df.columns})


def fixed_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, always the same for a seed: those of the smallest MD5 of key and seed. Only n rows of each partition move."""
    return df.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))).cast("binary")), key).limit(n)
