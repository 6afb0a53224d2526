"""Joins by time: the latest earlier row of a key, and points in the intervals of a key. Both are equi-joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import staged

#: Shortest cell of time, in seconds; longer ones double.
CELL = 86400


def asof_join(left: DataFrame, right: DataFrame, key: str, time: str, right_time: str) -> DataFrame:
    """left with the columns of right's latest row of the key at or before left's time, null where there is none.

    right has one row for each key and time. Both sides lie in one order of key and time, dealt by ranges, so that a hot key takes
    several partitions; what a partition starts with is the last row of right in the partitions before it, one row for each
    of them and key. Null keys match nothing; left's rows with null times have no match and stay.
    """
    mine = left.filter(F.col(key).isNotNull() & F.col(time).isNotNull())
    rest = left.filter(F.col(key).isNull() | F.col(time).isNull())
    taken = right.filter(F.col(key).isNotNull() & F.col(right_time).isNotNull()).select(F.col(key).alias("__key"), F.col(right_time).alias("__time"), F.struct(*(c for c in right.columns if c != key)).alias("__found"))
    none = F.lit(None).cast(taken.schema["__found"].dataType)
    both = mine.select(F.col(key).alias("__key"), F.col(time).alias("__time"), none.alias("__found"), F.struct(*left.columns).alias("__row"))
    both = both.unionByName(taken.withColumn("__row", F.lit(None).cast(both.schema["__row"].dataType)))
    # at equal times the right side comes first
    order = ["__key", "__time", F.col("__found").isNull()]
    placed = staged(both.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "asof")
    placed = placed.withColumn("__part", F.shiftright("__at", 33))
    here = Window.partitionBy("__part", "__key").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    inside = placed.withColumn("__last", F.last("__found", ignorenulls=True).over(here))
    last = placed.groupBy("__part", "__key").agg(F.max_by("__found", F.when(F.col("__found").isNotNull(), F.col("__at"))).alias("__ends"))
    before = Window.partitionBy("__key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("__part", "__key", F.last("__ends", ignorenulls=True).over(before).alias("__carried"))
    found = inside.filter("__row IS NOT NULL").join(carried, ["__part", "__key"]).select("__row.*", F.coalesce("__last", "__carried").alias("__found"))
    return found.unionByName(rest.withColumn("__found", none)).select(*left.columns, *(F.col(f"__found.`{c}`").alias(c) for c in right.columns if c != key))


def interval_join(points: DataFrame, intervals: DataFrame, key: str, time: str, start: str, end: str) -> DataFrame:
    """Pairs of points and intervals of one key with start <= time <= end, all columns of both.

    An interval lies in two neighbouring cells at most of the shortest cells that are as long as it; a point looks in one cell
    of each length in use. So the rows that are shuffled grow with the input and the result, not with the intervals' length or a
    hot key's rows; which points are inside is checked exactly. Intervals that end before they start, and nulls, match nothing.
    """
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    whole = intervals.filter(F.col(start) <= F.col(end))
    level = F.greatest(F.lit(0), F.ceil(F.log2((seconds(end) - seconds(start) + 1) / CELL)).cast("int"))
    sized = whole.withColumn("__level", level)
    width = lambda: F.call_function("shiftleft", F.lit(CELL).cast("long"), F.col("__level"))
    celled = sized.withColumn("__cell", F.explode(F.array_distinct(F.array(F.floor(seconds(start) / width()), F.floor(seconds(end) / width())))))
    # so many lengths as doublings between the shortest and the longest interval
    levels = [r[0] for r in sized.select("__level").distinct().collect()]
    if not levels:
        levels = [0]
    looking = points.withColumn("__level", F.explode(F.array(*map(F.lit, levels)))).withColumn("__cell", F.floor(seconds(time) / width()))
    met = looking.join(celled, [key, "__level", "__cell"])
    return met.filter((F.col(start) <= F.col(time)) & (F.col(time) <= F.col(end))).drop("__level", "__cell")
