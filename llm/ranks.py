"""Places of rows in a total order, without one task that sees all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged


def ranked(rows: DataFrame, group: list[str], order: list[str], name: str = "ranked") -> DataFrame:
    """Adds place (from 0 in each group, in the order of ``order``, nulls first) and group_rows (rows of the group).

    The last column of ``order`` tells all rows apart. Rows are dealt by ranges of group and order and sorted in their
    partitions, so that a hot group takes as many partitions as it needs; what goes before a partition is
    summed over one row for each partition and group. An empty table stays empty.
    """
    keys = [F.col(c).asc_nulls_first() for c in group + order]
    at = F.monotonically_increasing_id()
    dealt = staged(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", at), name)
    # the upper bits of such an id number the partition, the lower 33 the row in it
    dealt = dealt.withColumn("__part", F.shiftright("__at", 33))
    heads = dealt.groupBy(*group, "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    mine = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = F.sum("__n").over(mine.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    heads = heads.select(
        *(F.col(c).alias(f"__{c}") for c in group), F.col("__part").alias("__of"), (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__shift"), F.sum("__n").over(mine).alias("group_rows")
    )
    here = F.col("__part") == F.col("__of")
    for c in group:
        here &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    return dealt.join(heads, here).withColumn("place", F.col("__at") + F.col("__shift")).select(*rows.columns, "place", "group_rows")
