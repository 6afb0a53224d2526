"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node that links (a, b) lead to, for all nodes that have links.

    Rounds of smallest neighbouring label with pointer jumping, each staged in the shared folder,
    until nothing changes; a node with many links is summed up before the shuffle.
    """
    both = staged(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = staged(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root")).select(F.col("a").alias("node"), "root"), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("further"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").join(jump, "root", "left")
        moved = staged(step.select("node", F.col("root").alias("old"), F.least("root", "near", F.coalesce("further", "root")).alias("root")), "moved")
        if moved.filter("old <> root").isEmpty():
            return moved.select("node", "root")
        labels = moved.select("node", "root")
