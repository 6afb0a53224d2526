"""Grants rolled up: grouping sets, sketches that merge, frames over years and runs of giving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Registers of a count sketch (a power of two): its relative error is about 1.04 / sqrt(2 ** LG_REGISTERS); size of a quantile sketch.
LG_REGISTERS, QUANTILE_K = 12, 400


def size_class(amount: Column) -> Column:
    """small, middle, large."""
    return F.when(amount < 20000, "small").when(amount < 60000, "middle").otherwise("large")


def totals(grants: DataFrame, by: list[str], sets: str = "cube") -> DataFrame:
    """by, level, grants, amount of all subsets of ``by`` (cube) or its beginnings (rollup).

    The bits of level say which columns a row sums over, so that a group of null is told from a sum.
    """
    grouped = grants.cube(*by) if sets == "cube" else grants.rollup(*by)
    return grouped.agg(F.grouping_id().alias("level"), F.count("*").alias("grants"), F.sum("amount").alias("amount"))


def chosen_totals(grants: DataFrame, by: list[str], sets: list[list[str]]) -> DataFrame:
    """The same of the given sets of columns only."""
    return grants.groupingSets([[F.col(c) for c in s] for s in sets], *by).agg(F.grouping_id().alias("level"), F.count("*").alias("grants"), F.sum("amount").alias("amount"))


def sketches(grants: DataFrame, by: list[str], counted: str, measured: str) -> DataFrame:
    """by, counts, quantiles: sketches of how many different values of one column there are, and of how another (whole numbers) is spread."""
    return grants.groupBy(*by).agg(F.hll_sketch_agg(counted, F.lit(LG_REGISTERS)).alias("counts"), F.kll_sketch_agg_bigint(measured, F.lit(QUANTILE_K)).alias("quantiles"))


def merged(kept: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of coarser groups from those of finer ones; the rows that they were made from are not needed."""
    return kept.groupBy(*by).agg(F.hll_union_agg("counts").alias("counts"), F.kll_merge_agg_bigint("quantiles").alias("quantiles"))


def estimates(kept: DataFrame, by: list[str], share: float = 0.5) -> DataFrame:
    """by, different, quantile as the sketches have them."""
    return kept.select(*by, F.hll_sketch_estimate("counts").alias("different"), F.kll_sketch_get_quantile_bigint("quantiles", F.lit(share)).alias("quantile"))


def by_year(grants: DataFrame) -> DataFrame:
    return grants.groupBy("ein", "tax_year").agg(F.sum("amount").alias("amount"))


def frames(years: DataFrame, back: int = 2) -> DataFrame:
    """ein, tax_year, amount, recent (of this and the ``back`` calendar years before, also where some have no row), years_recent, last_year, next_year, change (to the year that has a row before)."""
    mine = Window.partitionBy("ein").orderBy("tax_year")
    recent = mine.rangeBetween(-back, 0)
    return years.select(
        "ein", "tax_year", "amount", F.sum("amount").over(recent).alias("recent"), F.count("*").over(recent).alias("years_recent"), F.lag("tax_year").over(mine).alias("last_year"),
        F.lead("tax_year").over(mine).alias("next_year"), (F.col("amount") - F.lag("amount").over(mine)).alias("change"),
    )


def runs(years: DataFrame) -> DataFrame:
    """ein, first_year, last_year, years, amount of each unbroken run of years, and gap: years without a row before it (null before the first)."""
    mine = Window.partitionBy("ein").orderBy("tax_year")
    island = F.col("tax_year") - F.row_number().over(mine)
    found = years.withColumn("island", island).groupBy("ein", "island").agg(F.min("tax_year").alias("first_year"), F.max("tax_year").alias("last_year"), F.count("*").alias("years"), F.sum("amount").alias("amount"))
    gap = F.col("first_year") - F.lag("last_year").over(Window.partitionBy("ein").orderBy("first_year")) - 1
    return found.select("ein", "first_year", "last_year", "years", "amount", gap.alias("gap"))
