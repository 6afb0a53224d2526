"""Counts that a run reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def class_split(universe: DataFrame) -> DataFrame:
    """How many codes begin with T, begin otherwise, or are blank."""
    code = F.coalesce("ntee", F.lit(""))
    is_t = code.startswith("T")
    return universe.agg(F.count_if(is_t).alias("t"), F.count_if((code != "") & ~is_t).alias("other"), F.count_if(code == "").alias("blank"))


def export_counts(export: DataFrame) -> DataFrame:
    """Rows with a filing, accepting applications, by invitation only."""
    return export.agg(
        F.count("*").alias("n"), F.count_if("data_found").alias("data_found"), F.count_if(F.col("application_status") == "Accepting Applications").alias("accepting"),
        F.count_if(F.col("application_status") == "Invite Only").alias("invite_only"),
    )


def run_summary(scored: DataFrame) -> DataFrame:
    """Aligned rows with their mean (0 without any), and the scores' largest and mean values."""
    aligned = F.col("alignment_score") > 0
    return scored.agg(
        F.count_if(aligned).alias("aligned"), F.coalesce(F.avg(F.when(aligned, F.col("alignment_score"))), F.lit(0.0)).alias("mean_alignment"), F.max("alignment_score").alias("max_alignment"),
        F.avg("opportunity_score").alias("mean_opportunity"), F.max("opportunity_score").alias("max_opportunity"), F.count_if("data_found").alias("data_found"),
    )
