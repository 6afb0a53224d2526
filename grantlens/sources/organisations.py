"""Replies of an organisations service, one JSON text for each EIN, summed up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REPLY = "organization struct<name:string,city:string,state:string,ntee_code:string>, filings_with_data array<struct<formtype:int,tax_prd:long,totrevenue:long>>"
#: The form of private foundations.
FORM = 2


def summarise(replies: DataFrame) -> DataFrame:
    """ein, found, name, city, state, ntee_code, latest_filing, latest_revenue ('' for what is missing) of replies (ein, reply).

    The latest filing of a private foundation's form; of equal periods the first.
    """
    r = replies.select("ein", F.from_json("reply", REPLY).alias("r"))
    numbered = F.transform("r.filings_with_data", lambda f, i: F.struct(F.coalesce(f["tax_prd"], F.lit(0)).alias("period"), (-i).alias("place"), f["tax_prd"].alias("tax_prd"), f["totrevenue"].alias("revenue"), f["formtype"].alias("form")))
    best = F.array_max(F.filter(numbered, lambda f: f["form"] == FORM))
    text = lambda c: F.coalesce(F.col(f"r.organization.{c}"), F.lit(""))
    number = lambda c: F.coalesce(F.nullif(best[c], F.lit(0).cast("long")).cast("string"), F.lit(""))
    found = F.col("r.organization").isNotNull()
    return r.select(
        "ein", F.when(found, "Yes").otherwise("No").alias("found"), *(text(c).alias(c) for c in ("name", "city", "state", "ntee_code")),
        F.when(found, number("tax_prd")).otherwise("").alias("latest_filing"), F.when(found, number("revenue")).otherwise("").alias("latest_revenue"),
    )
