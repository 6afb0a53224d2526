"""A second reading of the filings, by patterns instead of a parser, and what differs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import invite_text, number_or_null, object_id, phone, utf8_text, website, zero_padded
from ..operators.relational import any_key, latest

FIELDS = ["website", "phone", "revenue", "invite_only", "contact_person"]


def _open(name: str) -> str:
    return rf"<(?:\w+:)?{name}>"


def _close(name: str) -> str:
    return rf"</(?:\w+:)?{name}>"


def _value(text: Column, name: str, value: str = "[^<]*", inside: str | None = None) -> Column:
    """The first element's text, trimmed, '' if there is none; ``inside``: the first one behind that element's start."""
    before = f"{_open(inside)}.*?" if inside else ""
    return F.trim(F.regexp_extract(text, f"(?s){before}{_open(name)}({value})</", 1))


# Blocks that a filer's phone is looked for in, and those that it is not.
PHONE_BLOCKS = ["Filer", "BusinessOfficerGrp"]
PREPARER_BLOCKS = "Preparer(?:Person|Firm)Grp"
# End of fixed values.


def _phone(text: Column) -> Column:
    """In the filer's block, else the first officer's, else the first outside preparers' blocks."""
    filer, officer = (F.regexp_extract(text, f"(?s){_open(b)}.*?{_close(b)}", 0) for b in PHONE_BLOCKS)
    others = F.regexp_replace(text, f"(?s){_open(PREPARER_BLOCKS)}.*?{_close(PREPARER_BLOCKS)}", "")
    there = _open("PhoneNum") + "[^<]*</"
    return F.when(filer.rlike(there), _value(filer, "PhoneNum")).when(officer.rlike(there), _value(officer, "PhoneNum")).otherwise(_value(others, "PhoneNum"))


def with_profile(files: DataFrame) -> DataFrame:
    """files (path, content) with what the patterns read in ``second``."""
    t = F.col("text")
    revenue = _value(t, "TotalRevAndExpnssAmt")
    second = F.struct(
        _value(t, "EIN", r"\d{9}", "Filer").alias("ein"), _value(t, "TaxYr", r"\d{4}").alias("year"), website(_value(t, "WebsiteAddressTxt")).alias("website"), phone(_phone(t)).alias("phone"),
        number_or_null(revenue).alias("revenue"), (F.upper(_value(t, "OnlyContriToPreselectedInd")) == "X").cast("int").alias("invite_only"),
        _value(t, "RecipientPersonNm", inside="ApplicationSubmissionInfoGrp").alias("contact_person"),
    )
    return files.withColumn("text", utf8_text(F.col("content"))).select("path", "content", second.alias("second"))


def profile_of(read: DataFrame) -> DataFrame:
    """``second_profile`` of files whose object_id and ``second`` are there."""
    found = read.select("object_id", "second.*").filter("ein <> '' AND year <> ''")
    return found.select("object_id", "ein", F.col("year").cast("int").alias("tax_year"), *FIELDS)


def second_profile(files: DataFrame) -> DataFrame:
    """object_id, ein, tax_year and FIELDS of files (path, content) with a nine-digit EIN of the filer and a four-digit year."""
    return profile_of(with_profile(files).select(object_id(F.col("path")).alias("object_id"), "second"))


def second_flags(files: DataFrame) -> DataFrame:
    """ein (the first of nine digits anywhere), tax_year (0 if there is none), invite_only, path."""
    t = F.col("text")
    read = files.select("path", utf8_text(F.col("content")).alias("text"))
    year = F.coalesce(_value(t, "TaxYr", r"\s*\d{4}\s*").try_cast("int"), F.lit(0))
    return read.select(_value(t, "EIN", r"\s*\d{9}\s*").alias("ein"), year.alias("tax_year"), (F.upper(_value(t, "OnlyContriToPreselectedInd")) == "X").alias("invite_only"), "path").filter("ein <> ''")


def latest_flags(files: DataFrame) -> DataFrame:
    """The flag of each EIN's latest year; of equal years the greatest path."""
    return latest(second_flags(files), ["ein"], "tax_year", "path")


def field_diff(sample: DataFrame, table: DataFrame, keys: list[str] = ["ein", "tax_year"], fields: list[str] = FIELDS) -> DataFrame:  # noqa: B006
    """keys, status (matched, mismatched, missing) and the names of the fields that differ; null equals null."""
    side = table.select(*keys, F.lit(True).alias("__there"), *(F.col(f).alias(f"__{f}") for f in fields))
    differ = F.filter(F.array(*(F.when(~F.col(f).eqNullSafe(F.col(f"__{f}")), F.lit(f)) for f in fields)), lambda x: x.isNotNull())
    status = F.when(F.col("__there").isNull(), "missing").when(F.size(differ) > 0, "mismatched").otherwise("matched")
    return sample.join(side, keys, "left").select(*keys, status.alias("status"), F.when(F.col("__there"), F.array_join(differ, ";")).otherwise("").alias("fields"))


def flag_diff(rows: DataFrame, flags: DataFrame) -> DataFrame:
    """ein, status of rows (ein, flag) with a known flag, looked up by the EIN as it is or padded in flags (ein, invite_only)."""
    known = rows.filter(F.col("flag").isin("Invite Only", "Not Invite Only"))
    found = any_key(known, flags, [F.trim("ein"), zero_padded(F.trim("ein"))], "ein", "invite_only")
    status = F.when(F.col("invite_only").isNull(), "missing").when(invite_text(F.col("invite_only")) == F.col("flag"), "matched").otherwise("mismatched")
    return found.select("ein", status.alias("status"))


def diff_counts(diff: DataFrame) -> DataFrame:
    return diff.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("matched", "mismatched", "missing")))
