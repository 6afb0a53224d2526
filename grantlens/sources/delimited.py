"""CSV files, line lists and links in HTML. All values are read as text; nothing is inferred."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Quotes inside a field are doubled.
DIALECT = {"header": "true", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}

# Which organisations are private foundations, and the archives of a year.
FOUNDATION_CODES = [2.0, 3.0, 4.0]
ARCHIVE_YEARS, ARCHIVE_NAME = [2023, 2024], "{year}_TEOS_XML_{month}A.zip"
# End of fixed values.


def scan(spark: SparkSession, path: str, names: list[str] | None = None, line_feeds: bool = True) -> DataFrame:
    """One file, or a folder of files of one header, as text columns; ``names`` replace the header's by place.

    Fields may hold line feeds, for which a file must be read by one task; without ``line_feeds`` large files are split over tasks.
    """
    df = spark.read.options(**DIALECT, multiLine=line_feeds).csv(path)
    return df.toDF(*names) if names else df


def scan_filled(spark: SparkSession, path: str, line_feeds: bool = True) -> DataFrame:
    """As ``scan``, with '' for what is missing."""
    return scan(spark, path, line_feeds=line_feeds).na.fill("")


def scan_all(spark: SparkSession, paths: list[str], columns: list[str], line_feeds: bool = True) -> DataFrame:
    """The columns of several files, one after another; file_no and row_no give each row's place.

    Only these columns are parsed: Spark prunes the others in the scan. Without ``line_feeds`` in fields large lists are split over tasks.
    """
    parts = [scan(spark, p, line_feeds=line_feeds).select(*columns, F.lit(i).alias("file_no"), F.monotonically_increasing_id().alias("row_no")) for i, p in enumerate(paths)]
    return reduce(DataFrame.unionByName, parts)


def scan_index(spark: SparkSession, paths: dict[int, str], columns: list[str], line_feeds: bool = True) -> DataFrame:
    """Yearly index files with their index_year; a file that holds nothing adds no rows, a missing column is null.

    Without ``line_feeds`` in fields large files are split over tasks.
    """
    empty = spark.createDataFrame([], ", ".join(f"{c} string" for c in columns) + ", index_year int")
    parts = []
    for year, path in paths.items():
        df = scan(spark, path, line_feeds=line_feeds)
        parts.append(df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns), F.lit(year).alias("index_year")))
    return reduce(DataFrame.unionByName, parts, empty)


def scan_place(spark: SparkSession, path: str, place: int) -> DataFrame:
    """line and value: the field at ``place`` (from 0) of each line, null in shorter lines, which stay."""
    schema = ", ".join(f"c{i} string" for i in range(place + 1))
    lines = spark.read.text(path).select(F.col("value").alias("line"))
    fields = F.from_csv("line", F.lit(schema), {"mode": "PERMISSIVE", "escape": '"'})
    return lines.select("line", F.trim(fields[f"c{place}"]).alias("value"))


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """The distinct non-empty lines of a list, trimmed."""
    return spark.read.text(path).select(F.trim("value").alias("value")).filter("value <> ''").distinct()


def is_private_foundation(foundation: Column, filing: Column) -> Column:
    """Codes 2 to 4, or a filing requirement of 1, however they are written ('02', '2.0'); false for what is no number."""
    code, required = foundation.try_cast("double"), filing.try_cast("double")
    return F.coalesce(code.isin(FOUNDATION_CODES), F.lit(False)) | F.coalesce(required == 1, F.lit(False))


def _absolute(links: Column, host: Column) -> Column:
    return F.transform(links, lambda s: F.when(s.startswith("http"), s).otherwise(F.concat(host, s)))


def archive_links(html: Column, host: Column, year: int) -> Column:
    """Links to zip archives of a year but for index files: absolute ones between quotes, then other href values, relative ones too."""
    quoted = F.filter(F.split(html, '"'), lambda s: s.contains(f"/{year}/") & s.endswith(".zip") & s.startswith("http"))
    hrefs = F.regexp_extract_all(html, F.lit(rf'href="([^"]*/{year}/[^"]*\.zip)"'), F.lit(1))
    found = F.concat(quoted, F.array_except(_absolute(hrefs, host), quoted))
    return F.filter(found, lambda s: ~F.lower(s).contains("index"))


def index_links(html: Column, host: Column, year: int) -> Column:
    """Links to index files of a year, in any case, each once."""
    return F.array_distinct(_absolute(F.regexp_extract_all(html, F.lit(rf'(?i)href="([^"]*/{year}/[^"]*index[^"]*\.csv)"'), F.lit(1)), host))


def archive_name(base: str, year: Column, month: Column) -> Column:
    """The archive of a month; ``month`` is a number."""
    named = F.replace(F.lit(base + ARCHIVE_NAME), F.lit("{year}"), year.cast("string"))
    return F.replace(named, F.lit("{month}"), F.lpad(month.cast("string"), 2, "0"))


def archive_names(spark: SparkSession, base: str, years: list[int] = ARCHIVE_YEARS) -> DataFrame:
    """year, url: one archive for each month."""
    months = spark.createDataFrame([(y,) for y in years], "year int").withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    return months.select("year", archive_name(base, F.col("year"), F.col("month")).alias("url"))


def indexed_archives(names: DataFrame, index: DataFrame, base: str) -> DataFrame:
    """names (year, url) with the filings that an index (sub_date) puts into each archive: 0 where it has none."""
    day = F.to_date("sub_date")
    held = index.groupBy(archive_name(base, F.year(day), F.month(day)).alias("url")).agg(F.count("*").alias("filings"))
    return names.join(held, "url", "left").select("year", "url", F.coalesce("filings", F.lit(0).cast("long")).alias("filings"))
