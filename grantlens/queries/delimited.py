"""CSV, line lists, links and archives: written to scratch and read again, so that sources and sinks meet."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import invite_text, zero_padded
from ..operators.relational import any_key, first_names, keep_first, missing, not_on_disk
from ..plans import counters
from ..sinks import tables
from ..sources import delimited as D
from ..sources import testbed as T
from ..sources.scratch import scratch
from .catalog import query
from .core import EIN

_CODE = "CASE c_custkey % 6 WHEN 0 THEN '02' WHEN 1 THEN '3' WHEN 2 THEN '4.0' WHEN 3 THEN '15' WHEN 4 THEN 'x' END"
_NTEE = "CASE WHEN c_custkey % 4 = 0 THEN 'T20' WHEN c_custkey % 4 = 1 THEN '' ELSE c_mktsegment END"
_ORGS = f"""o AS (SELECT CAST(c_custkey AS VARCHAR) AS EIN, c_name AS NAME, {_CODE} AS FOUNDATION,
    CASE WHEN c_custkey % 5 = 0 THEN '1' WHEN c_custkey % 5 = 1 THEN '01.0' ELSE '0' END AS PF_FILING_REQ_CD, {_NTEE} AS NTEE_CD, c_custkey
  FROM customer)"""
_PRIVATE = f"""{_ORGS}, p AS (SELECT lpad(EIN, 9, '0') AS ein, NAME AS name, FOUNDATION AS foundation, NTEE_CD AS ntee
  FROM o
  WHERE coalesce(TRY_CAST(FOUNDATION AS DOUBLE) IN (2, 3, 4), false) OR coalesce(TRY_CAST(PF_FILING_REQ_CD AS DOUBLE) = 1, false))"""


def _organisations(spark, sf_dir):
    """Two CSV files with more columns than are wanted; some organisations are in both."""
    k = F.col("c_custkey")
    code = F.expr(_CODE)
    ntee = F.expr(_NTEE)
    required = F.when(k % 5 == 0, "1").when(k % 5 == 1, "01.0").otherwise("0")
    orgs = T.table(spark, sf_dir, "customer").select(
        k.cast("string").alias("EIN"), F.col("c_name").alias("NAME"), F.lit('a "quoted", field\nof two lines').alias("IGNORED"), code.alias("FOUNDATION"), required.alias("PF_FILING_REQ_CD"), ntee.alias("NTEE_CD")
    )
    paths = [scratch(spark, f"region_{i}") for i in (1, 2)]
    tables.write_plain(orgs, paths[0])
    tables.write_quoted(orgs.filter(F.col("EIN").cast("long") % 3 == 0).withColumn("NAME", F.lit("later")), paths[1])
    return paths


def _private(spark, sf_dir):
    rows = D.scan_all(spark, _organisations(spark, sf_dir), ["EIN", "NAME", "FOUNDATION", "PF_FILING_REQ_CD", "NTEE_CD"])
    private = rows.filter(D.is_private_foundation(F.col("FOUNDATION"), F.col("PF_FILING_REQ_CD"))).withColumn("EIN", zero_padded(F.col("EIN")))
    once = keep_first(private, ["EIN"], F.col("file_no"), F.col("row_no"))
    return once.select(F.col("EIN").alias("ein"), F.col("NAME").alias("name"), F.col("FOUNDATION").alias("foundation"), F.coalesce("NTEE_CD", F.lit("")).alias("ntee"))


@query(f"WITH {_PRIVATE} SELECT * FROM p")
def private_foundations(spark, sf_dir):
    """Scan of several files, filter, padded ids, first of each."""
    return _private(spark, sf_dir)


@query(f"WITH {_PRIVATE} SELECT foundation, count(*) AS n FROM p GROUP BY 1")
def foundation_codes(spark, sf_dir):
    return _private(spark, sf_dir).groupBy("foundation").agg(F.count("*").alias("n"))


@query(f"""WITH {_PRIVATE} SELECT count(*) FILTER (WHERE ntee LIKE 'T%') AS t,
    count(*) FILTER (WHERE ntee <> '' AND ntee NOT LIKE 'T%') AS other,
    count(*) FILTER (WHERE ntee = '') AS blank
  FROM p""")
def class_split(spark, sf_dir):
    return counters.class_split(_private(spark, sf_dir))


@query("""SELECT c_custkey::VARCHAR AS id,
    CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_name || ', \"' || c_mktsegment || '\"' END AS name,
    CASE WHEN c_custkey % 2 = 0 THEN '' ELSE ' x ' END AS note
  FROM customer""")
def quoted_csv(spark, sf_dir):
    """Every value in quotes, nulls as empty ones; read with '' for what is missing."""
    k = F.col("c_custkey")
    name = F.when(k % 7 != 0, F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"')))
    path = scratch(spark, "quoted")
    tables.write_quoted(T.table(spark, sf_dir, "customer").select(k.alias("id"), name.alias("name"), F.when(k % 2 != 0, " x ").alias("note")), path)
    return D.scan_filled(spark, path)


@query("SELECT p_partkey::VARCHAR AS ein, p_name AS foundation_name, p_brand AS city FROM part")
def renamed_csv(spark, sf_dir):
    """Headers replaced by place."""
    path = scratch(spark, "plain")
    tables.write_plain(T.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), path)
    return D.scan(spark, path, ["ein", "foundation_name", "city"])


@query(f"""SELECT {EIN.format('o_custkey', 'o_custkey')} AS ein, o_orderkey::VARCHAR AS object_id, CAST(year(o_orderdate) AS INT) AS index_year, '990PF' AS return_type
  FROM orders
  WHERE o_orderkey % 3 = 0 AND year(o_orderdate) IN (1996, 1997)
  QUALIFY row_number() OVER (PARTITION BY o_orderkey) = 1""")
def index_scan(spark, sf_dir):
    """Index files of several years, one of them empty: a return type, padded ids, the first of each object."""
    index = T.index(spark, sf_dir).withColumn("RETURN_TYPE", F.when(F.col("row") % 3 == 0, "990PF").otherwise("990"))
    paths = {}
    for year in (1996, 1997, 2150):
        paths[year] = scratch(spark, f"index_{year}")
        tables.write_plain(index.filter(F.substring("sub_date", 1, 4) == str(year)).select(F.col("ein").alias("EIN"), F.col("object_id").alias("OBJECT_ID"), "RETURN_TYPE"), paths[year])
    rows = D.scan_index(spark, paths, ["EIN", "OBJECT_ID", "RETURN_TYPE"], line_feeds=False).filter("RETURN_TYPE = '990PF'")
    once = keep_first(rows, ["OBJECT_ID"], F.col("index_year"))
    return once.select(zero_padded(F.col("EIN")).alias("ein"), F.col("OBJECT_ID").alias("object_id"), "index_year", F.col("RETURN_TYPE").alias("return_type"))


_FLAG = "CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'Invite Only' ELSE 'Not Invite Only' END"


@query(f"""SELECT CASE WHEN c_custkey % 9 = 0 THEN 'short,' || c_custkey || ',' ELSE 'a,\"b,b\",,,,,,,' || c_custkey || ',' || c_mktsegment || ',' || coalesce({_FLAG}, '') END AS line
  FROM customer""")
def appended_flags(spark, sf_dir):
    """Rows of any length keep what they hold and get one more field, looked up by the ninth in two ways."""
    k = F.col("c_custkey").cast("string")
    c = T.table(spark, sf_dir, "customer")
    path = scratch(spark, "rows")
    rows = F.when(F.col("c_custkey") % 9 == 0, F.concat(F.lit("short,"), k)).otherwise(F.concat(F.lit('a,"b,b",,,,,,,'), k, F.lit(","), "c_mktsegment"))
    c.select(rows.alias("value")).write.text(path)
    flags = c.filter("c_custkey % 4 <> 0").select(zero_padded(k).alias("key"), (F.col("c_custkey") % 2 == 0).alias("invite"))
    found = any_key(D.scan_place(spark, path, 8), flags, [zero_padded(F.col("value")), F.col("value")], "key", "invite")
    return tables.with_field(found, invite_text(F.col("invite"))).select("line")


@query(f"""WITH f AS (SELECT DISTINCT o_custkey
  FROM orders
  WHERE year(o_orderdate) = 1996) SELECT {EIN.format('c_custkey', 'c_custkey')} AS value
  FROM customer
  WHERE c_custkey NOT IN (SELECT o_custkey
  FROM f)""")
def missing_list(spark, sf_dir):
    """Entities without a filing of a year, as a sorted list of lines, read back."""
    path = scratch(spark, "missing")
    found = missing(T.universe(spark, sf_dir).select("ein"), T.filings(spark, sf_dir).filter("tax_year = 1996"), "ein")
    tables.write_lines(found, "ein", path)
    return D.scan_lines(spark, path)


_HTML = """'<a href=\"/xml/1996/f' || c_custkey || '.zip\">x</a> <a href=\"https://h.org/xml/1996/g' || c_custkey % 3 || '.zip\"> \"https://h.org/xml/1996/Index.zip\" <a HREF=\"/xml/1996/my_INDEX_' || c_custkey || '.csv\"> <a href=\"/xml/1997/n.zip\">'"""


@query("SELECT c_custkey, unnest(['https://h.org/xml/1996/g' || c_custkey % 3 || '.zip', 'https://h.org/xml/1996/f' || c_custkey || '.zip']) AS link FROM customer")
def archive_links(spark, sf_dir):
    c = T.table(spark, sf_dir, "customer")
    return c.select("c_custkey", F.explode(D.archive_links(F.expr(_HTML), F.lit("https://h.org"), 1996)).alias("link"))


@query("SELECT c_custkey, 'https://h.org/xml/1996/my_INDEX_' || c_custkey || '.csv' AS link FROM customer")
def index_links(spark, sf_dir):
    c = T.table(spark, sf_dir, "customer")
    return c.select("c_custkey", F.explode(D.index_links(F.expr(_HTML), F.lit("https://h.org"), 1996)).alias("link"))


@query("""SELECT y::INT AS year, 'https://h.org/' || y || '_TEOS_XML_' || lpad(m::VARCHAR, 2, '0') || 'A.zip' AS url, count(o_orderkey) AS filings
  FROM range(1992, 2000) t(y) CROSS JOIN range(1, 13) u(m) LEFT JOIN orders ON year(o_orderdate) = y AND month(o_orderdate) = m
  GROUP BY 1, 2""")
def archive_names(spark, sf_dir):
    """The archives of eight years by name, and how many filings the index puts into each."""
    base = "https://h.org/"
    return D.indexed_archives(D.archive_names(spark, base, list(range(1992, 2000))), T.index(spark, sf_dir), base)


_DISK = "i AS (SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y') AS y, o_orderkey % 4 = 0 AS here FROM orders WHERE o_custkey % 2 = 0)"


def _disk(spark, sf_dir):
    wanted = T.table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("ein"))
    index = T.index(spark, sf_dir)
    return not_on_disk(index, index.filter("row % 4 = 0").select("object_id"), wanted)


@query(f"WITH {_DISK} SELECT CAST(c_custkey AS VARCHAR) AS ein FROM customer WHERE c_custkey % 2 = 0 AND c_custkey NOT IN (SELECT o_custkey FROM i WHERE here)")
def entities_without_files(spark, sf_dir):
    return _disk(spark, sf_dir)[0]


@query(f"WITH {_DISK} SELECT CAST(o_custkey AS VARCHAR) AS ein, string_agg(y, ';' ORDER BY y) AS years FROM i WHERE NOT here GROUP BY 1")
def missing_years(spark, sf_dir):
    return _disk(spark, sf_dir)[1]


@query("SELECT CAST(c_custkey AS VARCHAR) AS ein, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN c_name ELSE 'UNKNOWN' END AS name FROM customer")
def report_names(spark, sf_dir):
    """The first name of the index, else UNKNOWN."""
    return first_names(T.index(spark, sf_dir), T.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("ein")))
