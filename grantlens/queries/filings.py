"""XML filings made from the star schema, shredded by the parser and read again by patterns."""

from __future__ import annotations

import itertools
import uuid
import zipfile

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import functions as F

from ..functions.text import invite_text, object_id
from ..operators.relational import update, update_counts, with_columns
from ..plans import verification as V
from ..sinks.tables import replace_children
from ..sources import archives as A
from ..sources import filings as X
from ..sources import testbed as T
from ..sources.scratch import scratch, staged
from .catalog import query
from .core import EIN, FILINGS, GRANTS

_K = "CAST(ein AS BIGINT)"
_NUMBER = f"'(555) 123-' || lpad(CAST({_K} % 10000 AS VARCHAR), 4, '0')"
_PHONE = f"CASE {_K} % 3 WHEN 0 THEN {_NUMBER} WHEN 1 THEN '12' ELSE '' END"
_SITE = f"CASE WHEN {_K} % 5 = 0 THEN '' ELSE 'www.' || {_K} || '.org' END"
_REVENUE = f"CASE WHEN {_K} % 2 = 0 AND {_K} % 10 <> 4 THEN assets * 2 END"
_ODD = lambda v: f"CASE WHEN {_K} % 2 = 1 THEN {v} ELSE '' END"
_ADDRESS = _ODD(f"{_K} || ' Main St, ' || ntee || CASE WHEN {_K} % 4 = 1 THEN ', 00501' ELSE ', CA' END")
_ALL = f"""{FILINGS}, u AS (SELECT f.*, c_name AS name, c_mktsegment AS ntee, n_name AS home
  FROM f JOIN customer ON CAST(f.ein AS BIGINT) = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
_PROFILE = f"""{_SITE} AS website, {_PHONE} AS phone, {_REVENUE} AS revenue, CAST({_K} % 3 = 0 AS INT) AS invite_only, CAST({_K} % 2 AS INT) AS has_application_info, {_ODD(f"'Person ' || {_K}")} AS contact_person,
  {_ADDRESS} AS contact_address, {_ODD(_NUMBER)} AS contact_phone, {_ODD("'a@example.org'")} AS contact_email, '' AS application_format, {_ODD("'NONE'")} AS deadlines, '' AS restrictions"""


def _shredded(spark, sf_dir, *columns):
    """The columns that are asked for; all if none are."""
    return X.shred(T.filings_xml(spark, sf_dir), list(columns))


@query(f"""WITH {_ALL}, n AS (SELECT {EIN.format('o_custkey', 'o_custkey')} AS ein, year(o_orderdate) AS y, count(*) AS lines FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)
SELECT u.ein, tax_year, name AS organization_name, ntee AS city, home AS state, 'US' AS country,
    CASE WHEN {_K.replace('ein', 'u.ein')} % 4 = 0 THEN assets + 5 ELSE assets END AS assets, n_orders * 10 AS distributions,
  CAST(coalesce(lines, 0) > 0 AS INT) AS has_grants, {_PROFILE.replace('CAST(ein', 'CAST(u.ein')} FROM u LEFT JOIN n ON u.ein = n.ein AND tax_year = y""")
def xml_foundations(spark, sf_dir):
    return X.foundations(_shredded(spark, sf_dir, *X.FOUNDATION))


@query(f"""WITH {GRANTS} SELECT ein, tax_year,
    CASE WHEN id % 3 = 0 THEN 'future' ELSE 'paid' END AS grant_kind, grantee_name,
    CASE WHEN is_foreign = 1 THEN '' ELSE state END AS state,
    CASE WHEN is_foreign = 1 THEN country ELSE 'US' END AS country, is_foreign, amount, purpose
  FROM g""")
def xml_grants(spark, sf_dir):
    return X.grants(_shredded(spark, sf_dir, "object_id", "ein", "year", "grants")).select("ein", "tax_year", "grant_kind", "grantee_name", "state", "country", "is_foreign", "amount", "purpose")


@query(f"""WITH {_ALL} SELECT ein, tax_year, 0 AS id, 'Supports ' || ntee AS description, CAST(0 AS BIGINT) AS expenses
  FROM u
  UNION ALL SELECT ein, tax_year, 1, 'Program', n_orders
  FROM u""")
def xml_activities(spark, sf_dir):
    return X.activities(_shredded(spark, sf_dir, "object_id", "ein", "year", "activities"))


@query(f"WITH {_ALL} SELECT ein, tax_year, {_PROFILE} FROM u")
def xml_backfill(spark, sf_dir):
    return X.backfill(_shredded(spark, sf_dir, *X.FOUNDATION))


@query(f"WITH {_ALL} SELECT ein, max(tax_year) AS tax_year, {_K} % 3 = 0 AS invite_only FROM u GROUP BY ein")
def xml_invite_flags(spark, sf_dir):
    return X.invite_flags(_shredded(spark, sf_dir, "object_id", "ein", "year", "invite"))


@query(f"""WITH {_ALL} SELECT ein || '_' || tax_year AS object_id, ein, tax_year, {_SITE} AS website, {_PHONE} AS phone, {_REVENUE} AS revenue, CAST({_K} % 3 = 0 AS INT) AS invite_only, {_ODD(f"'Person ' || {_K}")} AS contact_person
  FROM u""")
def pattern_profile(spark, sf_dir):
    return V.second_profile(T.filings_xml(spark, sf_dir))


@query(f"WITH {_ALL} SELECT ein, tax_year, {_K} % 3 = 0 AS invite_only, '/raw/' || ein || '_' || tax_year || '_public.xml' AS path FROM u")
def pattern_flags(spark, sf_dir):
    return V.second_flags(T.filings_xml(spark, sf_dir))


@query(f"WITH {_ALL} SELECT ein, max(tax_year) AS tax_year, {_K} % 3 = 0 AS invite_only, '/raw/' || ein || '_' || max(tax_year) || '_public.xml' AS path FROM u GROUP BY ein")
def latest_pattern_flags(spark, sf_dir):
    return V.latest_flags(T.filings_xml(spark, sf_dir))


@query(f"""WITH {_ALL} SELECT count(*) FILTER (WHERE tax_year % 5 <> 0 AND {_K} % 7 <> 0) AS matched,
    count(*) FILTER (WHERE tax_year % 5 <> 0 AND {_K} % 7 = 0) AS mismatched,
    count(*) FILTER (WHERE tax_year % 5 = 0) AS missing
  FROM u""")
def verify_profiles(spark, sf_dir):
    """The parser's table, with some rows changed and a year left out, against the patterns' reading."""
    # filings are made and read once, by both readers
    both = staged(X.shred(V.with_profile(T.filings_xml(spark, sf_dir)), X.FOUNDATION, ["second"], every=True), "both")
    parsed = X.foundations(both.filter("ein IS NOT NULL")).filter("tax_year % 5 <> 0")
    changed = parsed.withColumn("website", F.when(F.col("ein").cast("long") % 7 == 0, "changed").otherwise(F.col("website")))
    return V.diff_counts(V.field_diff(V.profile_of(both), changed))


@query(f"""WITH {_ALL}, e AS (SELECT DISTINCT ein
  FROM u) SELECT count(*) FILTER (WHERE c_custkey % 6 <> 3 AND e.ein IS NOT NULL) AS matched,
    count(*) FILTER (WHERE c_custkey % 6 = 3 AND e.ein IS NOT NULL) AS mismatched,
    count(*) FILTER (WHERE e.ein IS NULL) AS missing
  FROM customer
  LEFT JOIN e ON CAST(e.ein AS BIGINT) = c_custkey""")
def verify_flags(spark, sf_dir):
    """Unpadded ids with flags, some of them wrong, against the latest flags of the patterns."""
    k = F.col("c_custkey")
    rows = T.table(spark, sf_dir, "customer").select(k.cast("string").alias("ein"), invite_text(F.when(k % 6 == 3, k % 3 != 0).otherwise(k % 3 == 0)).alias("flag"))
    return V.diff_counts(V.flag_diff(rows, V.latest_flags(T.filings_xml(spark, sf_dir)).select("ein", "invite_only")))


def _archives(spark, sf_dir):
    """The filings as zip archives in scratch, one for each task that makes them, and a broken one; their paths.

    Filings go into an archive as they are made, packed: they are neither shuffled nor held.
    """
    path = scratch(spark, "archives")
    store_of = lambda: fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")

    def pack(batches):
        """An archive appears under its name, which is that of the task, once it is whole; a task that runs again puts it there again."""
        store, at = store_of()
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        name = f"{TaskContext.get().partitionId():06d}.zip"
        part = f"{at}/{name}.{uuid.uuid4().hex}.part"
        with store.open_output_stream(part) as out:
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=6) as z:
                for b in itertools.chain([first], batches):
                    for p, c in zip(b.column("path"), b.column("content")):
                        z.writestr(p.as_py().split("/")[-1], c.as_py())
                z.writestr("readme.txt", "x")
        store.move(part, f"{at}/{name}")
        yield pa.RecordBatch.from_pydict({"path": [f"{path}/{name}"]}, schema=pa.schema([("path", pa.string())]))

    store, at = store_of()
    store.create_dir(at)
    with store.open_output_stream(f"{at}/broken.zip") as out:
        out.write(b"no archive")
    paths = staged(T.filings_xml(spark, sf_dir).mapInArrow(pack, "path string"), "paths")
    return paths.unionAll(spark.createDataFrame([(f"{path}/broken.zip",)], "path string"))


def _chosen(spark, sf_dir):
    index = T.filing_paths(spark, sf_dir).select(object_id(F.col("path")).alias("object_id"))
    at = F.substring_index("object_id", "_", 1).cast("long")
    return X.wanted_members(X.list_members(_archives(spark, sf_dir)), index.filter(at % 2 == 0), index.filter(at % 4 == 0))


@query(f"WITH {_ALL} SELECT count(*) FILTER (WHERE {_K} % 4 = 2) AS extracted, count(*) FILTER (WHERE {_K} % 4 = 0) AS skipped, bool_or({_K} % 4 = 2) AS some_bytes FROM u")
def archive_counts(spark, sf_dir):
    return X.member_counts(_chosen(spark, sf_dir)).select("extracted", "skipped", (F.col("bytes") > F.col("extracted") * 100).alias("some_bytes"))


@query(f"WITH {_ALL} SELECT ein, tax_year, name AS organization_name FROM u WHERE {_K} % 4 = 2")
def archive_filings(spark, sf_dir):
    """Members of archives that are wanted and not on disk, shredded."""
    members = _chosen(spark, sf_dir).filter("NOT skip")
    return X.foundations(X.shred(X.read_members(members), X.FOUNDATION)).select("ein", "tax_year", "organization_name")


def _archive_folder(spark, sf_dir) -> str:
    return _archives(spark, sf_dir).first()["path"].rsplit("/", 1)[0]


@query(f"""WITH {_ALL} SELECT ein || '_' || tax_year AS object_id, CAST(1 AS BIGINT) AS members, true AS has_bytes FROM u
  UNION ALL SELECT (c_custkey * 2 + 1) || '_odd', CAST(1 AS BIGINT), true FROM customer WHERE c_custkey % 10 IN (0, 5, 7)""")
def archive_members(spark, sf_dir):
    """What the directories of archives list, by the data source; nothing is unpacked."""
    A.register(spark)
    listed = spark.read.format(A.FORMAT).schema("object_id string, size long").load(_archive_folder(spark, sf_dir))
    return listed.groupBy("object_id").agg(F.count("*").alias("members"), (F.min("size") > 50).alias("has_bytes"))


@query(f"""WITH {GRANTS} SELECT ein, tax_year, grantee_name, CASE WHEN is_foreign = 1 THEN country ELSE 'US' END AS country, is_foreign, purpose FROM g""")
def lateral_grants(spark, sf_dir):
    """Archives read by the data source and shredded by the table function, in SQL; ids with a dash or letter at the start are none of filings."""
    A.register(spark)
    files = spark.read.format(A.FORMAT).option("idFrom", "0").option("idBelow", ":").load(_archive_folder(spark, sf_dir))
    sql = f"""SELECT f.ein, CAST(f.year AS INT) AS tax_year, g.name AS grantee_name, g.country, g.is_foreign, g.purpose
      FROM {{files}} a, LATERAL {A.FUNCTION}(a.object_id, a.content) f, LATERAL inline(f.grants) g"""
    return spark.sql(sql, files=files)


@query(f"""WITH {_ALL} SELECT ein, tax_year,
    CASE WHEN {_K} % 3 = 0 THEN NULL WHEN {_K} % 3 = 1 THEN '' ELSE name END AS name, CAST(assets AS BIGINT) AS assets, '' AS website
  FROM u""")
def conditional_update(spark, sf_dir):
    """Rows found take the new values, nulls and '' too; a column that was missing is added with its default."""
    u = T.filings(spark, sf_dir).join(T.universe(spark, sf_dir).select("ein", "name"), "ein").select("ein", "tax_year", "name", "assets")
    k = F.col("ein").cast("long")
    new = u.filter(k % 3 < 2).withColumn("name", F.when(k % 3 == 1, "")).select("ein", "tax_year", "name")
    return with_columns(update(u, new, ["ein", "tax_year"], ["name"]), {"website": ("string", "")})


@query(f"WITH {_ALL} SELECT count(*) FILTER (WHERE {_K} % 3 < 2) AS updated, count(*) FILTER (WHERE {_K} % 3 = 2) AS skipped FROM u")
def update_count(spark, sf_dir):
    f = T.filings(spark, sf_dir).select("ein", "tax_year")
    return update_counts(f.filter(F.col("ein").cast("long") % 3 < 2), f, ["ein", "tax_year"])


@query(f"""WITH {GRANTS} SELECT ein, tax_year, sum(amount)::BIGINT AS amount, count(*) AS n
  FROM (SELECT ein, tax_year, 1 AS amount
  FROM g
  WHERE tax_year = 1996
  UNION ALL SELECT ein, tax_year, amount
  FROM g
  WHERE tax_year <> 1996)
  GROUP BY 1, 2""")
def replaced_children(spark, sf_dir):
    """The grants of a year, written once more, take the place of the old ones; other years stay."""
    path = scratch(spark, "grants")
    g = T.grants(spark, sf_dir).select("ein", "tax_year", "amount")
    replace_children(g, path, ["ein", "tax_year"], "tax_year")
    replace_children(g.filter("tax_year = 1996").withColumn("amount", F.lit(1).cast("long")), path, ["ein", "tax_year"], "tax_year")
    return spark.read.parquet(path).groupBy("ein", "tax_year").agg(F.sum("amount").alias("amount"), F.count("*").alias("n"))
