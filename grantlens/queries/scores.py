"""Alignment totals, the scored batch, the export's rows and the counts that runs report."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab
from ..functions.text import application_status, first_truthy, object_id, reply_array, whole_number
from ..operators.entity_match import matched_entities
from ..plans import alignment, counters
from ..sources import testbed as T
from ..sources.scratch import staged
from . import core
from .catalog import SQL, query
from .core import EIN, FILINGS, GRANTS, sql_keywords

_TOTAL = f"""a AS (SELECT lpad(c_custkey::VARCHAR, 9, '0') AS ein
    FROM customer), al AS (SELECT a.ein, CAST(least(coalesce(grantee_points, 0) + coalesce(keyword_points, 0) + coalesce(international_points, 0) + coalesce(focus_points, 0), 100) AS BIGINT) AS alignment_score,
  coalesce(grantee_matches, '') AS grantee_matches, coalesce(grantee_match_count, 0) AS grantee_match_count, coalesce(keyword_matches, '') AS keyword_matches, coalesce(keyword_match_count, 0) AS keyword_match_count, CASE WHEN coalesce(international_points, 0) > 0 THEN 'Yes' ELSE 'No' END AS gives_internationally
  FROM a LEFT JOIN ({SQL['grantee_points']}) USING (ein) LEFT JOIN ({SQL['keyword_points']}) USING (ein) LEFT JOIN ({SQL['international_points']}) USING (ein) LEFT JOIN ({SQL['focus_points']}) USING (ein))"""


@query(f"WITH {_TOTAL} SELECT * FROM al")
def alignment_score(spark, sf_dir):
    return alignment.alignment(T.universe(spark, sf_dir).select("ein"), *core.all_points(spark, sf_dir))


_WORDS = ", ".join(f"('{k}', '{c}')" for c, ks in vocab.CLUSTERS.items() for k in ks)


@query(f"""WITH {GRANTS}, x AS (SELECT lpad(c_custkey::VARCHAR, 9, '0') AS ein, c_name || ' Church Fund' AS text, 1 AS w FROM customer
  UNION ALL SELECT ein, string_agg(DISTINCT purpose || ' for Refugees', ' ' ORDER BY purpose || ' for Refugees'), 2 FROM g GROUP BY ein
  UNION ALL SELECT lpad(c_custkey::VARCHAR, 9, '0'), 'Missions in Africa of ' || c_mktsegment || ' Faith Based evangelists', 3 FROM customer WHERE c_custkey % 2 = 0),
k AS (SELECT * FROM (VALUES {_WORDS}) v(k, c)),
d AS (SELECT text, c, k
    FROM (SELECT text, unnest({sql_keywords('lower(text)', [k for ks in vocab.CLUSTERS.values() for k in ks])}) AS k
    FROM (SELECT DISTINCT text
    FROM x)) JOIN k USING (k)),
h AS (SELECT ein, c, k, max(w) AS w FROM x JOIN d USING (text) GROUP BY 1, 2, 3)
SELECT ein, CAST(least(sum(w) + CASE WHEN count(DISTINCT c) >= 3 THEN 5 WHEN count(DISTINCT c) = 2 THEN 3 ELSE 0 END, 30) AS BIGINT) AS keyword_points,
  string_agg(DISTINCT k, '; ' ORDER BY k) AS keyword_matches, CAST(count(*) AS INT) AS keyword_match_count FROM h GROUP BY ein""")
def field_keyword_points(spark, sf_dir):
    """All keywords in three fields of different weight; a phrase runs over two rows of activities."""
    u = T.universe(spark, sf_dir)
    purposes = T.grants(spark, sf_dir).select("ein", F.concat("purpose", F.lit(" for Refugees")).alias("text")).distinct()
    rows = u.filter(F.col("ein").cast("long") % 2 == 0).select("ein", F.explode(F.array(F.struct(F.lit(1).alias("n"), F.concat(F.lit("Missions in Africa of "), "ntee", F.lit(" Faith")).alias("text")), F.struct(F.lit(2).alias("n"), F.lit("Based evangelists").alias("text")))).alias("r")).select("ein", "r.*")
    texts = alignment.field_texts(u.select("ein", F.concat("name", F.lit(" Church Fund")).alias("text")), alignment.joined_texts(purposes, "ein", "text", "text"), alignment.joined_texts(rows, "ein", "text", "n"))
    return alignment.keyword_points(texts)


_AMOUNT = "CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 5 = 1 THEN 'n/a' ELSE CAST(c_custkey * 997 % 120000 AS VARCHAR) END"
_TIER = "CASE WHEN m >= 100000 THEN 40 WHEN m >= 50000 THEN 33 WHEN m >= 25000 THEN 26 WHEN m >= 10000 THEN 20 WHEN m >= 5000 THEN 13 WHEN m >= 1000 THEN 7 ELSE 0 END"
_BATCH = f"""{_TOTAL}, w AS (SELECT CASE WHEN c_custkey % 4 = 0 THEN 'qqqq zzzz ' || c_custkey ELSE c_name || ' Inc' END AS name, c_custkey % 4 <> 0 AS hit, lpad(c_custkey::VARCHAR, 9, '0') AS e, coalesce(TRY_CAST({_AMOUNT} AS DOUBLE), 0) AS m
    FROM customer),
b AS (SELECT name, '' AS city, '' AS state, CASE WHEN hit THEN e ELSE '' END AS ein, hit AS data_found, CASE WHEN hit THEN alignment_score ELSE 0 END AS alignment_score,
  CAST(least(floor((CASE WHEN hit THEN alignment_score ELSE 0 END)::DOUBLE / 100 * 60 + {_TIER}), 100) AS BIGINT) AS opportunity_score, CASE WHEN hit THEN grantee_matches ELSE '' END AS grantee_matches, CASE WHEN hit THEN keyword_matches ELSE '' END AS keyword_matches,
  CASE WHEN hit THEN gives_internationally ELSE '' END AS gives_internationally FROM w JOIN al ON al.ein = w.e)"""


def _batch(spark, sf_dir):
    k = F.col("c_custkey")
    amount = F.when(k % 5 == 0, "").when(k % 5 == 1, "n/a").otherwise((k * 997 % 120000).cast("string"))
    name = F.when(k % 4 == 0, F.concat(F.lit("qqqq zzzz "), k.cast("string"))).otherwise(F.concat("c_name", F.lit(" Inc")))
    rows = T.table(spark, sf_dir, "customer").select(name.alias("name"), F.lit("").alias("city"), F.lit("").alias("state"), amount.alias("grant_amount"))
    entities = T.universe(spark, sf_dir).select("ein", "name", F.lit("").alias("city"), "state")
    return alignment.score_batch(rows, matched_entities(rows, entities), staged(alignment_score(spark, sf_dir), "scores"))


@query(f"WITH {_BATCH} SELECT * FROM b")
def scored_batch(spark, sf_dir):
    """Names matched to entities and scored, best opportunity first."""
    return _batch(spark, sf_dir)


@query(f"""WITH {_BATCH} SELECT count(*) FILTER (WHERE alignment_score > 0) AS aligned, coalesce(avg(CASE WHEN alignment_score > 0 THEN alignment_score END), 0) AS mean_alignment, max(alignment_score) AS max_alignment,
avg(opportunity_score) AS mean_opportunity, max(opportunity_score) AS max_opportunity, count(*) FILTER (WHERE data_found) AS data_found FROM b""")
def run_summary(spark, sf_dir):
    return counters.run_summary(_batch(spark, sf_dir))


_EXPORT = f"""{FILINGS}, l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY ein ORDER BY tax_year DESC) = 1),
x AS (SELECT u.ein,
    CASE WHEN l.ein IS NOT NULL AND k % 3 <> 0 THEN 'Filed ' || c_name ELSE c_name END AS foundation_name, 'https://example.org/organizations/' || u.ein AS link, l.ein IS NOT NULL AS data_found,
  CASE WHEN l.ein IS NULL THEN '' WHEN k % 4 = 0 THEN 'Invite Only' WHEN k % 2 = 0 THEN 'Accepting Applications' ELSE '' END AS application_status, CASE WHEN l.ein IS NULL THEN '' WHEN k % 2 = 0 THEN 'c' || k ELSE 'p' || k END AS phone
  FROM (SELECT c_custkey AS k, c_name, {EIN.format('c_custkey', 'c_custkey')} AS ein FROM customer) u LEFT JOIN l USING (ein))"""


def _export(spark, sf_dir):
    k = F.col("ein").cast("long")
    latest = core.latest_filing(spark, sf_dir).join(T.universe(spark, sf_dir).select("ein", "name"), "ein")
    p = latest.select("ein", F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("Filed "), "name")).alias("organization_name"), F.when(k % 2 == 0, F.concat(F.lit("c"), k.cast("string"))).otherwise("").alias("contact_phone"),
                      F.concat(F.lit("p"), k.cast("string")).alias("phone"), (k % 4 == 0).cast("int").alias("invite_only"), (k % 2 == 0).cast("int").alias("has_application_info"), F.lit(True).alias("hit"))
    joined = T.universe(spark, sf_dir).select("ein", "name").join(p, "ein", "left")
    return joined.select(
        "ein", first_truthy(F.col("organization_name"), F.col("name")).alias("foundation_name"), F.concat(F.lit("https://example.org/organizations/"), "ein").alias("link"), F.coalesce("hit", F.lit(False)).alias("data_found"),
        application_status(F.col("invite_only"), F.col("has_application_info")).alias("application_status"), F.coalesce(first_truthy(F.col("contact_phone"), F.col("phone")), F.lit("")).alias("phone"),
    )


@query(f"WITH {_EXPORT} SELECT * FROM x")
def export_rows(spark, sf_dir):
    """The template of the export: a filing's values, else the universe's, else ''."""
    return _export(spark, sf_dir)


@query(f"""WITH {_EXPORT} SELECT count(*) AS n,
    count(*) FILTER (WHERE data_found) AS data_found,
    count(*) FILTER (WHERE application_status = 'Accepting Applications') AS accepting,
    count(*) FILTER (WHERE application_status = 'Invite Only') AS invite_only
  FROM x""")
def export_counts(spark, sf_dir):
    return counters.export_counts(_export(spark, sf_dir))


@query(f"WITH {GRANTS} SELECT ein, string_agg(purpose, ' ' ORDER BY id, purpose) AS text FROM g WHERE purpose <> '' GROUP BY ein")
def joined_purposes(spark, sf_dir):
    return alignment.joined_texts(T.grants(spark, sf_dir), "ein", "purpose", "id")


@query("""SELECT CAST(o_custkey AS VARCHAR) AS ein, arg_min(name, sub_date) AS name
  FROM (SELECT o_custkey, strftime(o_orderdate, '%Y') AS sub_date, 'n' || strftime(o_orderdate, '%Y') AS name
  FROM orders)
  GROUP BY 1""")
def one_name(spark, sf_dir):
    """Of all names of an entity that of its first year."""
    year = F.substring("sub_date", 1, 4)
    return T.index(spark, sf_dir).groupBy("ein").agg(F.min_by(F.concat(F.lit("n"), year), year).alias("name"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 0 WHEN event_id % 4 = 1 THEN 0 ELSE CAST(trunc(value) AS BIGINT) END AS n FROM events")
def whole_numbers(spark, sf_dir):
    """Truncated; 0 for words and infinity."""
    k = F.col("event_id")
    text = F.when(k % 4 == 0, "abc").when(k % 4 == 1, "inf").otherwise(F.col("value").cast("string"))
    return T.table(spark, sf_dir, "events").select("event_id", whole_number(text).alias("n"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 2 THEN '' ELSE CAST(event_id AS VARCHAR) END AS object_id FROM events")
def object_ids(spark, sf_dir):
    k = F.col("event_id").cast("string")
    path = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("/a/b.c/"), k, F.lit("_public.xml"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("/x/"), k, F.lit(".xml"))).otherwise(F.concat(F.lit("/x/"), k, F.lit(".txt")))
    return T.table(spark, sf_dir, "events").select("event_id", object_id(path).alias("object_id"))


@query("""SELECT event_id,
    CASE WHEN event_id % 2 = 0 THEN '[' || props || ', [1]]' ELSE '' END AS reply,
    CASE WHEN event_id % 2 = 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k
  FROM events""")
def reply_arrays(spark, sf_dir):
    """The array inside a reply of more words, and a value in it."""
    said = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Sure:\n["), "props", F.lit(", [1]]\nBye"))).otherwise("no array")
    found = T.table(spark, sf_dir, "events").select("event_id", reply_array(said).alias("reply"))
    return found.select("event_id", "reply", F.get_json_object("reply", "$[0].k").cast("long").alias("k"))
