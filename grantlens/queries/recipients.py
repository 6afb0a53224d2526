"""Seeds, the pending path with its cache, and replies of services."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from .. import vocab
from ..plans import faith, pending
from ..sinks.tables import read_cache, write_cache
from ..sources import organisations
from ..sources import testbed as T
from ..sources.scratch import scratch, staged
from .catalog import query
from .core import GRANTS, TAGGED, sql_list, sql_norm

_SEEDS = ", ".join(f"({i}, '{n.replace(chr(39), chr(39) * 2)}', {sql_list(t)})" for i, (n, t) in enumerate(vocab.SEEDS.items()))
_SEEDED = f"""s AS (SELECT name_norm, arg_max(tags, i) AS tags FROM (SELECT i, tags, {sql_norm('name')} AS name_norm FROM (VALUES {_SEEDS}) v(i, name, tags)) GROUP BY 1),
  r AS (SELECT ({sql_list(vocab.TARGETS)})[p_partkey % {len(vocab.TARGETS)} + 1] || CASE WHEN p_partkey % 2 = 0 THEN ' Inc' ELSE ' of ' || p_brand END AS name FROM part)"""


@query(f"WITH {_SEEDED} SELECT DISTINCT name, array_to_string(tags, '|') AS tags FROM (SELECT name, {sql_norm('name')} AS name_norm FROM r) JOIN s USING (name_norm)")
def seeded_names(spark, sf_dir):
    """Names whose normal form is a seed's."""
    k = F.col("p_partkey")
    target = F.element_at(F.array(*map(F.lit, vocab.TARGETS)), (k % len(vocab.TARGETS) + 1).cast("int"))
    names = T.table(spark, sf_dir, "part").select(F.concat(target, F.when(k % 2 == 0, " Inc").otherwise(F.concat(F.lit(" of "), "p_brand"))).alias("grantee_name"), k.alias("amount"))
    kb = faith.knowledge_base(names, seeds=pending.seed_table(spark))
    named = names.select("grantee_name").distinct().withColumn("name_norm", faith.normalized(F.col("grantee_name")))
    return named.join(kb.filter("source = 'seed'"), "name_norm").select(F.col("grantee_name").alias("name"), F.array_join("tags", "|").alias("tags"))


def _kb(spark, sf_dir):
    return staged(faith.knowledge_base(T.grants(spark, sf_dir), T.RULES), "kb")


@query(f"WITH {TAGGED} SELECT name_norm, display_name, max_grant FROM kb WHERE len(tags) = 0 AND max_grant >= 5000 ORDER BY max_grant DESC, name_norm LIMIT 20")
def pending_top(spark, sf_dir):
    return pending.to_classify(_kb(spark, sf_dir), limit=20).select("name_norm", "display_name", "max_grant")


def _reply(names: list[str]) -> str:
    """What a service might say: known tags, unknown ones and doubtful ones, amid other words."""
    tags = lambda n: [{"name": "Church", "confidence": 90}, {"name": "No Such Tag", "confidence": 99}, {"name": "Arts", "confidence": 60}] if "ring" in n else []
    return "Here you are: " + json.dumps([{"name": n, "tags": tags(n)} for n in names]) + " Done."


_CLASSIFIED = f"""{TAGGED}, c AS (SELECT name_norm, display_name, max_grant,
    CASE WHEN len(tags) = 0 AND max_grant >= 5000 THEN CASE WHEN contains(display_name, 'ring') THEN ['Church'] WHEN contains(display_name, 'anvil') THEN ['Arts'] ELSE CAST([] AS VARCHAR[]) END ELSE tags END AS tags,
  CASE WHEN len(tags) > 0 THEN 'rule' WHEN max_grant >= 5000 THEN 'llm' ELSE 'pending' END AS source FROM kb)"""


def _classified(spark, sf_dir):
    """Anvils are in the cache already; the others are asked about and go to the cache, from which all tags come."""
    kb = _kb(spark, sf_dir)
    path = scratch(spark, "cache")
    known = kb.filter(F.col("display_name").contains("anvil")).select("display_name", F.array(F.struct(F.lit("Arts").alias("name"), F.lit(100.0).alias("confidence"))).cast(pending.TAGS).alias("tags"))
    write_cache(known, path)
    schema = f"display_name string, tags {pending.TAGS}"
    _, new = pending.classify_pending(kb, read_cache(spark, path, schema), _reply)
    write_cache(staged(new, "new"), path)
    return pending.apply_cache(kb, read_cache(spark, path, schema))


@query(f"WITH {_CLASSIFIED} SELECT name_norm, display_name, max_grant, array_to_string(tags, '|') AS tags, source FROM c")
def classified_kb(spark, sf_dir):
    return _classified(spark, sf_dir).withColumn("tags", F.array_join("tags", "|"))


@query(f"WITH {_CLASSIFIED} SELECT source, count(*) AS n FROM c GROUP BY 1")
def source_counts(spark, sf_dir):
    return pending.source_counts(_classified(spark, sf_dir))


@query("""SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type) FILTER (WHERE value >= 20)), '|') AS tags
  FROM events
  GROUP BY user_id HAVING count(*) FILTER (WHERE value >= 20) > 0""")
def confident_tags(spark, sf_dir):
    """Names of nested tags that are sure enough; empty sets go. The value is the confidence, 20 the least."""
    tags = F.sort_array(F.collect_list(F.struct(F.col("event_type").alias("name"), F.col("value").alias("confidence"))))
    by = T.table(spark, sf_dir, "events").groupBy("user_id").agg(faith.confident(tags, 20).alias("tags"))
    return by.filter(F.size("tags") > 0).select("user_id", F.array_join("tags", "|").alias("tags"))


@query(f"WITH {GRANTS} SELECT DISTINCT grantee_name, state, country FROM g")
def distinct_places(spark, sf_dir):
    return T.grants(spark, sf_dir).select("grantee_name", "state", "country").distinct()


@query("""WITH o AS (SELECT o_custkey, o_orderkey, CAST(strftime(o_orderdate, '%Y%m') AS BIGINT) AS p, CAST(floor(o_totalprice) AS BIGINT) AS r, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders),
l AS (SELECT * FROM o WHERE o_orderkey % 2 = 0 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY p DESC, place) = 1)
SELECT lpad(c_custkey::VARCHAR, 9, '0') AS ein,
    CASE WHEN c_custkey % 5 = 0 THEN 'No' ELSE 'Yes' END AS found,
    CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_name END AS name, '' AS city,
    CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END AS state, '' AS ntee_code,
  CASE WHEN c_custkey % 5 = 0 THEN '' ELSE coalesce(p::VARCHAR, '') END AS latest_filing, CASE WHEN c_custkey % 5 = 0 OR r % 10 = 0 THEN '' ELSE coalesce(r::VARCHAR, '') END AS latest_revenue FROM customer LEFT JOIN l ON o_custkey = c_custkey""")
def organisation_summary(spark, sf_dir):
    """Replies of a service: none for some, other forms among the filings, no revenue."""
    o = T.table(spark, sf_dir, "orders")
    revenue = F.floor("o_totalprice")
    filing = F.struct(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderkey") % 2 == 0, 2).otherwise(1).alias("formtype"), F.date_format("o_orderdate", "yyyyMM").cast("long").alias("tax_prd"), F.when(revenue % 10 == 0, 0).otherwise(revenue).alias("totrevenue"))
    filed = o.groupBy("o_custkey").agg(F.sort_array(F.collect_list(filing)).alias("filings_with_data"))
    c = T.table(spark, sf_dir, "customer").join(filed, F.col("c_custkey") == F.col("o_custkey"), "left")
    organization = F.when(F.col("c_custkey") % 5 != 0, F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("state")))
    replies = c.select(F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("ein"), F.to_json(F.struct(organization.alias("organization"), "filings_with_data")).alias("reply"))
    return organisations.summarise(replies)
