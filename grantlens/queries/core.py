"""Queries by name, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..functions.text import application_status, normalized, phone, website, year
from ..operators.matching import fuzzy_pairs, match_targets
from ..operators.relational import covered, fixed_sample, latest, missing, upsert
from ..plans import alignment, faith
from ..sources import testbed as T
from ..sources.scratch import staged
from .catalog import query

EIN = "lpad(CAST({} AS VARCHAR), CAST(greatest(9, length(CAST({} AS VARCHAR))) AS INT), '0')"
GRANTS = f"""g AS (SELECT l_orderkey * 10 + l_linenumber AS id, {EIN.format('o_custkey', 'o_custkey')} AS ein, p_name AS grantee_name, n_name AS state, r_name AS country,
  CASE WHEN s_nationkey <> c_nationkey THEN 1 ELSE 0 END AS is_foreign, CAST(floor(l_extendedprice) AS BIGINT) AS amount, p_type AS purpose, CAST(year(o_orderdate) AS INT) AS tax_year
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def sql_list(xs: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


def sql_norm(c: str) -> str:
    cut = f"regexp_replace(lower({c}), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"
    for_each = "CASE " + " ".join(f"WHEN instr(x0, '{m}') > 1 THEN regexp_replace(substr(x0, 1, instr(x0, '{m}') - 1), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')" for m in vocab.FORMER_NAMES) + " ELSE x0 END"
    full = "CASE t " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in vocab.ABBREVIATIONS.items()) + " ELSE t END"
    tokens = f"list_filter(string_split_regex(regexp_replace({for_each.replace('x0', f'({cut})')}, '[^\\p{{L}}\\p{{N}}_\\s\\p{{Z}}]', '', 'g'), '[\\s\\p{{Z}}]+'), lambda t: t <> '')"
    return f"array_to_string(list_filter(list_transform({tokens}, lambda t: {full}), lambda t: NOT list_contains({sql_list(vocab.STOP_WORDS)}, t)), ' ')"


def sql_rules(c: str, rules: list = T.RULES) -> str:
    """Tags of all rules that fit, each once, in the order of the rules."""
    hits = ", ".join(f"CASE WHEN regexp_matches(lower({c}), '{r}') THEN {sql_list(t)} ELSE CAST([] AS VARCHAR[]) END" for r, t in rules)
    return f"list_reduce(flatten([{hits}]), lambda a, t: CASE WHEN list_contains(a, t) THEN a ELSE list_append(a, t) END, CAST([] AS VARCHAR[]))" if rules is not T.RULES else f"flatten([{hits}])"


def sql_keywords(c: str, words: list[str]) -> str:
    """The keywords that a text in lower case holds; with constant patterns, which are compiled once."""
    edge = "[^\\p{L}\\p{N}_]"
    one = lambda k: f"regexp_matches({c}, '(^|{edge}){k.lower()}(s|es|ing|al)?($|{edge})')" + (f" OR contains({c}, '{k.lower()}')" if k in vocab.COMPOUNDS else "")
    return "list_filter([" + ", ".join(f"CASE WHEN {one(k)} THEN '{k}' END" for k in words) + "], lambda k: k IS NOT NULL)"


def sql_tier(tiers: list) -> str:
    return "CASE " + " ".join(f"WHEN faith_alignment_score >= {cut} THEN '{name}'" for cut, name in tiers[:-1]) + f" ELSE '{tiers[-1][1]}' END"


TAGGED = f"""{GRANTS}, n AS (SELECT grantee_name, max(amount) AS m, {sql_norm('grantee_name')} AS name_norm FROM g WHERE grantee_name <> '' GROUP BY grantee_name),
  kb AS (SELECT name_norm, display_name, max_grant, {sql_rules('display_name')} AS tags
    FROM (SELECT name_norm, grantee_name AS display_name, m AS max_grant, row_number() OVER (PARTITION BY name_norm ORDER BY m DESC, grantee_name) AS k
    FROM n
    WHERE name_norm <> '')
    WHERE k = 1),
  t AS (SELECT g.*, coalesce(kb.tags, CAST([] AS VARCHAR[])) AS tags FROM g LEFT JOIN n USING (grantee_name) LEFT JOIN kb ON n.name_norm = kb.name_norm)"""
_C = [f"list_has_any(tags, {sql_list(t)})" for _, t in vocab.COMPONENTS]
SCORES = f"""{TAGGED}, b AS (SELECT ein, CAST(sum(amount) AS BIGINT) AS total_giving, CAST(sum(CASE WHEN {_C[0]} THEN amount ELSE 0 END) AS BIGINT) AS faith_giving, count(DISTINCT tax_year) AS years_of_giving,
  count(DISTINCT CASE WHEN {_C[0]} THEN tax_year END) AS years_of_faith_giving, {', '.join(f'CAST(sum(CASE WHEN {c} THEN amount ELSE 0 END) AS DOUBLE) AS c{i}' for i, c in enumerate(_C))} FROM t GROUP BY ein HAVING sum(amount) > 0),
  s AS (SELECT *, CAST(least(round_even({' + '.join(f'{w}::DOUBLE * (c{i} / total_giving::DOUBLE)' for i, (w, _) in enumerate(vocab.COMPONENTS))} + 10.0::DOUBLE * (years_of_faith_giving::DOUBLE / years_of_giving::DOUBLE), 0), 100.0::DOUBLE) AS INT) AS faith_alignment_score
    FROM b)"""
_SCORE_COLUMNS = f"""ein, faith_alignment_score, {sql_tier(vocab.TIERS)} AS faith_tier, {sql_tier(vocab.STARS)} AS faith_stars, round_even(100.0::DOUBLE * faith_giving::DOUBLE / total_giving::DOUBLE, 1) AS christian_giving_pct,
  years_of_faith_giving, years_of_giving, total_giving, faith_giving"""

def grants_and_names(spark: SparkSession, sf_dir: str, *more: str) -> tuple[DataFrame, DataFrame]:
    """The grants, joined once and staged, and the tags of their distinct names."""
    g = staged(T.grants(spark, sf_dir).select("ein", "grantee_name", "amount", "tax_year", *more), "grants")
    names = staged(faith.largest_by_name(g), "names")
    return g, faith.tags_of_names(names, faith.knowledge_base_of(names, T.RULES))


@query(f"""SELECT ein, name, state, ntee
  FROM (SELECT {EIN.format('c_custkey', 'c_custkey')} AS ein, c_name AS name, n_name AS state, c_mktsegment AS ntee
  FROM customer JOIN nation ON c_nationkey = n_nationkey)
  WHERE ntee IN ('BUILDING', 'MACHINERY')""")
def universe_filter(spark, sf_dir):
    return T.universe(spark, sf_dir).filter(F.col("ntee").isin("BUILDING", "MACHINERY"))


@query(f"""WITH f AS (SELECT DISTINCT {EIN.format('o_custkey', 'o_custkey')} AS ein
  FROM orders
  WHERE year(o_orderdate) = 1996), u AS (SELECT {EIN.format('c_custkey', 'c_custkey')} AS ein
  FROM customer) SELECT ein
  FROM u
  WHERE ein NOT IN (SELECT ein
  FROM f)""")
def missing_entities(spark, sf_dir):
    return missing(T.universe(spark, sf_dir).select("ein"), T.filings(spark, sf_dir).filter("tax_year = 1996"), "ein")


@query(f"""WITH f AS (SELECT DISTINCT {EIN.format('o_custkey', 'o_custkey')} AS ein
  FROM orders
  WHERE year(o_orderdate) = 1996), u AS (SELECT {EIN.format('c_custkey', 'c_custkey')} AS ein
  FROM customer) SELECT ein
  FROM u
  WHERE ein IN (SELECT ein
  FROM f)""")
def covered_entities(spark, sf_dir):
    return covered(T.universe(spark, sf_dir).select("ein"), T.filings(spark, sf_dir).filter("tax_year = 1996"), "ein")


FILINGS = f"""f AS (SELECT {EIN.format('o_custkey', 'o_custkey')} AS ein, CAST(year(o_orderdate) AS INT) AS tax_year, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS assets, count(*) AS n_orders
  FROM orders
  GROUP BY 1, 2)"""


@query(f"WITH {FILINGS} SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY ein ORDER BY tax_year DESC) = 1")
def latest_filing(spark, sf_dir):
    return latest(T.filings(spark, sf_dir), ["ein"], "tax_year")


@query("""SELECT user_id,
    CASE WHEN event_type = 'error' THEN 'Invite Only' ELSE 'Not Invite Only' END AS flag
  FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def latest_flag(spark, sf_dir):
    e = T.table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return latest(e, ["user_id"], "ts", "event_id").select("user_id", F.when(F.col("event_type") == "error", "Invite Only").otherwise("Not Invite Only").alias("flag"))


@query(f"WITH {GRANTS} SELECT ein, string_agg(DISTINCT state, '; ' ORDER BY state) AS states_given FROM g WHERE is_foreign = 0 AND state <> '' GROUP BY ein")
def states_given(spark, sf_dir):
    return states_of(T.grants(spark, sf_dir))


def states_of(grants: DataFrame) -> DataFrame:
    return grants.filter("is_foreign = 0 AND state <> ''").groupBy("ein").agg(F.array_join(F.array_sort(F.collect_set("state")), "; ").alias("states_given"))


_NAMES = """(SELECT p_partkey AS k, p_name || ' Fdn, Inc. dba The ' || p_brand AS name
  FROM part
  UNION ALL SELECT c_custkey + 1000000000, 'The Char Tr of ' || c_name || ' & fam'
  FROM customer)"""


@query(f"SELECT k, name, {sql_norm('name')} AS norm FROM {_NAMES}")
def normalize_names(spark, sf_dir):
    p = T.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.concat("p_name", F.lit(" Fdn, Inc. dba The "), "p_brand").alias("name"))
    c = T.table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1000000000).alias("k"), F.concat(F.lit("The Char Tr of "), "c_name", F.lit(" & fam")).alias("name"))
    return p.unionAll(c).withColumn("norm", normalized(F.col("name")))


@query(f"WITH {TAGGED} SELECT name_norm, display_name, max_grant, array_to_string(tags, '|') AS tags, CASE WHEN len(tags) > 0 THEN 'rule' ELSE 'pending' END AS source FROM kb")
def recipient_kb(spark, sf_dir):
    return faith.knowledge_base(T.grants(spark, sf_dir), T.RULES).withColumn("tags", F.array_join("tags", "|"))


@query(f"WITH {TAGGED} SELECT id, array_to_string(tags, '|') AS tags FROM t")
def tag_inheritance(spark, sf_dir):
    g, named = grants_and_names(spark, sf_dir, "id")
    return faith.tagged_grants(g, named).select("id", F.array_join("tags", "|").alias("tags"))


@query(f"WITH {SCORES} SELECT {_SCORE_COLUMNS} FROM s")
def faith_score(spark, sf_dir):
    return faith.faith_scores(*grants_and_names(spark, sf_dir))


@query(f"WITH {SCORES} SELECT {_SCORE_COLUMNS} FROM s ORDER BY faith_alignment_score DESC, ein LIMIT 50")
def faith_score_top(spark, sf_dir):
    return faith.faith_scores(*grants_and_names(spark, sf_dir)).orderBy(F.desc("faith_alignment_score"), "ein").limit(50)


@query(f"""WITH {TAGGED}, x AS (SELECT ein, tag, sum(amount) AS s
  FROM (SELECT ein, amount, unnest(list_distinct(list_intersect(tags, {sql_list(vocab.FAITH_TAGS)}))) AS tag
  FROM t)
  GROUP BY 1, 2) SELECT ein, string_agg(tag, '; ' ORDER BY s DESC, tag) AS faith_categories
  FROM x
  GROUP BY ein""")
def faith_categories(spark, sf_dir):
    return faith.faith_categories(faith.tagged_grants(*grants_and_names(spark, sf_dir)))


@query(f"WITH {SCORES} SELECT faith_tier, count(*) AS n FROM (SELECT {sql_tier(vocab.TIERS)} AS faith_tier FROM s) GROUP BY 1 ORDER BY n DESC, faith_tier")
def tier_distribution(spark, sf_dir):
    return faith.faith_scores(*grants_and_names(spark, sf_dir)).groupBy("faith_tier").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "faith_tier")


@query(f"""WITH {GRANTS}, b AS (SELECT ein, count(*) AS n, count(*) FILTER (WHERE is_foreign = 1) AS f, count(DISTINCT CASE WHEN is_foreign = 1 AND country <> '' THEN country END) AS c FROM g GROUP BY ein)
SELECT ein, CAST((CASE WHEN f > 0 THEN 10 ELSE 0 END) + (CASE WHEN f / n > 0.25 THEN 8 ELSE 0 END) + (CASE WHEN c >= 2 THEN 7 ELSE 0 END) AS BIGINT) AS international_points
    FROM b""")
def international_points(spark, sf_dir):
    return alignment.international_points(T.grants(spark, sf_dir))


_FAITH, _ABROAD = ["widget", "gear", "hot", "economy", "small"], ["standard", "promo", "copper", "tin"]


@query(f"""WITH {GRANTS}, x AS (SELECT ein, lower(grantee_name || ' ' || purpose) AS t, lower(purpose) AS a FROM g),
b AS (SELECT ein, {', '.join(f"max(CASE WHEN contains(a, '{w}') THEN 1 ELSE 0 END) AS t{i}" for i, w in enumerate(_FAITH + _ABROAD))},
avg(CASE WHEN {' OR '.join(f"contains(t, '{w}')" for w in _FAITH + _ABROAD)} THEN 1 ELSE 0 END) AS share FROM x GROUP BY ein)
SELECT ein, CAST(least({' + '.join(f't{i}' for i in range(len(_FAITH)))}, 4) + least({' + '.join(f't{i}' for i in range(len(_FAITH), len(_FAITH + _ABROAD)))}, 3)
  + (CASE WHEN share > 0.5 THEN 3 ELSE 0 END) AS BIGINT) AS focus_points FROM b""")
def focus_points(spark, sf_dir):
    return alignment.focus_of_grants(T.grants(spark, sf_dir), _FAITH, _ABROAD)


_WORDS = {"a": ["Widget", "Gear"], "b": ["Plate", "Bolt", "Ring"], "c": ["Red", "Hot"]}


@query(f"""WITH {GRANTS}, x AS (SELECT DISTINCT ein, grantee_name AS t, 1 AS w FROM g UNION ALL SELECT DISTINCT ein, purpose, 2 FROM g),
k AS (SELECT * FROM (VALUES {', '.join(f"('{c}', '{w}')" for c, ws in _WORDS.items() for w in ws)}) AS v(c, k)),
d AS (SELECT t, c, k FROM (SELECT t, unnest({sql_keywords('lower(t)', [w for ws in _WORDS.values() for w in ws])}) AS k FROM (SELECT DISTINCT t FROM x)) JOIN k USING (k)),
h AS (SELECT ein, c, k, max(w) AS w FROM x JOIN d USING (t) GROUP BY 1, 2, 3)
SELECT ein, CAST(least(sum(w) + CASE WHEN count(DISTINCT c) >= 3 THEN 5 WHEN count(DISTINCT c) = 2 THEN 3 ELSE 0 END, 30) AS BIGINT) AS keyword_points,
  string_agg(DISTINCT k, '; ' ORDER BY k) AS keyword_matches, CAST(count(*) AS INT) AS keyword_match_count FROM h GROUP BY ein""")
def keyword_points(spark, sf_dir):
    return alignment.keyword_points(keyword_texts(T.grants(spark, sf_dir)), _WORDS)


def keyword_texts(grants: DataFrame) -> DataFrame:
    """Names and purposes of grants with their weights, from one pass over the grants."""
    both = F.array(F.struct(F.col("grantee_name").alias("text"), F.lit(1).alias("weight")), F.struct(F.col("purpose").alias("text"), F.lit(2).alias("weight")))
    return staged(grants.select("ein", F.explode(both).alias("t")).select("ein", "t.*").distinct(), "texts")


@query(f"""WITH {GRANTS}, m AS (SELECT ein, grantee_name, min(id) AS first, max(amount * CASE WHEN tax_year >= 2000 THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END) AS m FROM g WHERE contains(grantee_name, 'widget') GROUP BY 1, 2),
b AS (SELECT ein, count(*) AS n, count(*) FILTER (WHERE m > 25000) AS l, string_agg(grantee_name, '; ' ORDER BY first, grantee_name) AS grantee_matches FROM m GROUP BY ein)
SELECT ein, CAST(least((CASE n WHEN 1 THEN 12 WHEN 2 THEN 20 WHEN 3 THEN 26 ELSE 30 + 2 * (n - 4) END) + least(2 * l, 5), 35) AS BIGINT) AS grantee_points, grantee_matches, n AS grantee_match_count
    FROM b""")
def grantee_points(spark, sf_dir):
    return grantee_points_of(T.grants(spark, sf_dir))


def grantee_points_of(grants: DataFrame) -> DataFrame:
    g = grants.filter(F.col("grantee_name").contains("widget")).withColumnRenamed("grantee_name", "canonical")
    return alignment.grantee_points(g, F.when(F.col("tax_year") >= 2000, 1.2).otherwise(1.0))


def all_points(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Grantee, keyword, international and focus points of all givers; the grants are joined once."""
    g = staged(T.grants(spark, sf_dir), "all_grants")
    return [grantee_points_of(g), alignment.keyword_points(keyword_texts(g), _WORDS), alignment.international_points(g), alignment.focus_of_grants(g, _FAITH, _ABROAD)]


@query("""SELECT o_orderkey, CAST(least(floor((o_orderkey % 101) / 100.0::DOUBLE * 60 + CASE WHEN o_totalprice >= 100000 THEN 40 WHEN o_totalprice >= 50000 THEN 33 WHEN o_totalprice >= 25000 THEN 26 WHEN o_totalprice >= 10000 THEN 20 WHEN o_totalprice >= 5000 THEN 13 WHEN o_totalprice >= 1000 THEN 7 ELSE 0 END), 100) AS BIGINT) AS opportunity
  FROM orders""")
def opportunity_score(spark, sf_dir):
    return T.table(spark, sf_dir, "orders").select("o_orderkey", alignment.opportunity((F.col("o_orderkey") % 101).cast("double"), F.col("o_totalprice").cast("string")).alias("opportunity"))


@query("""SELECT c_custkey,
    CASE WHEN length(d) = 10 THEN '(' || substr(d, 1, 3) || ') ' || substr(d, 4, 3) || '-' || substr(d, 7, 4) ELSE p END AS phone
  FROM (SELECT c_custkey, p, regexp_replace(p, '[^0-9]', '', 'g') AS d
  FROM (SELECT c_custkey,
    CASE WHEN c_custkey % 2 = 0 THEN '555-' || lpad(CAST(c_custkey % 10000000 AS VARCHAR), 7, '0') ELSE '+1 ' || CAST(c_custkey AS VARCHAR) END AS p
  FROM customer))""")
def phone_format(spark, sf_dir):
    k = F.col("c_custkey")
    raw = F.when(k % 2 == 0, F.concat(F.lit("555-"), F.lpad((k % 10000000).cast("string"), 7, "0"))).otherwise(F.concat(F.lit("+1 "), k.cast("string")))
    return T.table(spark, sf_dir, "customer").select("c_custkey", phone(raw).alias("phone"))


@query("""SELECT page_id,
    CASE WHEN upper(trim(w)) IN ('N/A', 'NA', 'NONE', 'NOT APPLICABLE', 'N.A.') THEN '' ELSE trim(w) END AS website
  FROM (SELECT page_id,
    CASE WHEN page_id % 5 = 0 THEN ' n/a ' ELSE url END AS w
  FROM pages)""")
def website_clean(spark, sf_dir):
    return T.table(spark, sf_dir, "pages").select("page_id", website(F.when(F.col("page_id") % 5 == 0, " n/a ").otherwise(F.col("url"))).alias("website"))


@query("""SELECT event_id,
    CASE WHEN regexp_full_match(y, '[0-9]+') THEN CAST(y AS INT) ELSE 0 END AS tax_year
  FROM (SELECT event_id,
    CASE WHEN event_id % 3 = 0 THEN '20x4' ELSE CAST(2000 + event_id % 25 AS VARCHAR) END AS y
  FROM events)""")
def year_parse(spark, sf_dir):
    raw = F.when(F.col("event_id") % 3 == 0, "20x4").otherwise((2000 + F.col("event_id") % 25).cast("string"))
    return T.table(spark, sf_dir, "events").select("event_id", year(raw).alias("tax_year"))


@query(f"""WITH {GRANTS} SELECT count(*) AS n,
    count(*) FILTER (WHERE state <> '') AS with_state,
    count(*) FILTER (WHERE amount IS NOT NULL) AS with_amount,
    count(*) FILTER (WHERE is_foreign = 1) AS abroad
  FROM g""")
def fill_rate_profile(spark, sf_dir):
    return T.grants(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(F.col("state") != "").alias("with_state"), F.count_if(F.col("amount").isNotNull()).alias("with_amount"), F.count_if(F.col("is_foreign") == 1).alias("abroad"))


@query(f"""WITH {SCORES}, {FILINGS}, l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY ein ORDER BY tax_year DESC) = 1), st AS (SELECT ein, string_agg(DISTINCT state, '; ' ORDER BY state) AS states FROM g WHERE is_foreign = 0 AND state <> '' GROUP BY ein)
SELECT u.ein, u.name, 'https://example.org/organizations/' || u.ein AS link, l.assets, l.ein IS NOT NULL AS data_found, coalesce(st.states, '') AS states_given, s.faith_alignment_score
FROM (SELECT {EIN.format('c_custkey', 'c_custkey')} AS ein, c_name AS name FROM customer) u LEFT JOIN l USING (ein) LEFT JOIN s USING (ein) LEFT JOIN st USING (ein)""")
def export_ranked(spark, sf_dir):
    u = T.universe(spark, sf_dir).select("ein", "name")
    l = latest_filing(spark, sf_dir).select("ein", "assets", F.lit(True).alias("hit"))  # noqa: E741
    g, named = grants_and_names(spark, sf_dir, "state", "is_foreign")
    s = faith.faith_scores(g, named).select("ein", "faith_alignment_score")
    joined = u.join(l, "ein", "left").join(s, "ein", "left").join(states_of(g), "ein", "left")
    out = joined.select("ein", "name", F.concat(F.lit("https://example.org/organizations/"), "ein").alias("link"), "assets", F.coalesce("hit", F.lit(False)).alias("data_found"), F.coalesce("states_given", F.lit("")).alias("states_given"), "faith_alignment_score")
    return out.orderBy(F.desc_nulls_last("faith_alignment_score"), "ein")


@query("SELECT page_id, link FROM (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '(?i)href=\"([^\"]+)\"', 1)) AS link FROM pages)")
def html_link_discovery(spark, sf_dir):
    return T.table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'(?i)href="([^"]+)"'), F.lit(1))).alias("link")).distinct()


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_tags(spark, sf_dir):
    return T.table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query(f"WITH {FILINGS} SELECT ein, tax_year, CASE WHEN tax_year >= 1998 THEN assets + 1 ELSE assets END AS assets FROM f")
def upsert_latest(spark, sf_dir):
    f = T.filings(spark, sf_dir).select("ein", "tax_year", "assets")
    return upsert(f, f.filter("tax_year >= 1998").withColumn("assets", F.col("assets") + 1), ["ein", "tax_year"])


@query(f"SELECT {EIN.format('c_custkey', 'c_custkey')} AS ein, c_name AS name FROM customer ORDER BY md5({EIN.format('c_custkey', 'c_custkey')} || ':42'), ein LIMIT 60")
def sample_fixed(spark, sf_dir):
    return fixed_sample(T.universe(spark, sf_dir), "ein", 60).select("ein", "name")


_TAG_WORDS = ["Church", "Churches", "Cathedral", "Ministries", "Baptist", "Bible Translation", "Bible", "Seminary", "Christian School", "Rescue Mission", "Missionary", "Gospel", "Evangelistic", "Church Plant", "Pregnancy Resource Center", "Young Life", "Chabad", "Salvation Army", "Christian", "Churchill", "Parishes", "Museum"]


@query(f"""SELECT p_partkey, array_to_string({sql_rules('name', vocab.RULES)}, '|') AS tags
  FROM (SELECT p_partkey, p_name || ' ' || ({sql_list(_TAG_WORDS)})[p_partkey % {len(_TAG_WORDS)} + 1] AS name
  FROM part)""")
def rule_tagged_names(spark, sf_dir):
    """All rules, on raw names in lower case."""
    k = F.col("p_partkey")
    name = F.concat("p_name", F.lit(" "), F.element_at(F.array(*map(F.lit, _TAG_WORDS)), (k % len(_TAG_WORDS) + 1).cast("int")))
    return T.table(spark, sf_dir, "part").select("p_partkey", F.array_join(faith.rule_tags(name), "|").alias("tags"))


def target_list(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(vocab.TARGETS)), "ordinal int, canonical string")


def written_targets(grants: DataFrame) -> DataFrame:
    """Grants whose recipients are target organisations as givers write them (longer, misspelt, reordered), or none at all."""
    h = F.crc32("grantee_name")
    target = F.element_at(F.array(*map(F.lit, vocab.TARGETS)), (h % len(vocab.TARGETS) + 1).cast("int"))
    kind = F.floor(h / len(vocab.TARGETS)) % 5
    written = (
        F.when(kind == 0, F.concat(F.lit("The "), target, F.lit(", Inc."))).when(kind == 1, F.concat(F.substring(target, 1, 4), F.substring(target, 6, 1000)))
        .when(kind == 2, F.array_join(F.reverse(F.split(target, " ")), " ")).when(kind == 3, F.upper(target)).otherwise(F.col("grantee_name"))
    )
    return grants.withColumn("grantee_name", written)


@query()
def matched_grantee_points(spark, sf_dir):
    """Points for grants to target organisations, found by their names as written."""
    g = staged(written_targets(T.grants(spark, sf_dir)).select("id", "ein", "grantee_name", "amount", "tax_year"), "written")
    return alignment.grantee_points(alignment.matched_grants(g, target_list(spark)), F.when(F.col("tax_year") >= 1997, 1.2).otherwise(1.0))


@query()
def target_match(spark, sf_dir):
    targets = target_list(spark)
    names = T.table(spark, sf_dir, "part").select(F.concat(F.element_at(F.array(*map(F.lit, vocab.TARGETS)), (F.col("p_partkey") % len(vocab.TARGETS) + 1).cast("int")), F.lit(" Inc of "), "p_brand").alias("name"))
    return match_targets(names, targets)


@query()
def fuzzy_match(spark, sf_dir):
    p = T.table(spark, sf_dir, "part").select("p_name").distinct()
    return fuzzy_pairs(p.select(F.concat("p_name", F.lit("s")).alias("name")), p.select(F.col("p_name").alias("candidate")))


@query(f"""SELECT {EIN.format('c_custkey', 'c_custkey')} AS ein,
    CASE WHEN c_custkey % 3 = 0 THEN 'Invite Only' WHEN c_custkey % 2 = 0 THEN 'Accepting Applications' ELSE '' END AS status
  FROM customer""")
def status(spark, sf_dir):
    k = F.col("ein").cast("long")
    return T.universe(spark, sf_dir).select("ein", application_status((k % 3 == 0).cast("int"), (k % 2 == 0).cast("int")).alias("status"))
