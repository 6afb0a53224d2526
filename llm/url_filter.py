"""URL filters (operator 4): a blocked Bloom filter in front of an exact hash join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged

#: The filter has at most so many blocks of 512 bits (about 100 bytes each as a row), whatever
#: the list's length: a longer list only raises the share of false positives, which the join removes.
MAX_BLOCKS = 1 << 16
KEYS_PER_BLOCK = 32
#: A list of at most so many rules is broadcast to the join; of a longer one the rules that take
#: over 1 / HOT_RULES of all hits, fewer than HOT_RULES, are dealt out with salts.
BROADCAST_RULES = 100_000
HOT_RULES, SALTS = 1000, 16
BITS = 6

RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; '' if there is none."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(rest, upper, upper.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; '' if there is no host part."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _key(host: Column, path: Column) -> Column:
    return F.concat(host, path)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("block")), F.lit(blocks))


def _bits(key: Column) -> list[Column]:
    """The positions in a block, 0 to 511, that a key sets."""
    h = F.xxhash64(key, F.lit("bits"))
    return [F.shiftrightunsigned(h, 9 * i).bitwiseAND(F.lit(511)) for i in range(BITS)]


def _word_mask(key: Column, word: int) -> Column:
    """The bits that a key sets in one of the block's eight 64-bit words."""
    mask = F.lit(0).cast("long")
    for bit in _bits(key):
        inside = F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))
        mask = mask.bitwiseOR(F.when(F.floor(bit / 64) == word, inside).otherwise(F.lit(0).cast("long")))
    return mask


def bloom_blocks(keys: DataFrame, blocks: int) -> DataFrame:
    """One row for each block in use: block, w0 to w7."""
    k = F.col("key")
    return keys.select(_block(k, blocks).alias("block"), *(_word_mask(k, i).alias(f"w{i}") for i in range(8))).groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(8)))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url", max_blocks: int = MAX_BLOCKS, broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """Adds host, path, rule and verdict to pages: that of the longest rule that fits, else ``default``.

    rules: verdict, host, path (from the leading ``/``). A rule fits a url if the url's
    host is the rule's or a subdomain and its path starts with the rule's. Each distinct host
    and path is judged once: every host suffix with every path prefix of a length that occurs
    in the list is a key; keys that pass the filter meet the rules in a hash join, which
    decides. Null urls and urls without ``://`` have an empty host and path, which no rule fits;
    of rules listed twice, block wins; equal pages are judged alike; columns of pages named
    host, path, rule or verdict are replaced, others stay; urls of any length are judged whole;
    an empty table gives no rows and an empty list the default.
    """
    listed = staged(
        rules.select(F.lower("host").alias("rule_host"), "path", "verdict").filter("rule_host <> '' AND path IS NOT NULL").groupBy("rule_host", "path").agg(F.max("verdict").alias("rule_verdict"))
        .select(_key(F.col("rule_host"), F.col("path")).alias("key"), F.length("rule_host").alias("host_length"), F.length("path").alias("path_length"), "rule_verdict"),
        "rules",
    )
    n_rules = listed.count()
    # the distinct lengths of listed paths, not the paths
    lengths = [r[0] for r in listed.select("path_length").distinct().orderBy("path_length").collect()]
    blocks = max(1, min(max_blocks, -(-n_rules // KEYS_PER_BLOCK)))
    bloom = staged(bloom_blocks(listed.select("key").distinct(), blocks), "bloom")

    pages = pages.drop("rule", "verdict").withColumns({"__host": host_of(F.col(url)), "__path": path_of(F.col(url))}).withColumns({"host": F.col("__host"), "path": F.col("__path")}).drop("__host", "__path")
    labels = F.split("host", r"\.", -1)
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))
    wanted = F.filter(F.array(*(F.lit(x) for x in lengths)).cast(T.ArrayType(T.IntegerType())), lambda x: x <= F.length("path"))
    seen = pages.filter("host <> ''").select("host", "path").distinct()
    keys = seen.select("host", "path", F.explode(suffixes).alias("suffix"), wanted.alias("lengths")).filter("suffix <> ''").select("host", "suffix", "path", F.explode("lengths").alias("length"))
    keys = keys.select("host", "path", F.length("suffix").alias("host_length"), F.col("length").alias("path_length"), _key(F.col("suffix"), F.expr("substring(path, 1, length)")).alias("key"))

    # the filter has at most max_blocks rows: a bounded broadcast
    k = F.col("key")
    hits = keys.withColumn("block", _block(k, blocks)).join(F.broadcast(bloom), "block")
    for i in range(8):
        mask = _word_mask(k, i)
        hits = hits.filter(F.col(f"w{i}").bitwiseAND(mask) == mask)
    hits = hits.select("host", "path", "key", "host_length", "path_length")
    on = ["key", "host_length", "path_length"]
    if n_rules <= broadcast_rules:
        fits = hits.join(F.broadcast(listed), on)
    else:  # hosts under one rule may be many: they are spread over salted copies of that rule
        hits = staged(hits, "hits")
        hot = hits.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > hits.count() // HOT_RULES)
        # fewer than HOT_RULES rows, whatever the data: each has more than that share of the hits
        hot = F.broadcast(staged(hot.select("key", F.lit(True).alias("hot")), "hot"))
        copies = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        salted = listed.join(hot, "key", "left").withColumn("salt", F.explode(copies)).drop("hot")
        salt = F.when(F.col("hot"), F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int")).otherwise(0)
        fits = hits.join(hot, "key", "left").withColumn("salt", salt).drop("hot").join(salted, [*on, "salt"])
    rule = F.concat(F.expr("substring(key, 1, host_length)"), F.expr("substring(key, host_length + 1)"))
    best = fits.groupBy("host", "path").agg(F.max(F.struct((F.col("host_length") + F.col("path_length")).alias("size"), "host_length", rule.alias("rule"), "rule_verdict")).alias("best"))
    # staged, so that both sides of the join are plain exchanges and Spark can split a hot url
    best = staged(best.select("host", "path", "best.rule", "best.rule_verdict"), "judged")
    return pages.join(best, ["host", "path"], "left").withColumn("verdict", F.coalesce("rule_verdict", F.lit(default))).drop("rule_verdict").select(*(c for c in pages.columns), "rule", "verdict")


SQL = r"""
WITH rules(rv, rh, rp) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
     p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
     f AS (SELECT p.*, rv, rh || rp AS rule, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC NULLS LAST, length(rh) DESC) AS place
           FROM p LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM f WHERE place = 1
"""
