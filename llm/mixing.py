"""Mixing sources to target weights (operator 2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, staged, text_of

#: Weights that sources get in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: Words of the mix as a share of all words, and the most that a source is repeated.
TOTAL, MOST = 1.5, 2.0
SEED = "mix-1"
#: Above so many sources their table is joined by a shuffle.
BROADCAST_SOURCES = 50_000


def word_count(column: str = "text") -> Column:
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def uniform(seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the seed, doc_id (null as empty) and text only: 48 bits of an MD5."""
    text = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text_of().cast("binary")))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """Adds target to source, source_size: shares by weight, none above ``most`` times its size.

    The excess of capped sources goes to the others by weight. In the order of
    size for weight, capped sources come first: with C words in the caps before a
    source and W the weights from it on, the level is (budget - C) / W at the first source whose
    cap lies above it. One row for each source meets in one task here.
    """
    names = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.row_number().over(names) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("cap", F.lit(most) * F.col("source_size"))
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    budget = F.lit(total) * F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    level = (budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    leveled = ranked.withColumn("level", level).withColumn("free", F.col("cap") >= F.col("level") * F.col("weight"))
    everywhere = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.min(F.when(F.col("free"), F.col("cap") / F.col("weight"))).over(everywhere)
    chosen = F.min(F.when(F.col("free") & (F.col("cap") / F.col("weight") == first), F.col("level"))).over(everywhere)
    return leveled.select("source", "source_size", F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least("cap", F.coalesce(chosen, F.lit(0.0)) * F.col("weight"))).alias("target"))


def _copied(sized: DataFrame, weights: tuple, total: float, most: float) -> DataFrame:
    """Adds source_size, target and copies to rows with source, size and draw."""
    sources = staged(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, total, most), "sources")
    small = sources.count() <= BROADCAST_SOURCES
    side = sources.select(F.col("source").alias("__source"), "source_size", "target")
    joined = sized.join(F.broadcast(side) if small else side, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor("rate")
    extra = (F.col("draw") < F.col("rate") - whole).cast("long")
    return joined.withColumn("rate", rate).withColumn("copies", whole + extra).drop("rate")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, total: float = TOTAL, most: float = MOST, seed: str = SEED) -> DataFrame:
    """Adds size, source_size, target, copies and taken to doc_id, source.

    A source's rate is its target over its size; a document is emitted floor(rate)
    times and once more if its hash, of doc_id and text, falls below the fraction. Null and
    empty texts have size 0 and take no words; null source is a source of its own; documents that
    share a doc_id, or have none, draw by their texts; equal rows fare alike; more columns are not
    used; texts of any length count whole; an empty table gives no rows.
    """
    sized = staged(docs.select("doc_id", "source", word_count().alias("size"), uniform(seed).alias("draw")), "sized")
    return _copied(sized, weights, total, most).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def emit(docs: DataFrame, weights: tuple = WEIGHTS, total: float = TOTAL, most: float = MOST, seed: str = SEED) -> DataFrame:
    """The mixed documents themselves, copies as rows of their own, all columns as they were.

    Cases as in ``mix``: each row takes the copies of its own source, doc_id and text,
    whatever other rows share its doc_id.
    """
    row = docs.select(F.struct(*docs.columns).alias("__row"), "source", word_count().alias("size"), uniform(seed).alias("draw"))
    copied = _copied(row, weights, total, most).filter("copies > 0")
    return copied.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("__row.*")


SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(text, '')) AS digest FROM documents),
     s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
     w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
     l AS (SELECT *, (1.5::DOUBLE * (SELECT CAST(sum(source_size) AS DOUBLE) FROM s) - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
                     / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
     c AS (SELECT level AS chosen FROM l WHERE cap >= level * weight ORDER BY cap / weight, level LIMIT 1),
     t AS (SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0::DOUBLE ELSE least(cap, coalesce((SELECT chosen FROM c), 0.0::DOUBLE) * weight) END AS target FROM l),
     r AS (SELECT d.doc_id, d.size, d.digest, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       size * (CAST(floor(rate) AS BIGINT) + CASE WHEN CAST(('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || digest), 1, 12)) AS BIGINT)::DOUBLE / 281474976710656.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END) AS taken
FROM r
"""
