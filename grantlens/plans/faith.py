"""The recipient knowledge base and the Faith Alignment Score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions.text import normalized, tiered


def rule_tags(name: Column, rules: list = vocab.RULES) -> Column:
    hits = [F.when(F.lower(name).rlike(r), F.array(*map(F.lit, tags))).otherwise(F.array().cast("array<string>")) for r, tags in rules]
    return F.array_distinct(F.concat(*hits))


def largest_by_name(grants: DataFrame) -> DataFrame:
    """grantee_name, m (its largest amount), name_norm of each distinct name: the only pass over the grants that the knowledge base needs."""
    return grants.filter("grantee_name <> ''").groupBy("grantee_name").agg(F.max("amount").alias("m")).withColumn("name_norm", normalized(F.col("grantee_name")))


def knowledge_base(grants: DataFrame, rules: list = vocab.RULES, seeds: DataFrame | None = None) -> DataFrame:
    """name_norm, display_name, max_grant, tags, source: each distinct recipient once.

    The raw name with the largest grant stands for its normal form, ties to the
    smaller name. seeds (name_norm, seed_tags) go before rules.
    """
    return knowledge_base_of(largest_by_name(grants), rules, seeds)


def knowledge_base_of(names: DataFrame, rules: list = vocab.RULES, seeds: DataFrame | None = None) -> DataFrame:
    """``knowledge_base`` from what ``largest_by_name`` gives."""
    best = names.filter("name_norm <> ''").groupBy("name_norm").agg(F.min(F.struct((-F.coalesce("m", F.lit(0))).alias("neg"), "grantee_name")).alias("b"))
    kb = best.select("name_norm", F.col("b.grantee_name").alias("display_name"), (-F.col("b.neg")).alias("max_grant")).withColumn("rule_tags", rule_tags(F.col("display_name"), rules))
    kb = kb.join(seeds, "name_norm", "left") if seeds is not None else kb.withColumn("seed_tags", F.lit(None).cast("array<string>"))
    source = F.when(F.col("seed_tags").isNotNull(), "seed").when(F.size("rule_tags") > 0, "rule").otherwise("pending")
    return kb.select("name_norm", "display_name", "max_grant", F.coalesce("seed_tags", "rule_tags").alias("tags"), source.alias("source"))


def confident(tags: Column, least: int = vocab.CONFIDENCE_MIN) -> Column:
    return F.array_distinct(F.transform(F.filter(tags, lambda t: F.coalesce(t["confidence"], F.lit(0.0)) >= least), lambda t: t["name"]))


def tags_of_names(names: DataFrame, kb: DataFrame) -> DataFrame:
    """grantee_name, tags of distinct names (grantee_name, name_norm)."""
    return names.select("grantee_name", "name_norm").join(kb.select("name_norm", "tags"), "name_norm").select("grantee_name", "tags")


def tagged_grants(grants: DataFrame, named: DataFrame) -> DataFrame:
    """Grants with their recipient's tags (of ``tags_of_names``), none for unknown names."""
    return grants.join(named, "grantee_name", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def faith_scores(grants: DataFrame, named: DataFrame) -> DataFrame:
    """One row for each giver with a positive total, from grants and the tags of their names.

    What a tag set counts for is decided once a name; grants are summed up by giver and year, then by giver.
    """
    parts = [f"c{i}" for i in range(len(vocab.COMPONENTS))]
    flags = named.select("grantee_name", *(F.arrays_overlap("tags", F.array(*map(F.lit, tags))).alias(c) for c, (_, tags) in zip(parts, vocab.COMPONENTS)), F.arrays_overlap("tags", F.array(*map(F.lit, vocab.FAITH_TAGS))).alias("faith"))
    rows = grants.select("ein", "grantee_name", "amount", F.coalesce("tax_year", F.lit(-1)).alias("tax_year")).join(flags, "grantee_name", "left")
    given = lambda c: F.sum(F.when(F.col(c), F.col("amount")).otherwise(0)).alias(c)
    years = rows.groupBy("ein", "tax_year").agg(F.sum("amount").alias("total"), F.max(F.coalesce("faith", F.lit(False))).alias("any"), given("faith"), *(given(c) for c in parts))
    by = years.groupBy("ein").agg(
        F.sum("total").alias("total_giving"), F.sum("faith").alias("faith_giving"), F.count("*").alias("years_of_giving"), F.count_if("any").alias("years_of_faith_giving"), *(F.sum(c).alias(c) for c in parts)
    ).filter("total_giving > 0")
    raw = None
    for i, (weight, _) in enumerate(vocab.COMPONENTS):
        part = F.lit(weight) * (F.col(f"c{i}") / F.col("total_giving"))
        raw = part if raw is None else raw + part
    raw = raw + F.lit(vocab.CONSISTENCY) * (F.col("years_of_faith_giving") / F.col("years_of_giving"))
    score = F.least(F.bround(raw), F.lit(100.0)).cast("int")
    return by.withColumn("faith_alignment_score", score).select(
        "ein", "faith_alignment_score", tiered(F.col("faith_alignment_score"), vocab.TIERS).alias("faith_tier"), tiered(F.col("faith_alignment_score"), vocab.STARS).alias("faith_stars"),
        F.bround(100.0 * F.col("faith_giving") / F.col("total_giving"), 1).alias("christian_giving_pct"), "years_of_faith_giving", "years_of_giving", "total_giving", "faith_giving",
    )


def faith_categories(tagged: DataFrame) -> DataFrame:
    """ein, faith_categories: faith tags by dollars, ties by name."""
    tags = F.array_intersect("tags", F.array(*map(F.lit, vocab.FAITH_TAGS)))
    by = tagged.select("ein", "amount", F.explode(tags).alias("tag")).groupBy("ein", "tag").agg(F.sum("amount").alias("s"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("neg"), "tag")))
    return by.groupBy("ein").agg(listed.alias("l")).select("ein", F.array_join(F.transform("l", lambda x: x["tag"]), "; ").alias("faith_categories"))
