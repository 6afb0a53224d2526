"""Alignment points (grantees, keywords, international, focus) and the opportunity score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions.text import amount
from ..operators.matching import THRESHOLD, match_targets
from ..sources.scratch import staged


def keyword_hits(text: Column, keywords: list[str]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    tests = []
    for k in keywords:
        plain = low.contains(k.lower()) if k in vocab.COMPOUNDS else F.lit(False)
        tests.append(F.when(plain | low.rlike(rf"\b{k.lower()}(s|es|ing|al)?\b"), F.lit(k)))
    return F.filter(F.array(*tests), lambda x: x.isNotNull())


def joined_texts(rows: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """key, text: all non-empty texts of a key in order, with a space between them, so that a phrase may run over rows."""
    some = rows.filter(F.col(text) != "").groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("l"))
    return some.select(key, F.array_join(F.transform("l", lambda x: x["t"]), " ").alias("text"))


def field_texts(names: DataFrame, purposes: DataFrame, activities: DataFrame) -> DataFrame:
    """ein, text, weight: an entity's name, and all its purposes and all its activities (ein, text each), by what a keyword in them counts."""
    parts = {"name": names, "purposes": purposes, "activities": activities}
    texts = [df.select("ein", "text", F.lit(vocab.FIELD_WEIGHTS[f]).alias("weight")) for f, df in parts.items()]
    return texts[0].unionAll(texts[1]).unionAll(texts[2])


def keyword_hits_by_key(texts: DataFrame, clusters: dict[str, list[str]] = vocab.CLUSTERS) -> DataFrame:
    """ein, k, w from texts (ein, text, weight): each keyword with its largest weight. Each distinct text is searched once."""
    words = [k for ks in clusters.values() for k in ks]
    found = texts.select("text").distinct().select("text", F.explode(keyword_hits(F.col("text"), words)).alias("k"))
    return texts.distinct().join(found, "text").groupBy("ein", "k").agg(F.max("weight").alias("w"))


def keyword_points(texts: DataFrame, clusters: dict[str, list[str]] = vocab.CLUSTERS) -> DataFrame:
    """ein, keyword_points, keyword_matches, keyword_match_count from texts (ein, text, weight): each keyword counts once, with its largest weight.

    For phrases that run over rows give ``joined_texts``.
    """
    cluster = F.create_map(*(F.lit(x) for c, ks in clusters.items() for k in ks for x in (k, c)))
    by = keyword_hits_by_key(texts, clusters).groupBy("ein").agg(F.sum("w").alias("p"), F.count_distinct(F.element_at(cluster, F.col("k"))).alias("n"), F.array_sort(F.collect_set("k")).alias("found"))
    points = F.least(F.col("p") + F.when(F.col("n") >= 3, 5).when(F.col("n") == 2, 3).otherwise(0), F.lit(30))
    return by.select("ein", points.cast("long").alias("keyword_points"), F.array_join("found", "; ").alias("keyword_matches"), F.size("found").alias("keyword_match_count"))


def international_points(grants: DataFrame) -> DataFrame:
    by = grants.groupBy("ein").agg(F.count("*").alias("n"), F.count_if(F.col("is_foreign") == 1).alias("f"), F.count_distinct(F.when((F.col("is_foreign") == 1) & (F.col("country") != ""), F.col("country"))).alias("c"))
    points = F.when(F.col("f") > 0, 10).otherwise(0) + F.when(F.col("f") / F.col("n") > 0.25, 8).otherwise(0) + F.when(F.col("c") >= 2, 7).otherwise(0)
    return by.select("ein", points.cast("long").alias("international_points"))


def _any_of(text: Column, terms: list[str]) -> Column:
    return F.greatest(*(text.contains(t).cast("int") for t in terms), F.lit(0))


def _terms_in(text: Column, terms: list[str]) -> list[Column]:
    return [F.max(text.contains(t).cast("int")).alias(f"t{i}") for i, t in enumerate(terms)]


def _share(terms: list[str]) -> Column:
    text = F.lower(F.concat_ws(" ", F.coalesce("grantee_name", F.lit("")), F.coalesce("purpose", F.lit(""))))
    return F.avg(_any_of(text, terms)).alias("share")


def _focus(faith: list[str], abroad: list[str]) -> Column:
    total = lambda a, b: sum((F.coalesce(f"t{i}", F.lit(0)) for i in range(a, b)), F.lit(0))
    said = F.least(total(0, len(faith)), F.lit(4)) + F.least(total(len(faith), len(faith) + len(abroad)), F.lit(3))
    return F.least(said + F.when(F.col("share") > 0.5, 3).otherwise(0), F.lit(10)).cast("long").alias("focus_points")


def focus_points(grants: DataFrame, activities: DataFrame, faith: list[str] = vocab.FAITH_TERMS, abroad: list[str] = vocab.ABROAD_TERMS) -> DataFrame:
    """ein, focus_points: terms in all a giver's activities (ein, text) together, and the share of its grants with any."""
    terms = activities.groupBy("ein").agg(*_terms_in(F.lower("text"), faith + abroad))
    return terms.join(grants.groupBy("ein").agg(_share(faith + abroad)), "ein", "full").select("ein", _focus(faith, abroad))


def focus_of_grants(grants: DataFrame, faith: list[str] = vocab.FAITH_TERMS, abroad: list[str] = vocab.ABROAD_TERMS) -> DataFrame:
    """The same where the grants' purposes are the activities: one aggregation."""
    return grants.groupBy("ein").agg(*_terms_in(F.lower("purpose"), faith + abroad), _share(faith + abroad)).select("ein", _focus(faith, abroad))


def matched_grants(grants: DataFrame, targets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The grants (grantee_name, and any columns) whose recipient is a target (canonical, ordinal), with its ``canonical`` name.

    Each distinct name is scored once. What matched is staged, so that both sides of the join are plain
    exchanges and Spark can split a name that very many grants share.
    """
    found = match_targets(grants.select(F.col("grantee_name").alias("name")), targets, threshold)
    found = staged(found.select(F.col("name").alias("grantee_name"), "canonical"), "matched_names")
    return grants.join(found, "grantee_name")


def grantee_points(matched: DataFrame, recency: Column) -> DataFrame:
    """ein, grantee_points, grantee_matches, grantee_match_count from matched grants (id, ein, canonical, amount).

    Many orgs give diminishing points, large ones a bonus. Orgs are listed in the order of their first grant (of one id, by name).
    """
    best = matched.groupBy("ein", "canonical").agg(F.max(F.col("amount") * recency).alias("m"), F.min("id").alias("first"))
    listed = F.array_sort(F.collect_list(F.struct("first", "canonical")))
    by = best.groupBy("ein").agg(F.count("*").alias("n"), F.count_if(F.col("m") > 25000).alias("large"), listed.alias("l"))
    base = F.when(F.col("n") == 1, 12).when(F.col("n") == 2, 20).when(F.col("n") == 3, 26).otherwise(30 + 2 * (F.col("n") - 4))
    points = F.least(base + F.least(2 * F.col("large"), F.lit(5)), F.lit(35)).cast("long")
    return by.select("ein", points.alias("grantee_points"), F.array_join(F.transform("l", lambda x: x["canonical"]), "; ").alias("grantee_matches"), F.col("n").alias("grantee_match_count"))


def opportunity(alignment: Column, grant: Column) -> Column:
    a, size = amount(grant), F.lit(0)
    for cut, points in reversed(vocab.GRANT_SIZES):
        size = F.when(a >= cut, points).otherwise(size)
    return F.least(F.floor(alignment / 100 * 60 + size), F.lit(100)).cast("long")


def alignment(eins: DataFrame, grantees: DataFrame, keywords: DataFrame, abroad: DataFrame, focus: DataFrame) -> DataFrame:
    """ein, alignment_score of eins: the four kinds of points, 100 at most; keyword columns and gives_internationally with them."""
    joined = eins.select("ein").distinct().join(grantees, "ein", "left").join(keywords, "ein", "left").join(abroad, "ein", "left").join(focus, "ein", "left")
    points = [F.coalesce(c, F.lit(0)) for c in ("grantee_points", "keyword_points", "international_points", "focus_points")]
    total = F.least(points[0] + points[1] + points[2] + points[3], F.lit(100))
    return joined.select(
        "ein", total.alias("alignment_score"), F.coalesce("grantee_matches", F.lit("")).alias("grantee_matches"), F.coalesce("grantee_match_count", F.lit(0)).alias("grantee_match_count"), F.coalesce("keyword_matches", F.lit("")).alias("keyword_matches"), F.coalesce("keyword_match_count", F.lit(0)).alias("keyword_match_count"),
        F.when(points[2] > 0, "Yes").otherwise("No").alias("gives_internationally"),
    )


def score_batch(rows: DataFrame, matched: DataFrame, scores: DataFrame) -> DataFrame:
    """Each row (name, city, state, grant_amount) with its entity's scores, the best opportunity first, then by name.

    Rows without a match have no ein and alignment 0, but an opportunity from their amount.
    """
    place = [F.coalesce(c, F.lit("")).alias(c) for c in ("city", "state")]
    found = rows.select("name", *place, "grant_amount").join(matched.select("name", "city", "state", "ein"), ["name", "city", "state"], "left").join(scores, "ein", "left")
    score = F.coalesce("alignment_score", F.lit(0))
    return found.select(
        "name", "city", "state", F.coalesce("ein", F.lit("")).alias("ein"), F.col("ein").isNotNull().alias("data_found"), score.alias("alignment_score"),
        opportunity(score.cast("double"), F.col("grant_amount")).alias("opportunity_score"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("grantee_matches", "keyword_matches", "gives_internationally")),
    ).orderBy(F.desc("opportunity_score"), "name", "city", "state")
