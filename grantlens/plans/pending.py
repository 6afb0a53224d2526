"""Recipients that no seed or rule tags: whom to ask about, what a classifier replies, and how its tags are applied."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..functions.text import normalized, reply_array
from .faith import confident

TAGS = "array<struct<name:string,confidence:double>>"
#: From names, one batch at a time, to a reply that holds a JSON array, one entry for each name.
Classifier = Callable[[list[str]], str]


def seed_table(spark: SparkSession, seeds: dict[str, list[str]] = vocab.SEEDS) -> DataFrame:
    """name_norm, seed_tags: known recipients, some dozens. Of names with one normal form the last in the list counts."""
    rows = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(seeds.items())], "place int, name string, seed_tags array<string>")
    best = rows.withColumn("name_norm", normalized(F.col("name"))).groupBy("name_norm").agg(F.max_by("seed_tags", "place").alias("seed_tags"))
    return F.broadcast(best)


def to_classify(kb: DataFrame, least: int = vocab.CLASSIFY_MIN_GRANT, limit: int | None = None) -> DataFrame:
    """Pending recipients with a grant of ``least`` or more, the largest first."""
    found = kb.filter(F.col("source") == "pending").filter(F.col("max_grant") >= least).orderBy(F.desc("max_grant"), "name_norm")
    return found.limit(limit) if limit else found


def classify(todo: DataFrame, classifier: Classifier | None, batch: int = vocab.CLASSIFY_BATCH) -> DataFrame:
    """display_name, tags for the names of todo (display_name); none without a classifier.

    Names go out in batches; replies are matched by place, so that a short reply leaves
    the last names pending. A failing batch ends its partition's work: these names stay pending too.
    Tags that are not in the vocabulary are dropped.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            names = f["display_name"].tolist()
            for i in range(0, len(names), batch):
                asked = names[i : i + batch]
                try:
                    reply = classifier(asked)
                except Exception:  # whatever a service may raise
                    return
                yield pd.DataFrame({"names": [asked], "reply": [reply]})

    if classifier is None:
        return todo.sparkSession.createDataFrame([], f"display_name string, tags {TAGS}")
    items = F.from_json(reply_array(F.col("reply")), f"array<struct<tags:{TAGS}>>")
    pairs = todo.select("display_name").mapInPandas(run, "names array<string>, reply string").select(F.explode(F.arrays_zip(F.col("names").alias("n"), items.alias("r"))).alias("x"))
    known = F.filter(F.coalesce(F.col("x.r.tags"), F.array().cast(TAGS)), lambda t: t["name"].isin(vocab.FAITH_TAGS + vocab.SECULAR_TAGS))
    return pairs.filter(F.col("x.n").isNotNull() & F.col("x.r").isNotNull()).select(F.col("x.n").alias("display_name"), known.alias("tags"))


def apply_cache(kb: DataFrame, cache: DataFrame, least: int = vocab.CLASSIFY_MIN_GRANT) -> DataFrame:
    """Pending recipients take the confident tags of the cache (display_name, tags), with source llm."""
    side = cache.select("display_name", confident(F.col("tags")).alias("__tags"))
    hit = (F.col("source") == "pending") & (F.col("max_grant") >= least) & F.col("__tags").isNotNull()
    joined = kb.join(side, "display_name", "left")
    return joined.select(*(F.when(hit, F.col("__tags")).otherwise(F.col("tags")).alias("tags") if c == "tags" else F.when(hit, "llm").otherwise(F.col("source")).alias("source") if c == "source" else c for c in kb.columns))


def classify_pending(kb: DataFrame, cache: DataFrame, classifier: Classifier | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(knowledge base with tags applied, the new entries for the cache): only names that the cache lacks are asked about."""
    todo = to_classify(kb, limit=limit).join(cache.select("display_name"), "display_name", "left_anti")
    new = classify(todo, classifier)
    return apply_cache(kb, cache.unionByName(new)), new


def source_counts(kb: DataFrame) -> DataFrame:
    return kb.groupBy("source").agg(F.count("*").alias("n"))
