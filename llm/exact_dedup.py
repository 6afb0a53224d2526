"""Exact dedup (operator 1): a persistent digest index, bucketed and sorted by hash.

DataFrame functions only. Texts are equal when equal after deleting white space.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CHARS, one_row_each, staged, text_of


def default_buckets(spark: SparkSession) -> int:
    """As many as the session's shuffles have partitions, so that a batch is written with one file a bucket."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def normalised(column: str = "text") -> Column:
    return F.translate(text_of(column), SPACE_CHARS, "")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, chars (code points of the text as given), digest; ``row`` tells equal rows apart."""
    found = docs.select("doc_id", F.length(text_of()).cast("long").alias("chars"), F.sha2(normalised().cast("binary"), 256).alias("digest"))
    return staged(found.withColumn("row", F.monotonically_increasing_id()), "digests")


def create_index(spark: SparkSession, name: str | None = None, buckets: int | None = None) -> str:
    """An empty index, a table of the warehouse, bucketed and sorted by digest: digest, keep_id, chars, batch."""
    name = name or f"digest_index_{uuid.uuid4().hex}"
    _write(spark.createDataFrame([], "digest string, keep_id long, chars long, batch string"), name, buckets or default_buckets(spark), "error")
    return name


def _write(rows: DataFrame, index: str, buckets: int, mode: str) -> None:
    rows.write.format("parquet").mode(mode).bucketBy(buckets, "digest").sortBy("digest").saveAsTable(index)


@contextmanager
def _sorted_buckets(spark: SparkSession) -> Iterator[None]:
    """A bucket of one file, as ``compact`` leaves it, is read as sorted and not sorted anew."""
    key = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def compact(spark: SparkSession, index: str, buckets: int | None = None) -> str:
    """The index with one sorted file a bucket, under a new name; the old table goes.

    Buckets are read as they lie, so no rows are shuffled.
    """
    name = f"digest_index_{uuid.uuid4().hex}"
    _write(spark.table(index), name, buckets or default_buckets(spark), "error")
    spark.sql(f"DROP TABLE {index}")
    return name


def _groups(rows: DataFrame) -> DataFrame:
    """digest, best (the row that stays: most code points, then smallest doc_id, null last, then the first row), n."""
    best = F.min(F.struct((-F.col("chars")).alias("neg_chars"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("best")
    return rows.groupBy("digest").agg(best, F.count("*").alias("n"))


def _append(groups: DataFrame, index: str, batch: str, buckets: int) -> None:
    """Appends the digests that the index lacks, found by a sort-merge anti-join; a batch that comes again adds nothing."""
    spark = groups.sparkSession
    with _sorted_buckets(spark):
        fresh = groups.hint("merge").join(spark.table(index).select("digest").hint("merge"), "digest", "left_anti")
        new = staged(fresh.select("digest", F.col("best.doc_id").alias("keep_id"), (-F.col("best.neg_chars")).alias("chars"), F.lit(batch).alias("batch")), "new")
    _write(new.repartition(buckets, "digest"), index, buckets, "append")


def _decided(rows: DataFrame, groups: DataFrame, index: str, batches: list[str]) -> DataFrame:
    """What the index says about each row; a row of ``batches`` stays if the index took it up."""
    with _sorted_buckets(rows.sparkSession):
        held = rows.sparkSession.table(index).select("digest", "keep_id", "batch").hint("merge").join(groups.hint("merge"), "digest")
        first = F.when(F.col("batch").isin(batches), F.col("best.row")).alias("first_row")
        held = staged(held.select("digest", "keep_id", F.col("n").alias("group_size"), first), "decided")
    kept = F.coalesce(F.col("row") == F.col("first_row"), F.lit(False))
    return rows.join(held, "digest").select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"), "chars", "row")


def append_new(docs: DataFrame, index: str, batch: str | None = None, buckets: int | None = None) -> DataFrame:
    """Deduplicates docs against the index and within themselves, and appends what is new.

    One row of each digest that the index lacks is appended: of the most code points,
    then the smallest doc_id (null last), then the first row. ``batch`` names the docs: the
    same batch again, after a failure say, appends nothing and gets the same answer. Returns one
    row per document: doc_id, keep_id, group_size, kept, text_sha256, chars, row, where keep_id is the
    row that the index holds, perhaps from an earlier batch, and group_size counts
    the rows of this batch. Null text counts as empty, and all-white texts are equal to
    it; equal rows are copies, of which one is kept; more columns are not used; an
    empty table appends nothing and gives no rows; texts of any length are hashed whole.
    """
    batch = batch or uuid.uuid4().hex
    rows = digests(docs)
    groups = staged(_groups(rows), "groups")
    _append(groups, index, batch, buckets or default_buckets(docs.sparkSession))
    return _decided(rows, groups, index, [batch])


def exact_dedup(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """All docs through an index of their own, in two batches; columns and cases as in ``append_new``.

    Texts of at least the mean length come first. So of equal texts the longest is
    always in the batch that the index takes up, and the second batch meets a filled index.
    """
    spark = docs.sparkSession
    buckets = buckets or default_buckets(spark)
    rows = digests(docs)
    groups = staged(_groups(rows), "groups")
    mean = groups.agg(F.sum(-F.col("best.neg_chars") * F.col("n")) / F.sum("n")).first()[0] or 0.0
    index = create_index(spark, buckets=buckets)
    long = rows.filter(F.col("chars") >= mean)
    _append(_groups(long), index, "long", buckets)
    index = compact(spark, index, buckets)
    _append(_groups(rows.filter(F.col("chars") < mean)), index, "short", buckets)
    out = _decided(rows, groups, index, ["long", "short"])
    spark.sql(f"DROP TABLE {index}")
    return out


def without_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, all columns as they were.

    Cases as in ``append_new``. Of rows that share text, length and doc_id, null too, one
    stays: that with the smallest hash of its columns.
    """
    mine = exact_dedup(docs).filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    same = mine.groupBy("text_sha256", "keep_id", "chars").agg((F.count("*") > 1).alias("several"))
    kept = staged(same.groupBy("text_sha256", "keep_id").agg(F.max_by("several", "chars").alias("__tied"), F.max("chars").alias("chars")), "kept")
    tagged = docs.select(F.struct(*docs.columns).alias("__row"), F.sha2(normalised().cast("binary"), 256).alias("__digest"), F.length(text_of()).cast("long").alias("__chars"), F.col("doc_id").alias("__id"))
    # on all three, so that a large group of copies is not one key
    on = (F.col("__digest") == F.col("text_sha256")) & (F.col("__chars") == F.col("chars")) & F.col("__id").eqNullSafe(F.col("keep_id"))
    return one_row_each(tagged.join(kept, on), ["__digest"], "__tied", "__row")


SQL = r"""
WITH d AS (SELECT doc_id, CAST(length(coalesce(text, '')) AS BIGINT) AS chars,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
     r AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER w AS place
           FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, place = 1 AS kept, text_sha256 FROM r
"""
