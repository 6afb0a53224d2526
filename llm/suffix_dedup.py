"""Suffix-array dedup (operator 8): a logarithmic family of suffix arrays in every shard."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import releasing, staged
from .repeats import SHARD_RUNS, _keyed, by_confirming, find_runs, find_spans, merged, run_texts

#: Bytes of a match, and of the grams that bring possible matches together.
WIDTH, GRAM = 200, 40
#: Suffixes that enter a shard's index as one batch.
BATCH = 32768


class LogIndex:
    """Suffix arrays, the largest first, each at least twice as long as the next.

    ``add`` sorts a new batch of suffixes (by the bytes that a match must have),
    scans it against every level for suffixes that agree, and appends it as a level; levels
    of a like size are then merged until sizes fall geometrically again.
    """

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, ids: np.ndarray, hit: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        keys, ids = keys[order], ids[order]
        same = keys[1:] == keys[:-1]
        hit[ids[1:][same]] = True
        hit[ids[:-1][same]] = True
        new = np.append(True, ~same)
        for held, of in self.levels:
            at = np.minimum(np.searchsorted(held, keys), len(held) - 1)
            same = held[at] == keys
            hit[ids[same]] = True
            hit[of[at[same]]] = True
            new &= ~same
        carry = keys[new], ids[new]
        while self.levels and len(self.levels[-1][0]) < 2 * len(carry[0]):
            held, of = self.levels.pop()
            at = np.searchsorted(held, carry[0])
            carry = np.insert(held, at, carry[0]), np.insert(of, at, carry[1])
        if len(carry[0]):
            self.levels.append(carry)


def confirm(keys: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Which windows occur twice: batch after batch enters one index.

    Of equal suffixes the index keeps the first, which is marked as soon as another comes.
    """
    hit, index = np.zeros(len(keys), bool), LogIndex()
    for a in range(0, len(keys), BATCH):
        ids = np.arange(a, min(a + BATCH, len(keys)))
        index.add(keys[ids], ids, hit)
    return hit


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, removed, count, kept = [], [], [], []
        texts, covered = [], []
        for text, spans in zip(batch.column(1), batch.column(2)):
            raw = text.as_py().encode("utf-8", "surrogatepass")
            cut = merged(spans.as_py())
            rest = raw if not cut else b"".join(raw[a:b] for a, b in zip([0, *(e for _, e in cut)], [*(s for s, _ in cut), len(raw)]))
            n.append(len(raw))
            removed.append(len(raw) - len(rest))
            count.append(len(cut))
            kept.append(hashlib.sha256(rest).hexdigest())
            texts.append(rest)
            covered.append([{"a": a, "b": b} for a, b in cut])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.string()), pa.array(texts, pa.binary()), pa.array(covered, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"],
        )


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, shard_runs: int = SHARD_RUNS) -> DataFrame:
    """Cuts every byte covered by a ``width``-byte string that also starts anywhere else.

    docs: doc_id, text, and any more columns, which are not used. Returns one row
    per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes
    left, which may break a character) and spans. Null and empty texts have 0
    bytes and spans; texts shorter than ``width`` are never cut; equal rows are
    copies of each other and both go; an empty table gives no rows; very long texts are searched
    whole, in slices. Candidate stretches meet in shards; each shard's index takes their suffixes in batches.
    """
    return _cut_out(docs, width, gram, shard_runs, None)


def _cut_out(docs: DataFrame, width: int, gram: int, shard_runs: int, held: DataFrame | None) -> DataFrame:
    keyed, spans = find_spans(docs, "bytes", width, gram, by_confirming(confirm), shard_runs=shard_runs, held=held)
    joined = keyed.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans")
    kind = dict(docs.dtypes)["doc_id"]
    return joined.mapInArrow(releasing(_clean), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<a:int,b:int>>")


def levels(spark: SparkSession, index: str) -> list[str]:
    """The tables of an index, the largest first."""
    names = [t.name for t in spark.catalog.listTables() if t.name.startswith(f"{index}_level_")]
    return sorted(names, key=lambda n: (-spark.table(n).count(), n))


def _write_level(runs: DataFrame, index: str, n: int) -> None:
    spark = runs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs.write.format("parquet").bucketBy(buckets, "anchor").sortBy("anchor").saveAsTable(f"{index}_level_{n}")


def _merge(spark: SparkSession, index: str) -> None:
    """Merges the two smallest levels until each is at least twice as large as the next."""
    while len(names := levels(spark, index)) > 1:
        large, small = names[-2:]
        if spark.table(large).count() >= 2 * spark.table(small).count():
            break
        number = 1 + max(int(n.rsplit("_", 1)[1]) for n in names)
        _write_level(spark.table(large).unionByName(spark.table(small)), index, number)
        for n in (large, small):
            spark.sql(f"DROP TABLE {n}")


def remove_known(docs: DataFrame, index: str, batch: str, width: int = WIDTH, gram: int = GRAM, shard_runs: int = SHARD_RUNS) -> DataFrame:
    """As ``remove_repeats`` for a new batch of documents: what earlier batches hold counts as occurring elsewhere too.

    The index is a family of tables in the warehouse, each a level: the distinct stretches of its batches with
    their anchors, bucketed and sorted by them. The new batch is scanned against all levels: stretches that
    share an anchor meet in shards, where suffix arrays compare them as bytes. Then the batch
    becomes a level, and levels of a like size are merged, so that there are few. A batch that
    comes again, after a failure say, gets the same answer and is not added twice. Cases as in ``remove_repeats``.
    """
    spark = docs.sparkSession
    held = None
    for name in levels(spark, index):
        table = spark.table(name)
        held = table if held is None else held.unionByName(table)
    there = held is not None and not held.filter(F.col("batch") == batch).isEmpty()
    out = staged(_cut_out(docs, width, gram, shard_runs, held.filter(F.col("batch") != batch) if held is not None else None), "cut")
    if not there:
        keyed = _keyed(docs)
        runs = find_runs(keyed, "bytes", width, gram).groupBy("anchor", "fragment").agg(F.min(F.struct("k1", "k2", "first", "last")).alias("at"))
        place = [F.lit(0).cast("long").alias("shard"), F.lit(0).alias("salt"), "anchor", "fragment", F.lit(1).alias("ways")]
        texts = run_texts(keyed, runs.select("at.k1", "at.k2", F.struct(*place, "at.first", "at.last").alias("run")), "bytes", width)
        numbers = [int(n.rsplit("_", 1)[1]) for n in levels(spark, index)]
        _write_level(texts.select("anchor", "fragment", "body", F.lit(batch).alias("batch")), index, 1 + max(numbers, default=-1))
        _merge(spark, index)
    return out
