"""Sharding (operator 13): minimax contiguous partition of groups of equal texts.

DataFrame functions only. Groups lie in the order of their texts' digests. The smallest capacity with which greedy
filling needs no more than the wanted shards is searched for, and the groups are cut where that filling
cuts; so a document's shard follows from its digest and 15 cuts, without a join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, text_of
from .ranks import ranked

SHARDS = 16
#: Capacities that one round of the search tries at a time.
TRIES = 64
#: Groups in one bucket of the running sum (on average).
BUCKET = 1 << 16


@dataclass
class Cuts:
    """capacity: bytes of the largest shard, the least possible; ends: bytes up to each cut; digests: the last digest before each cut."""

    capacity: int
    ends: list[int]
    digests: list[str]


def text_digest() -> Column:
    return F.sha2(text_of().cast("binary"), 256)


def text_size() -> Column:
    return (F.octet_length(text_of()) + 1).cast("long")


def running_sizes(sized: DataFrame) -> DataFrame:
    """digest, size, end of each group, where end is the running sum of sizes in the order of digests.

    Sums go first by buckets of the digest's leading bits, which spread evenly over groups, whatever their sizes.
    """
    groups = staged(sized.groupBy("digest").agg(F.sum("size").alias("size")), "groups")
    bits = max(0, min(30, (groups.count() // BUCKET).bit_length()))
    groups = groups.withColumn("bucket", F.shiftright(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"), 32 - bits))
    sums = groups.groupBy("bucket").agg(F.sum("size").alias("bytes"))
    ahead = F.sum("bytes").over(Window.partitionBy(F.lit(0)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    base = sums.select("bucket", F.coalesce(ahead, F.lit(0)).alias("base"))
    within = F.sum("size").over(Window.partitionBy("bucket").orderBy("digest").rowsBetween(Window.unboundedPreceding, 0))
    ends = groups.withColumn("within", within).join(base, "bucket").select("digest", "size", (F.col("base") + F.col("within")).alias("end"))
    # in order on disk: a probe for an end then reads few row groups
    return staged(ends.repartitionByRange("end").sortWithinPartitions("end"), "ends")


def _filled(ends: DataFrame, capacities: list[int], total: int, shards: int) -> list[list[int]]:
    """Where greedy filling with each capacity cuts, one probe of all capacities a shard."""
    paths = [[0] for _ in capacities]
    for _ in range(shards):
        if all(p[-1] == total for p in paths):
            break
        limits = [min(p[-1] + c, total) for p, c in zip(paths, capacities)]
        near = ends.filter((F.col("end") > min(p[-1] for p in paths)) & (F.col("end") <= max(limits)))
        found = near.agg(*(F.max(F.when(F.col("end") <= x, F.col("end"))).alias(f"c{i}") for i, x in enumerate(limits))).first()
        for p, end in zip(paths, found):
            p.append(p[-1] if end is None else max(end, p[-1]))
    return paths


def minimax_cuts(ends: DataFrame, shards: int = SHARDS, tries: int = TRIES) -> Cuts:
    """The cuts of the smallest capacity; ``ends`` as from ``running_sizes``.

    No capacity below an even share or the largest group will do, and that share and
    the largest group together always do. A round tries capacities evenly spread over what is left.
    """
    total, largest = ends.agg(F.max("end"), F.max("size")).first()
    if not total:
        return Cuts(0, [], [])
    low = max(-(-total // shards), largest)
    high, best = min(total, low + largest), None
    while low < high or best is None:
        step = max(1, -(-(high - low + 1) // tries))
        capacities = [*range(low, high, step), high]
        paths = _filled(ends, capacities, total, shards)
        first = next(i for i, p in enumerate(paths) if p[-1] == total)
        best, high = paths[first], capacities[first]
        low = capacities[first - 1] + 1 if first else high
    inner = [x for x in best[1:] if x < total]
    last = ends.filter(F.col("end").isin(inner)).select("end", "digest").orderBy("end").collect() if inner else []
    return Cuts(high, [r.end for r in last], [r.digest for r in last])


def shard_of(digest: Column, cuts: Cuts) -> Column:
    """The number of cuts before a digest."""
    return sum((F.when(digest > cut, 1).otherwise(0) for cut in cuts.digests), F.lit(0)).cast("int")


def _sized(docs: DataFrame) -> DataFrame:
    flat = docs.select("doc_id", text_size().alias("size"), F.crc32(text_of().cast("binary")).alias("text_crc32"), text_digest().alias("digest"))
    return staged(flat.withColumn("row", F.monotonically_increasing_id()), "sized")


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, digest, shard, slot of each document.

    Size: UTF-8 bytes of the text (null as empty) and 1. Equal texts are one group and share a shard, however large
    the group; the largest shard is as small as any cut of the groups' order allows. Slots count from 0 in each shard, in the
    order of digest, then doc_id (null first); rows equal in both are documents of their own with a slot each. With fewer
    groups than shards the last shards stay empty; an empty table gives no rows; texts of any length are
    hashed whole; more columns are not used.
    """
    sized = _sized(docs)
    cuts = minimax_cuts(running_sizes(sized), shards)
    placed = ranked(sized.withColumn("shard", shard_of(F.col("digest"), cuts)), ["shard"], ["digest", "doc_id", "row"], "slots")
    return placed.select("doc_id", "size", "text_crc32", "digest", "shard", F.col("place").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> Cuts:
    """Writes the documents, all columns as they were, below path in one folder a shard (``__shard=0`` and so on); cases as in ``assign``.

    The cuts say where another document's text would go.
    """
    cuts = minimax_cuts(running_sizes(_sized(docs.select("doc_id", "text"))), shards)
    docs.withColumn("__shard", shard_of(text_digest(), cuts)).write.partitionBy("__shard").mode("overwrite").parquet(path)
    return cuts


_STEP = "lambda c, b: xor(c >> 8, crc_table.t[1 + (xor(c, b) & 255)])"
_PIECE = 512
_SHIFT = "0"
for _i in range(32):
    _SHIFT = f"xor({_SHIFT}, CASE WHEN (c >> {_i}) & 1 = 1 THEN m[{_i + 1}] ELSE 0 END)"

#: DuckDB has no CRC-32: texts are cut into pieces of 512 bytes (the first may be shorter), and their registers joined by shifting over 512 zero bytes.
SQL = rf"""
WITH RECURSIVE crc_bits AS (SELECT range AS i, range AS v, 0 AS s FROM range(256)
    UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, s + 1 FROM crc_bits WHERE s < 8),
crc_table AS (SELECT list(v ORDER BY i) AS t FROM crc_bits WHERE s = 8),
crc_shift AS (SELECT list(list_reduce(list_prepend(CAST(1 AS BIGINT) << CAST(range AS INT), list_transform(range({_PIECE}), lambda x: CAST(0 AS BIGINT))), {_STEP}) ORDER BY range) AS m
    FROM range(32), crc_table),
d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
b AS (SELECT row, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM d),
p AS (SELECT row, h, n, unnest(range(greatest(1, (n + {_PIECE - 1}) // {_PIECE}))) AS p FROM b),
q AS (SELECT row, p, substr(h, 2 * greatest(0, n - {_PIECE} * ((n + {_PIECE - 1}) // {_PIECE} - p)) + 1, 2 * (n - {_PIECE} * ((n + {_PIECE - 1}) // {_PIECE} - p - 1)
    - greatest(0, n - {_PIECE} * ((n + {_PIECE - 1}) // {_PIECE} - p)))) AS h FROM p),
g AS (SELECT row, p, list_reduce(list_prepend(CASE WHEN p = 0 THEN CAST(4294967295 AS BIGINT) ELSE 0 END,
    list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))), {_STEP}) AS reg FROM q, crc_table),
crc AS (SELECT row, xor(list_reduce(list(reg ORDER BY p), lambda c, r: xor({_SHIFT}, r)), 4294967295) AS crc FROM g, crc_shift GROUP BY row, m),
s AS (SELECT row, doc_id, sha256(text) AS digest, octet_length(encode(text)) + 1 AS size FROM d),
e AS (SELECT digest, size, sum(size) OVER (ORDER BY digest) AS fin FROM (SELECT digest, sum(size) AS size FROM s GROUP BY digest)),
a AS (SELECT list(CAST(fin AS BIGINT) ORDER BY digest) AS fins, CAST(max(fin) AS BIGINT) AS total, CAST(max(size) AS BIGINT) AS largest FROM e),
c AS (SELECT greatest((total + {SHARDS - 1}) // {SHARDS}, largest) AS low, total AS high, fins, total FROM a
    UNION ALL SELECT CASE WHEN fits THEN low ELSE mid + 1 END, CASE WHEN fits THEN mid ELSE high END, fins, total
    FROM (SELECT *, list_reduce(list_prepend(CAST(0 AS BIGINT), range({SHARDS})), lambda f, i: list_max(list_filter(fins, lambda x: x <= f + mid))) = total AS fits
    FROM (SELECT *, (low + high) // 2 AS mid FROM c WHERE low < high))),
cuts AS (SELECT list_transform(range(1, {SHARDS}), lambda k: list_reduce(list_prepend(CAST(0 AS BIGINT), range(k)), lambda f, i: list_max(list_filter(fins, lambda x: x <= f + high)))) AS cuts
    FROM c WHERE low = high),
o AS (SELECT s.row, doc_id, s.digest, s.size, len(list_filter(cuts, lambda x: x < fin)) AS shard FROM s JOIN e ON s.digest = e.digest, cuts)
SELECT doc_id, CAST(size AS BIGINT) AS size, crc AS text_crc32, 'bytes' AS law, CAST(shard AS INT) AS shard,
    row_number() OVER (PARTITION BY shard ORDER BY digest, doc_id NULLS FIRST, o.row) - 1 AS slot, CAST(NULL AS INT) AS grown_shard
FROM o JOIN crc ON o.row = crc.row
"""
