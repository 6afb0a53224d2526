"""Merkle dataset manifest (operator 12): trees of eight, whose lower levels DuckDB computes on aligned Arrow buckets.

A bucket holds 512 consecutive leaves of one language, so that its tree is a whole subtree of the
language's. Executors fold it by ordered string_agg and sha256; Spark folds the buckets' roots to subroots and
those to the root, and joins to each bucket what its leaves' proofs hold above it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged
from .ranks import ranked

#: The columns that a leaf commits to, in this order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 8
#: Levels of a bucket's tree.
INNER = 3
SPAN = FAN**INNER
#: Letters of a digest as hexadecimal text.
HEX = 64

_ROOTS = "tree string, at long, m long, h string"
_PROOFS = "row long, proof_sha256 string, folded_root string"


@dataclass
class Manifest:
    """leaves: row, doc_id, leaf, claim, tree (the language), place, group_rows; above: the steps over each bucket; subroots: tree, subroot; root (null if there are no leaves)."""

    leaves: DataFrame
    above: DataFrame
    subroots: DataFrame
    root: str | None


def leaf_hash(values: dict[str, Column]) -> Column:
    """sha256 of the values one after another, each as ``-`` if null, else its UTF-8 bytes' count, a colon and itself."""
    texts = [v.cast("string") for v in values.values()]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)).cast("binary"), 256)


def _tree() -> Column:
    """The language as a key that is never null: null sorts first, then languages by their bytes."""
    return F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))


def inner_levels(leaves: int) -> int:
    """Levels that a bucket folds in a tree of so many leaves; a lone leaf is its own root."""
    levels = 0
    while leaves > 1 and levels < INNER:
        leaves, levels = -(-leaves // FAN), levels + 1
    return levels


@lru_cache(maxsize=1)
def _engine() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect(config={"threads": 1, "memory_limit": "256MB"})
    con.execute("SET preserve_insertion_order = false")
    return con


def _levels(n: int) -> list[str]:
    """n0 to n<n> are the nodes of a bucket's levels, r0 and so on the runs of nodes that become one."""
    out = ["n0 AS (SELECT pos, leaf AS h FROM leaves)"]
    for i in range(n):
        out.append(f"r{i} AS (SELECT pos // {FAN} AS run, string_agg(h, '' ORDER BY pos) AS kids FROM n{i} GROUP BY run)")
        out.append(f"n{i + 1} AS (SELECT run AS pos, sha256(kids) AS h FROM r{i})")
    return out


def _bucket_root(table: pa.Table) -> pa.Table:
    """The root of one bucket."""
    rows, bucket = table.column("group_rows")[0].as_py(), table.column("bucket")[0].as_py()
    n = inner_levels(rows)
    con = _engine()
    con.register("leaves", table)
    ((root,),) = con.execute(f"WITH {', '.join(_levels(n))} SELECT h FROM n{n}").fetchall()
    con.unregister("leaves")
    return pa.table({"tree": table.column("tree")[:1], "at": [bucket], "m": [-(-rows // SPAN)], "h": [root]})


def _bucket_proofs(table: pa.Table, steps: pa.Table) -> pa.Table:
    """Each leaf's proof, hashed, and the root that its claim folds to with the siblings of the leaves."""
    n = inner_levels(table.column("group_rows")[0].as_py())
    query = [*_levels(n), "f0 AS (SELECT row, pos, coalesce(claim, leaf) AS h, '' AS proof FROM leaves)"]
    for i in range(n):
        left, right = f"substr(kids, 1, {HEX} * (pos % {FAN}))", f"substr(kids, {HEX} * (pos % {FAN}) + {HEX + 1})"
        query.append(f"f{i + 1} AS (SELECT row, run AS pos, sha256({left} || h || {right}) AS h, proof || {left} || {right} AS proof FROM f{i} JOIN r{i} ON pos // {FAN} = run)")
    above = sorted(((s["level"], s["left"], s["right"]) for s in steps.column("steps")[0].as_py()), key=lambda s: s[0])
    values: list[str] = []
    for i, (_, left, right) in enumerate(above):
        query.append(f"f{n + i + 1} AS (SELECT row, sha256(? || h || ?) AS h, proof || ? AS proof FROM f{n + i})")
        values += [left, right, left + right]
    con = _engine()
    con.register("leaves", table)
    out = con.sql(f"WITH {', '.join(query)} SELECT row, sha256(proof) AS proof_sha256, h AS folded_root FROM f{n + len(above)}", params=values).to_arrow_table()
    con.unregister("leaves")
    return out


def _folded(nodes: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(tree, at, m, h of each tree's last node; tree, level, run, kids of all runs) of trees over nodes tree, at, m (nodes of the tree), h.

    At most eight nodes meet in a run. One staged pass a level; the levels are the logarithm of the nodes.
    """
    spark = nodes.sparkSession
    runs, level = spark.createDataFrame([], "tree string, level int, run long, kids string"), 0
    most = nodes.agg(F.max("m")).first()[0] or 0
    while most > 1:
        kids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "h"))), lambda x: x["h"]), "")
        met = nodes.filter("m > 1").groupBy("tree", F.floor(F.col("at") / FAN).alias("run")).agg(kids.alias("kids"), F.first("m").alias("m"))
        met = staged(met, f"{name}_{level}")
        runs = runs.unionByName(met.select("tree", F.lit(level).alias("level"), "run", "kids"))
        up = met.select("tree", F.col("run").alias("at"), F.ceil(F.col("m") / FAN).alias("m"), F.sha2(F.col("kids").cast("binary"), 256).alias("h"))
        nodes = up.unionByName(nodes.filter("m = 1").select("tree", "at", "m", "h"))
        most, level = -(-most // FAN), level + 1
    return nodes, runs


def _steps(places: DataFrame, runs: DataFrame, by: str, first_level: int) -> DataFrame:
    """tree, ``by``, steps: what lies left and right of the path from each place up through the runs."""
    levels = runs.agg(F.max("level")).first()[0]
    at = places.select("tree", by).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels or 0))))
    at = at.withColumn("node", F.floor(F.col(by) / F.pow(F.lit(float(FAN)), F.col("level")))).withColumn("run", F.floor(F.col("node") / FAN))
    nth = (F.col("node") % FAN).cast("int")
    met = at.join(runs, ["tree", "level", "run"], "left").filter("kids IS NOT NULL OR level = 0")
    left, right = F.substring("kids", F.lit(1), nth * HEX), F.substring("kids", nth * HEX + HEX + 1, F.lit(FAN * HEX))
    step = F.when(F.col("kids").isNotNull(), F.struct((F.col("level") + first_level).cast("int").alias("level"), left.alias("left"), right.alias("right")))
    return met.groupBy("tree", by).agg(F.collect_list(step).alias("steps"))


def manifest(docs: DataFrame, claims: dict[str, Column] | None = None) -> Manifest:
    """The trees over all documents.

    Leaves of a language ascend by doc_id (null first), then by hash; equal rows are leaves of their own. ``claims``
    replaces columns by what somebody says they hold: the claim is the leaf hash of that. Null values are part of a leaf as such,
    empty texts as texts of no bytes; languages, null first, make the top tree; more columns
    are not used; an empty table has no root. Texts of any length are hashed whole and go through no shuffle.
    """
    values = {c: F.col(c) for c in COLUMNS}
    claim = leaf_hash(values | claims) if claims else F.lit(None).cast("string")
    leaves = docs.select("doc_id", _tree().alias("tree"), leaf_hash(values).alias("leaf"), claim.alias("claim"))
    leaves = leaves.withColumn("claim", F.when(F.col("claim") != F.col("leaf"), F.col("claim"))).withColumn("row", F.monotonically_increasing_id())
    leaves = staged(leaves, "leaves")
    leaves = staged(ranked(leaves, ["tree"], ["doc_id", "leaf", "row"], "in_order").withColumn("bucket", F.floor(F.col("place") / SPAN)), "placed")
    shown = leaves.select("tree", "bucket", "group_rows", (F.col("place") % SPAN).alias("pos"), "leaf")
    nodes = staged(shown.groupBy("tree", "bucket").applyInArrow(_bucket_root, _ROOTS), "buckets")
    tops, runs = _folded(nodes, "run")
    tops = staged(tops, "tops")
    subroots = tops.select("tree", F.col("h").alias("subroot"))
    # the languages' tree: one tree, whose leaves are the subroots
    placed = ranked(tops.select(F.col("tree").alias("of"), "h"), [], ["of"], "languages")
    placed = staged(placed.select("of", F.lit("").alias("tree"), F.col("place").alias("at"), F.col("group_rows").alias("m"), "h"), "languages_at")
    last, top_runs = _folded(placed.drop("of"), "top")
    root = last.select("h").first()
    up = _steps(nodes.withColumnRenamed("at", "bucket"), runs, "bucket", 0)
    over = _steps(placed, top_runs, "at", 1000).join(placed.select("of", "at"), "at").select(F.col("of").alias("tree"), F.col("steps").alias("over"))
    above = staged(up.join(over, "tree").select("tree", "bucket", F.concat("steps", "over").alias("steps")), "above")
    return Manifest(leaves, above, subroots, root[0] if root else None)


def proofs(made: Manifest) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each document; cases as in ``manifest``.

    folded_root is what the claim, or the leaf where nothing else is claimed, gives with the siblings
    of the leaf, level by level; verified says whether that is the root.
    """
    shown = made.leaves.select("tree", "bucket", "row", "group_rows", (F.col("place") % SPAN).alias("pos"), "leaf", "claim")
    found = shown.groupBy("tree", "bucket").cogroup(made.above.groupBy("tree", "bucket")).applyInArrow(_bucket_proofs, _PROOFS)
    rows = made.leaves.select("row", "doc_id", "leaf", "tree").join(found, "row").join(made.subroots, "tree")
    root = F.lit(made.root).cast("string")
    return rows.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


#: The letters that tampering lowers, and what they become.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# End of fixed values.


def tampered_text() -> Column:
    """The text as op12 tampers with it: letters lowered where 3 divides the CRC-32 of the decimal doc_id (never where that is null)."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return F.when(hit, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))


_DEPTH, _TOP = 7, 4
_CRC = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(length(CAST(doc_id AS VARCHAR))), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), CAST(i + 1 AS INT), 1)) AS BIGINT))), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295)"


def _sql() -> str:
    """SQL for up to 8^7 leaves a language and 8^4 languages: the same trees, level by level."""
    part = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c} END"
    hashed = lambda text: "sha256(" + " || ".join(map(part, ["doc_id", "source", "lang", "n_chars", text])) + ")"
    q = [
        "crc_bits AS (SELECT range AS i, range AS v, 0 AS s FROM range(256) UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, s + 1 FROM crc_bits WHERE s < 8)",
        "crc_table AS (SELECT list(v ORDER BY i) AS t FROM crc_bits WHERE s = 8)",
        f"d AS (SELECT *, row_number() OVER () AS row, CASE WHEN {_CRC} % 3 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END AS low FROM documents, crc_table)",
        f"l AS (SELECT row, doc_id, coalesce('=' || lang, '') AS tree, {hashed('text')} AS leaf, {hashed('low')} AS claim FROM d)",
        "n0 AS (SELECT row, doc_id, leaf, claim, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, row) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS m, leaf AS h FROM l)",
        "f0 AS (SELECT row, tree, pos, m, claim AS h, '' AS proof FROM n0)",
    ]

    def levels(n: str, f: str, depth: int) -> None:
        for i in range(depth):
            q.append(f"{n}r{i} AS (SELECT tree, pos // 8 AS run, string_agg(h, '' ORDER BY pos) AS kids, max(m) AS m FROM {n}{i} WHERE m > 1 GROUP BY tree, run)")
            q.append(f"{n}{i + 1} AS (SELECT tree, run AS pos, (m + 7) // 8 AS m, sha256(kids) AS h FROM {n}r{i} UNION ALL SELECT tree, pos, m, h FROM {n}{i} WHERE m = 1)")
            left, right = "substr(kids, 1, 64 * (pos % 8))", "substr(kids, 64 * (pos % 8) + 65)"
            q.append(
                f"{f}{i + 1} AS (SELECT row, f.tree, pos // 8 AS pos, (f.m + 7) // 8 AS m, CASE WHEN kids IS NULL THEN h ELSE sha256({left} || h || {right}) END AS h, "
                f"CASE WHEN kids IS NULL THEN proof ELSE proof || {left} || {right} END AS proof FROM {f}{i} f LEFT JOIN {n}r{i} r ON f.tree = r.tree AND pos // 8 = run)"
            )

    levels("n", "f", _DEPTH)
    q.append(f"t0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS m, h, tree AS of FROM n{_DEPTH})")
    q.append(f"g0 AS (SELECT row, '' AS tree, t0.pos, t0.m, f.h, proof FROM f{_DEPTH} f JOIN t0 ON f.tree = t0.of)")
    levels("t", "g", _TOP)
    return f"""WITH RECURSIVE {', '.join(q)}
SELECT doc_id, leaf, s.h AS subroot, t.h AS root, sha256(proof) AS proof_sha256, g.h AS folded_root, g.h = t.h AS verified
FROM n0 JOIN n{_DEPTH} s ON n0.tree = s.tree JOIN g{_TOP} g ON n0.row = g.row, t{_TOP} t"""


SQL = _sql()
