"""For each text of a query set the most similar of all texts, exact: every block of texts is asked, with a bound on letters.

Pairs of low similarity share no long chunk, so that no index can leave any out; each block orders its texts by how many
letters they have in common with the query, at most, and stops where that can no longer win.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import ratio_of
from ..sources.scratch import staged

#: Queries and texts in one block (on average); texts that are scored before the bound is looked at again.
QUERIES, BLOCK, STEP = 1024, 4096, 512
#: Letters are counted in so many bins.
BINS = 32


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, a row for each text, filled up with -1; lengths; letters counted by bin)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    table = np.full((len(texts), int(sizes.max(initial=0))), -1, np.int32)
    for i, t in enumerate(texts):
        table[i, : len(t)] = np.frombuffer(t.encode("utf-32-le"), np.int32)
    row, column = np.nonzero(table >= 0)
    counts = np.bincount(row * BINS + table[row, column] % BINS, minlength=len(texts) * BINS).reshape(-1, BINS)
    return table, sizes, counts.astype(np.int16)


def common_lengths(query: str, table: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Letters of the longest common subsequence of the query, of 63 letters at most, and each row, all rows at a time.

    Bit i of a row's word is cleared once the first i + 1 letters of the query have one more letter in common with what has been read.
    """
    full = np.uint64((1 << len(query)) - 1)
    masks: dict[int, int] = {}
    for i, c in enumerate(query):
        masks[ord(c)] = masks.get(ord(c), 0) | 1 << i
    known = np.array(sorted(masks), np.int64)
    bits = np.array([masks[c] for c in known.tolist()], np.uint64)
    open_ = np.full(len(table), full)
    for column in table[:, : int(sizes.max(initial=0))].T:
        at = np.minimum(np.searchsorted(known, column), len(known) - 1)
        here = np.where(known[at] == column, bits[at], np.uint64(0))
        hit = open_ & here
        open_ = ((open_ + hit) | (open_ - hit)) & full
    return len(query) - np.bitwise_count(open_).astype(np.int64)


def _scores(query: str, texts: list[str], table: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The ratio of the query and the texts at some places, rounded as the ratio is."""
    if not 0 < len(query) <= 63:
        return np.array([ratio_of(query, texts[i]) for i in at])
    return np.rint(200 * common_lengths(query, table[at], sizes[at]) / (len(query) + sizes[at])).astype(np.int64)


def _asked(queries: pa.Table, texts: pa.Table) -> pa.Table:
    """The best of one block for each query of another."""
    names, place = texts.column("text").to_pylist(), texts.column("rank").to_pylist()
    asked = queries.column("query").to_pylist()
    out: list[tuple[str, int, str]] = []
    if names and asked:
        table, sizes, counts = _letters(names)
        _, _, own = _letters(asked)
        for query, mine in zip(asked, own):
            most = np.rint(200 * np.minimum(counts, mine).sum(axis=1, dtype=np.int64) / np.maximum(len(query) + sizes, 1))
            order = np.argsort(-most, kind="stable")
            best: tuple[int, str, str] | None = None
            for a in range(0, len(order), STEP):
                at = order[a : a + STEP]
                if best and most[at[0]] < -best[0]:
                    break
                scores = _scores(query, names, table, sizes, at)
                top = scores.max()
                for i in at[scores == top].tolist():
                    best = min(best or (1, "", ""), (-int(top), place[i], names[i]))
            out.append((query, -best[0], best[2]))
    return pa.table({"query": pa.array([o[0] for o in out], pa.string()), "score": pa.array([o[1] for o in out], pa.int32()), "text": pa.array([o[2] for o in out], pa.string())})


def nearest_texts(queries: DataFrame, texts: DataFrame) -> DataFrame:
    """query, text, score: for each distinct query the text of the highest ratio; of equal ones that of the smallest rank.

    queries: query; texts: text, rank (a string; the smallest counts for a text). Every query meets every block of texts, once; what is
    emitted is one row for each query and block. Without texts there are no rows.
    """
    asked = staged(queries.select("query").filter("query IS NOT NULL").distinct(), "asked")
    known = staged(texts.filter("text IS NOT NULL").groupBy("text").agg(F.min("rank").alias("rank")), "known")
    n_asked, n_known = max(1, -(-asked.count() // QUERIES)), max(1, -(-known.count() // BLOCK))
    each = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    a = asked.select("query", F.pmod(F.xxhash64("query"), F.lit(n_asked)).cast("int").alias("one"), each(n_known, "other"))
    b = known.select("text", "rank", F.pmod(F.xxhash64("text"), F.lit(n_known)).cast("int").alias("other"), each(n_asked, "one"))
    met = a.groupBy("one", "other").cogroup(b.groupBy("one", "other")).applyInArrow(_asked, "query string, score int, text string")
    ranked = met.join(known, "text").groupBy("query").agg(F.min(F.struct((-F.col("score")).alias("s"), "rank", "text")).alias("b"))
    return ranked.select("query", F.col("b.text").alias("text"), (-F.col("b.s")).alias("score"))
