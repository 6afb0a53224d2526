"""Approximate nearest neighbours (operator 10): collision-counting hashing.

Every projection is one sorted array. A query's window around its own projection
widens from level to level (virtual rehashing: nothing is hashed anew), and who
enters it collides once more; vectors with enough collisions are verified on the original vectors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

TOP = 20
PROJECTIONS, SEED = 128, 7
#: Share of the projections in which a vector must collide, the windows' first half-width
#: (in units of the largest norm) and growth, and the share of a block's vectors to verify.
COLLISIONS, WIDTH, GROWTH, VERIFY = 0.7, 0.25, 1.25, 0.08
#: Vectors whose collisions are counted at a time, and how much more the visit of one place costs than a look at it in passing.
SLICE, VISIT = 4096, 8
#: Vectors and queries in one block (on average).
BLOCK, QUERIES = 16384, 4096

_OUT = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding as doubles; without null, zero and non-finite vectors and those of an uncommon length."""
    e = F.col("embedding").cast("array<double>")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = vectors.select("vec_id", e.alias("embedding")).filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(fine & F.exists("embedding", lambda x: x != 0))
    good = staged(good, "vectors")
    sizes = good.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return good.filter(F.size("embedding") == sizes[0]["n"]) if sizes else good


def scaled(x: np.ndarray, peak: float) -> np.ndarray:
    """x over the power of two below peak: sums of squares of what is left neither overflow nor, where it matters, vanish."""
    return x * 2.0 ** -np.floor(np.log2(peak))


class Block:
    """The vectors of one block with their single-projection sorted arrays.

    ``peak`` is the largest component and ``norm`` the largest norm, once scaled, of all blocks.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, peak: float, norm: float, projections: int, seed: int) -> None:
        self.ids, self.x, self.norm = ids, x, norm
        self.near = scaled(x, peak)
        # one more component makes all norms equal, so that the largest product is the nearest
        rest = np.sqrt(np.maximum(norm * norm - np.einsum("ij,ij->i", self.near, self.near), 0.0))
        self.directions = np.random.default_rng(seed).standard_normal((x.shape[1] + 1, projections))
        p = self.near @ self.directions[:-1] + rest[:, None] * self.directions[-1]
        order = np.argsort(p, axis=0, kind="stable")
        self.sorted = np.ascontiguousarray(np.take_along_axis(p, order, axis=0).T)
        # which vector stands where in each sorted array, and the reverse
        self.order = np.ascontiguousarray(order.T)
        self.rank = np.uint16 if len(ids) <= 65535 else np.uint32
        self.place = np.empty(self.sorted.shape, self.rank)
        np.put_along_axis(self.place, order.T, np.arange(len(ids), dtype=self.rank)[None, :], axis=1)

    def inside(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """How many windows hold each vector."""
        counts = np.empty(len(self.ids), np.int64)
        low, high = (x.astype(self.rank)[:, None] for x in (low, high))
        for a in range(0, len(counts), SLICE):
            held = self.place[:, a : a + SLICE] - low < high - low
            counts[a : a + SLICE] = held.view(np.uint8).sum(axis=0, dtype=np.uint16)
        return counts

    def between(self, low: np.ndarray, high: np.ndarray, wider_low: np.ndarray, wider_high: np.ndarray) -> np.ndarray:
        """How many windows hold each vector only once they are wider."""
        ends = [o[a:b] for o, a, b in zip(self.order, wider_low, low)] + [o[a:b] for o, a, b in zip(self.order, high, wider_high)]
        return np.bincount(np.concatenate(ends), minlength=len(self.ids))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, top: int, collisions: float, width: float, growth: float, verify: float):
        """Yields (ids, scores) of each query: the first level that brings enough vectors is verified.

        From one level to the next only what enters or leaves the windows at either end is counted,
        unless that is a large part of the arrays. Queries begin at the level where the one before ended.
        """
        n, m = len(self.ids), len(self.sorted)
        enough = top + 1 + int(np.ceil(verify * n))
        need = max(1, int(np.ceil(collisions * m)))
        asked = scaled(queries, np.abs(queries).max(axis=1)[:, None])
        centres = (asked * (self.norm / np.sqrt(np.einsum("ij,ij->i", asked, asked)))[:, None]) @ self.directions[:-1]
        windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

        def level(k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Bounds of the windows of level k in the sorted arrays, and how many places they hold, for all queries."""
            if k not in windows:
                w = width * self.norm * growth**k
                low, high = (np.stack([np.searchsorted(self.sorted[j], centres[:, j] + d * w, side) for j in range(m)], axis=1) for d, side in ((-1, "left"), (1, "right")))
                windows[k] = low, high, (high - low).sum(axis=1)
            return windows[k]

        def few(places: int) -> bool:
            """So few that it costs less to visit them one by one than to look at the whole arrays."""
            return places * VISIT < n * m

        def moved(i: int, k: int, to: int, counts: np.ndarray) -> np.ndarray:
            """The collisions at a level from those at the one beside it."""
            if not few(abs(level(to)[2][i] - level(k)[2][i])):
                return self.inside(*(x[i] for x in level(to)[:2]))
            change = self.between(*(x[i] for v in sorted((k, to)) for x in level(v)[:2]))
            return counts + change if to > k else counts - change

        def first(i: int, k: int) -> tuple[int, np.ndarray]:
            """The first level that brings enough vectors, and these; k is where to begin."""
            # so few places can't hold enough vectors
            while level(k)[2][i] < enough * need:
                k += 1
            low, high, places = (x[i] for x in level(k))
            middle = (low + high) // 2
            counts = self.between(middle, middle, low, high) if few(places) else self.inside(low, high)
            found = np.flatnonzero(counts >= need)
            if len(found) < enough:
                # the windows grow until they hold all, so this ends
                while len(found) < enough:
                    counts, k = moved(i, k, k + 1, counts), k + 1
                    found = np.flatnonzero(counts >= need)
                return k, found
            while k and level(k - 1)[2][i] >= enough * need:
                counts = moved(i, k, k - 1, counts)
                less = np.flatnonzero(counts >= need)
                if len(less) < enough:
                    break
                found, k = less, k - 1
            return k, found

        k = 0
        for i, q in enumerate(queries):
            k, found = first(i, k) if enough < n else (k, np.arange(n))
            found = found[self.ids[found] != query_ids[i]]
            rough = self.near[found] @ asked[i]
            if len(found) > top:
                found = found[rough >= np.partition(rough, -top)[-top] - 1e-9 * self.norm * np.sqrt(asked[i] @ asked[i])]
            score = exact(self.x[found], q)
            best = np.lexsort((self.ids[found], -score))[:top]
            yield self.ids[found][best], score[best]


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed from the first component to the last, as a loop would."""
    out = np.zeros(len(x))
    with np.errstate(over="ignore", invalid="ignore"):
        for j in range(x.shape[1]):
            out += x[:, j] * q[j]
    return out


def nearest(vectors: DataFrame, queries: DataFrame, top: int = TOP, block: int = BLOCK, query_block: int = QUERIES, projections: int = PROJECTIONS, collisions: float = COLLISIONS, width: float = WIDTH, growth: float = GROWTH, verify: float = VERIFY, seed: int = SEED) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` vectors of largest inner product found for each query.

    vectors and queries: vec_id, embedding (as ``usable`` gives them). A query's own
    vec_id is no candidate. Blocks of vectors meet blocks of queries, each pair in a task of bounded
    size; the best of each block are ranked after a partial top-k. Ties go to the
    smaller vec_id; scores that overflow are infinite and tie, those that are no number come last; rows that
    share a vec_id are candidates and queries each; queries without candidates give no rows, nor do empty tables; more
    columns are not used. A block of at most ``top + 1`` over ``1 - verify`` vectors is verified whole.
    """
    n_queries = queries.count()
    n, peak = vectors.agg(F.count("*"), F.max(F.array_max(F.transform("embedding", F.abs)))).first()
    if not n or not n_queries:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    blocks, query_blocks = -(-n // block), -(-n_queries // query_block)
    unit = F.lit(2.0 ** -np.floor(np.log2(peak)))
    norm = vectors.agg(F.max(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * unit * (x * unit))))).first()[0] * (1 + 1e-12)

    def dealt(df: DataFrame, own: str, k: int, other: str, other_k: int) -> DataFrame:
        # rows of an id that would fill a block are spread; such ids are fewer than blocks
        heavy = df.groupBy("vec_id").agg(F.count("*").alias("rows")).filter(F.col("rows") > block).select("vec_id", F.lit(True).alias("heavy"))
        hashed = F.when(F.col("heavy"), F.xxhash64("vec_id", F.lit(own), F.monotonically_increasing_id())).otherwise(F.xxhash64("vec_id", F.lit(own)))
        own_of = df.join(F.broadcast(heavy), "vec_id", "left").withColumn(own, F.pmod(hashed, F.lit(k))).drop("heavy")
        # columns of their own, as queries may come from vectors
        own_of = own_of.select(F.col("vec_id").alias("vec_id"), F.col("embedding").alias("embedding"), own)
        return own_of.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(other_k - 1).cast("long"))))

    def meet(key, data: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(data) and len(asked):
            here = Block(data["vec_id"].to_numpy(), np.stack(data["embedding"].to_numpy()), peak, norm, projections, seed)
            ids = asked["vec_id"].to_numpy()
            found = here.search(ids, np.stack(asked["embedding"].to_numpy()), top, collisions, width, growth, verify)
            for i, (near, score) in zip(ids, found):
                out["query_id"].append(np.full(len(near), i))
                out["vec_id"].append(near)
                out["score"].append(score)
        return pd.DataFrame({k: np.concatenate(v) if v else np.zeros(0, float if k == "score" else np.int64) for k, v in out.items()})

    data = dealt(vectors, "block", blocks, "part", query_blocks)
    asked = dealt(queries, "part", query_blocks, "block", blocks)
    near = data.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInPandas(meet, _OUT)
    w = Window.partitionBy("query_id").orderBy(F.isnan("score"), F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
