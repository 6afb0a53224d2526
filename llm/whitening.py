"""Embedding whitening (operator 11): one-sided Jacobi SVD of centred vectors that blockwise TSQR has compressed.

The covariance is never formed for the components: QR steps leave a square R with the singular values of the centred
rows, and plane rotations from the right make its columns orthogonal, so that small deviations keep their
digits beside large ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import releasing, staged

#: An entry c becomes the whole number floor(SCALE * c); entries whose number is beyond LARGEST count as not finite.
SCALE, LARGEST = 256, 2**62
#: Components that are returned.
TOP = 4
#: Rows that one QR step takes beside the R so far; Rs that one task merges.
ROWS, MERGED = 1024, 32
#: Cosine between columns below which a pair counts as orthogonal, and the most sweeps over all pairs.
SMALL, SWEEPS = 1e-15, 60
#: Deviations below so small a share of the largest are rounding.
RANK = 1e-14


@dataclass
class Whitening:
    """n fitted vectors with sums S by dimension; components (rows, of unit length), deviations (roots of eigenvalues) and shares of all variance; identity_error as measured on the fit list."""

    n: int
    sums: list[int]
    components: np.ndarray
    deviations: np.ndarray
    shares: np.ndarray
    identity_error: float


def whole(column: str = "embedding") -> Column:
    """The vector in whole numbers."""
    return F.transform(F.col(column).cast("array<double>"), lambda c: F.floor(c * SCALE))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, x of the rows whose vector is not null and holds neither null nor non-finite entries.

    Vectors of another length than the most frequent one (of equally frequent ones the shortest), empty ones, and those with an
    entry too large for a whole number of 62 bits take no part either.
    """
    e = F.col("embedding").cast("array<double>")
    fine = F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * SCALE < float(LARGEST)))
    good = vectors.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).filter(fine)
    sizes = good.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    size = sizes[0]["n"] if sizes else 0
    return good.filter(F.size("embedding") == size).select("vec_id", whole().alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of equal length as the rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def scaled_out(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: in 64 bits where that holds it, else in Python's whole numbers."""
    most = n * int(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))) + max(map(abs, sums), default=0)
    if most < 2**63:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n, each entry rounded but once or twice, whatever the mean."""
    return scaled_out(x, n, sums).astype(np.float64) / n


def exact_deviation(d: np.ndarray) -> list[int | None]:
    """Sums of the squares of n * x - S; null where 64 bits don't hold it."""
    peak = int(max(abs(int(d.max(initial=0))), abs(int(d.min(initial=0)))))
    if d.dtype != object and peak * peak * d.shape[1] < 2**63:
        return np.einsum("ij,ij->i", d, d).tolist()
    sums = (sum(v * v for v in row) for row in d.astype(object).tolist())
    return [s if s < 2**63 else None for s in sums]


def jacobi(r: np.ndarray, small: float = SMALL, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, falling; their right singular vectors as rows) by plane rotations of columns.

    Pairs of columns meet as in a tournament, half as many as there are columns at a time, each pair once a sweep.
    """
    d = r.shape[1]
    a, v = np.array(r, np.float64), np.eye(d)
    players = list(range(d + d % 2))
    for _ in range(sweeps):
        turned = 0
        for _ in range(len(players) - 1):
            half = len(players) // 2
            met = [(p, q) for p, q in zip(players[:half], players[: half - 1 : -1]) if p < d and q < d]
            players[1:] = [players[-1], *players[1:-1]]
            if not met:
                continue
            p, q = np.array(met).T
            x, y = a[:, p], a[:, q]
            alpha, beta, gamma = (np.einsum("ij,ij->j", *m) for m in ((x, x), (y, y), (x, y)))
            go = np.abs(gamma) > small * np.sqrt(alpha * beta)
            if not go.any():
                continue
            turned += int(go.sum())
            p, q, alpha, beta, gamma = (m[go] for m in (p, q, alpha, beta, gamma))
            zeta = (beta - alpha) / (2 * gamma)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            s = c * t
            for m in (a, v):
                x, y = m[:, p], m[:, q]
                m[:, p], m[:, q] = c * x - s * y, s * x + c * y
        if not turned:
            break
    size = np.sqrt(np.einsum("ij,ij->j", a, a))
    order = np.argsort(-size, kind="stable")
    return size[order], v[:, order].T


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact sums of each dimension, one row for each and batch."""
    for batch in batches:
        if len(batch):
            x = _matrix(batch.column(0))
            most = int(max(abs(int(x.max())), abs(int(x.min())))) * len(x)
            sums = x.sum(axis=0).tolist() if most < 2**63 else x.astype(object).sum(axis=0).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array([len(x)] * len(sums), pa.int64()), pa.array([str(s) for s in sums])], names=["dim", "n", "s"])


def _row(r: np.ndarray, name: str = "r") -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.astype(np.float64).tobytes()], pa.binary())], names=[name])


def _compressed(n: int, sums: list[int]):
    """One R for each partition, its rows centred block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, len(sums)))
        for batch in batches:
            for a in range(0, len(batch), ROWS):
                r = np.linalg.qr(np.vstack([r, centred(_matrix(batch.column(0)[a : a + ROWS]), n, sums)]), mode="r")
        if len(r):
            yield _row(r)

    return run


def _merged(d: int):
    def run(table: pa.Table) -> pa.Table:
        r = np.zeros((0, d))
        for other in table.column("r"):
            r = np.linalg.qr(np.vstack([r, np.frombuffer(other.as_py(), np.float64).reshape(-1, d)]), mode="r")
        return pa.Table.from_batches([_row(r)])

    return run


def _one_r(listed: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """R of all centred rows: tree of QR steps, of which each task merges MERGED at most, so the driver gets one."""
    rs = staged(listed.select("x").mapInArrow(releasing(_compressed(n, sums)), "r binary").withColumn("at", F.monotonically_increasing_id()), "rs")
    left = rs.count()
    while left > 1:
        groups = max(1, -(-left // MERGED))
        dealt = rs.withColumn("group", F.pmod(F.xxhash64("at"), F.lit(groups)))
        rs = dealt.groupBy("group").applyInArrow(_merged(len(sums)), "r binary")
        rs = staged(rs.withColumn("at", F.monotonically_increasing_id()), "rs")
        left = rs.count()
    return np.frombuffer(rs.first()["r"], np.float64).reshape(-1, len(sums))


def _grams(n: int, sums: list[int], turn: np.ndarray):
    """Sums and centred products of the whitened rows of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                y = centred(_matrix(batch.column(0)), n, sums) @ turn
                g, k = y.T @ y, y.shape[1]
                at = [(i, j) for i in range(k) for j in range(k)] + [(i, -1) for i in range(k)]
                found = [g[i, j] for i, j in at[: k * k]] + y.sum(axis=0).tolist()
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in at], pa.int32()), pa.array([j for _, j in at], pa.int32()), pa.array(found, pa.float64())], names=["i", "j", "v"])

    return run


def fit(x: DataFrame, top: int = TOP) -> Whitening | None:
    """Fits on each distinct vector once; None if there is none or all variance is zero.

    x: column x of whole numbers, of one length. Repeated vectors, however many, meet after a partial aggregation.
    """
    listed = staged(x.select("x").dropDuplicates(["x"]), "fit_list")
    sums = listed.mapInArrow(releasing(_summed), "dim int, n long, s string").groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("dim").collect()
    if not sums:
        return None
    n, s = sums[0].n, [int(r.s) for r in sums]
    r = _one_r(listed, n, s)
    sizes, vectors = jacobi(r)
    rank = int((sizes > RANK * sizes[0]).sum()) if sizes[0] > 0 else 0
    if not rank:
        return None
    deviations, k = sizes / np.sqrt(n), min(top, rank)
    shares = deviations**2 / (deviations**2).sum()
    turn = vectors[:k].T / deviations[:k]
    found = {(g.i, g.j): g.v for g in listed.mapInArrow(releasing(_grams(n, s, turn)), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}
    mean = np.array([found[i, -1] for i in range(k)]) / n
    covariance = np.array([[found[i, j] for j in range(k)] for i in range(k)]) / n - np.outer(mean, mean)
    return Whitening(n, s, vectors[:k], deviations[:k], shares[:k], float(np.abs(covariance - np.eye(k)).max()))


def apply(x: DataFrame, fitted: Whitening | None) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: one row for each vector and component.

    Null vec_ids and repeated rows have rows of their own. Without variance there are no components and no rows; with fewer
    dimensions of variance than wanted components, so many as there are. deviation is null where 64 bits don't hold it.
    """
    kind = dict(x.dtypes)["vec_id"]
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if fitted is None:
        return x.sparkSession.createDataFrame([], schema)
    n, sums, k = fitted.n, fitted.sums, len(fitted.components)
    turn = fitted.components.T / fitted.deviations
    shares, error = fitted.shares, fitted.identity_error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            d = scaled_out(_matrix(batch.column(1)), n, sums)
            y = (d.astype(np.float64) / n) @ turn
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(batch)), k)))
            deviation = pa.array([v for v in exact_deviation(d) for _ in range(k)], pa.int64())
            size = len(batch) * k
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(batch))), pa.array(np.full(size, n, np.int64)), deviation, pa.array(y.ravel()), pa.array(np.tile(shares, len(batch))), pa.array(np.full(size, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return x.select("vec_id", "x").mapInArrow(releasing(run), schema)


def whiten(vectors: DataFrame, top: int = TOP) -> DataFrame:
    """All usable vectors projected on the first components and divided by their deviations; cases as in ``usable``, ``fit`` and ``apply``.

    An empty table gives no rows; more columns are not used.
    """
    x = usable(vectors)
    return apply(x, fit(x, top))
