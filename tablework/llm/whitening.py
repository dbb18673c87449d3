"""Whitening of embeddings by the eigenvectors of their covariance, refined to double precision.

The entries become whole numbers, so the sums, the centring and the deviations are exact. Tasks add up centred products,
one row per pair of dimensions, and Spark adds these; the driver sees ``dims ** 2`` numbers, whatever the table. There
the eigenvectors are found in single precision and corrected by the iterations of Ogita and Aishima: matrix products in
extended precision give the corrections of all vectors whose eigenvalues are apart, and vectors of clustered eigenvalues
are turned into each other by solving the small problem of their own subspace.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablework.functions.columns import col
from tablework.session import stage

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
# Entries beyond this many steps would not fit a long once they are scaled.
LARGEST = 2.0**61
# Up to here products with the number of vectors stay within 64 bits; larger values are added up as Python integers.
SMALL = 1 << 40
ROUNDS = 30


def steps(df: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``vec_id, x``: the usable vectors in whole steps of ``1 / SCALE``.

    Vectors of another length than the commonest (the longer one, if there are several) are not usable.
    """
    vector = F.transform(col(vector_column), lambda c: c.cast("double"))
    usable = F.coalesce(
        (F.size(vector) > 0) & F.forall(vector, lambda c: F.coalesce(F.abs(c) * SCALE < LARGEST, F.lit(False))),
        F.lit(False),
    )
    rows = df.select(col(id_column).alias("vec_id"), vector.alias("vector")).filter(usable)
    lengths = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size"))
    first = lengths.first()
    rows = rows.filter(F.size("vector") == (first["size"] if first else 0))
    return rows.select("vec_id", F.transform("vector", lambda c: F.floor(c * SCALE) + SHIFT).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _exact(x: np.ndarray) -> np.ndarray:
    return x if not x.size or np.abs(x).max() < SMALL else x.astype(object)


def _sums(batches):
    total = None
    for batch in batches:
        x = _exact(_matrix(batch.column("x")))
        if len(x):
            part = x.sum(0).astype(object)
            total = part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(total)), pa.int32()), pa.array([int(v) for v in total], pa.decimal128(38))],
            ["i", "total"],
        )


@dataclass(frozen=True)
class Centre:
    """How many vectors there are, and their exact sums by dimension."""

    n: int
    sums: tuple[int, ...]

    def moved(self, x: np.ndarray) -> np.ndarray:
        """``n * x - sums``, exact."""
        sums = np.array(self.sums, object)
        if len(x) and max(np.abs(x).max(), SHIFT) * self.n < 1 << 61:
            return x * self.n - sums.astype(np.int64)
        return x.astype(object) * self.n - sums

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.moved(x) / self.n).astype(np.float64)


def centre_of(fit: DataFrame) -> Centre:
    n = fit.count()
    sums = fit.mapInArrow(_sums, "i int, total decimal(38,0)").groupBy("i").agg(F.sum("total").alias("total")).collect()
    return Centre(n, tuple(int(r["total"]) for r in sorted(sums, key=lambda r: r["i"])))


def _products(of):
    """Sums of the products of all pairs of columns that ``of`` makes of a batch, one row per pair and task."""

    def run(batches):
        total = None
        for batch in batches:
            values = of(_matrix(batch.column("x"))) if len(batch) else None
            if values is not None:
                part = values.T @ values
                total = part if total is None else total + part
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays(
                [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "total"]
            )

    return run


def covariance(fit: DataFrame, of, size: int, n: int) -> np.ndarray:
    """The covariance of the ``size`` centred columns that ``of`` makes of ``x``; the divisor is ``n``."""
    pairs = fit.mapInArrow(_products(of), "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("t"))
    out = np.zeros((size, size))
    for r in pairs.collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["t"] / n
    return out


def eigenvectors(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, to double precision."""
    scale = np.abs(a).max() if a.size else 0.0
    if not scale:
        return np.zeros(len(a)), np.eye(len(a))
    exact = (a / scale).astype(np.longdouble)
    x = np.linalg.eigh((a / scale).astype(np.float32))[1].astype(np.longdouble)
    best, unchanged = np.inf, 0
    for _ in range(ROUNDS):
        x = _sub_solved(exact, x)
        x, change = _corrected(exact, x)
        if change >= best / 2:
            unchanged += 1
        best = min(best, change)
        if change < 1e-18 or unchanged == 3:
            break
    for _ in range(2):  # rotations of nearly equal eigenvalues are large enough to miss orthonormality by their squares
        x = x + x @ (np.eye(len(a)) - x.T @ x) / 2
    values = (x * (exact @ x)).sum(0) / (x * x).sum(0)
    order = np.argsort(-values, kind="stable")
    vectors = (x / np.sqrt((x * x).sum(0)))[:, order].astype(np.float64)
    vectors *= np.where(vectors[np.abs(vectors).argmax(0), np.arange(len(a))] < 0, -1, 1)
    return (values[order] * scale).astype(np.float64), vectors


def _residuals(a: np.ndarray, x: np.ndarray):
    """By how much the columns miss being orthonormal, the matrix in their terms, its eigenvalues, and the distance
    within which two eigenvalues cannot be told apart yet."""
    r = np.eye(len(a)) - x.T @ x
    s = x.T @ (a @ x)
    s = (s + s.T) / 2
    values = np.diag(s) / (1 - np.diag(r))
    size = np.abs(values).max()
    off = s - np.diag(values)
    return r, s, values, 2 * (np.sqrt((off * off).sum()) + size * np.sqrt((r * r).sum()))


def _corrected(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, float]:
    """One iteration: columns whose eigenvalues are apart are corrected against each other, others made orthonormal."""
    r, s, values, near = _residuals(a, x)
    gap = values[None, :] - values[:, None]
    apart = np.abs(gap) > near
    e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
    return x + x @ e, float(np.abs(e).max())


def _sub_solved(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Columns of clustered eigenvalues turned within their subspace, so that they are apart as far as the matrix is.

    The small problem is shifted by the cluster's mean, so that its eigenvalues are resolved relative to their distances.
    """
    _, _, values, near = _residuals(a, x)
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order]) > near) + 1
    out = x.copy()
    for cluster in np.split(order, cuts):
        if len(cluster) < 2:
            continue
        part = np.linalg.qr(x[:, cluster].astype(np.float64))[0].astype(np.longdouble)
        part = part + part @ (np.eye(len(cluster)) - part.T @ part) / 2
        t = part.T @ (a @ part) - values[cluster].mean() * (part.T @ part)
        size = float(np.abs(t).max())
        if size:
            turn = np.linalg.eigh(((t + t.T) / (2 * size)).astype(np.float64))[1].astype(np.longdouble)
            turn = turn + turn @ (np.eye(len(cluster)) - turn.T @ turn) / 2
            part = part @ turn
        out[:, cluster] = part
    return out


@dataclass(frozen=True)
class Whitening:
    """A fitted transform: ``centre``, the components as columns, their eigenvalues and shares of the trace."""

    centre: Centre
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray

    def of(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ self.vectors / np.sqrt(self.values)


def fitted(fit: DataFrame, components: int = COMPONENTS) -> Whitening:
    """The transform of a staged list of different vectors ``x``. Components without variance are left out."""
    centre = centre_of(fit)
    size = len(centre.sums)
    v = covariance(fit, centre.centred, size, max(centre.n, 1))
    values, vectors = eigenvectors(v)
    most = min(components, int((values > size * np.finfo(float).eps * np.abs(values).max(initial=0)).sum()))
    return Whitening(centre, vectors[:, :most], values[:most], values[:most] / np.trace(v) if most else values[:0])


def _rows(model: Whitening, error: float):
    components = len(model.values)

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch.column("x"))
            moved = model.centre.moved(x)
            if moved.dtype == object or np.abs(moved.astype(float)).max() ** 2 * moved.shape[1] > 2.0**62:
                exact = (moved.astype(object) ** 2).sum(1)
            else:
                exact = (moved * moved).sum(1)
            deviation = [int(v) if v < 1 << 63 else None for v in exact]
            which = pa.array(np.repeat(np.arange(len(x)), components))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(which),
                    pa.array(np.tile(np.arange(1, components + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(which), model.centre.n, np.int64)),
                    pa.array(deviation, pa.int64()).take(which),
                    pa.array(model.of(x).ravel()),
                    pa.array(np.tile(model.explained, len(x))),
                    pa.array(np.full(len(which), error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


def whitened(
    embeddings: DataFrame,
    components: int = COMPONENTS,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """One row per usable vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    A null or empty vector, one with a null, infinite or undefined entry, one with an entry of ``LARGEST / SCALE`` or
    more, and one of another length than most are left out. The transform is fitted on the different vectors, so repeated
    rows count once there, and each of them gets its rows here. There are at most as many components as have variance
    beyond rounding: none for a single vector or an empty table, which so have no rows. Where equal eigenvalues leave the
    vectors free, any orthonormal choice within their subspace is one. A deviation beyond a long is null. Null ids are
    kept, other columns are not read.
    """
    rows = stage(steps(embeddings, id_column, vector_column), "steps")
    fit = stage(rows.select("x").distinct(), "fit")
    kind = dict(rows.dtypes)["vec_id"]
    schema = (
        f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
    model = fitted(fit, components)
    size = len(model.values)
    if not size:
        return rows.sparkSession.createDataFrame([], schema)
    error = float(np.abs(covariance(fit, model.of, size, model.centre.n) - np.eye(size)).max())
    return rows.mapInArrow(_rows(model, error), schema)
