"""Embedding whitening: pivoted Cholesky of the centred scatter, then one-sided Jacobi on its triangular factor.

Entries become whole numbers x = floor(64 * c) + 1,000,000.  Sums and products
are exact: the products are of z = x - m, m the whole number nearest to the
mean, so that they stay small, and n * sum(z z') - sum(z) sum(z)' is n squared
times the covariance without any rounding.  So the components are the same in
whatever order executors deliver their parts.

The scatter A has a factor G with A = G G', the rows of a triangular matrix in
the order of the pivots.  Plane rotations of pairs of columns make the columns
of G orthogonal; then their squared norms are the eigenvalues of A, and the
columns, made unit, its eigenvectors.  Only tables of dimension by dimension
reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jobs import prepare

SCALE, SHIFT = 64, 1_000_000
#: Entries of greater size count as not finite: their multiples must fit in 64 bits.
LARGEST = 1e9
COMPONENTS = 32
#: A pivot below this share of the first one is rounding: the rank ends there.
RANK = 1e-14


def usable(rows: DataFrame, vec: str = "embedding") -> DataFrame:
    """Rows whose vector is there, not empty and all of finite numbers."""
    c = F.col(vec)
    return rows.filter(c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) <= LARGEST)))


def whole_numbers(column: pa.Array, dim: int) -> np.ndarray:
    """The x-vectors of a list column without nulls, one row each."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return (np.floor(SCALE * flat).astype(np.int64) + SHIFT).reshape(-1, dim)


def products(z: np.ndarray) -> np.ndarray:
    """z' z exactly, as 64-bit integers; in floating point where that is exact too."""
    top = int(np.abs(z).max(initial=0))
    if top * top * max(len(z), 1) < 1 << 53:
        f = z.astype(np.float64)
        return (f.T @ f).astype(np.int64)
    return z.T @ z


def _summed(rows: DataFrame, vec: str, dim: int, of) -> dict[int, int]:
    """Sums by place of the integers that ``of`` makes of each batch's x-vectors, added up in Spark."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                v = of(whole_numbers(b[vec], dim)).ravel()
                at = np.flatnonzero(v)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(v[at])], ["place", "value"])

    parts = rows.select(vec).mapInArrow(run, "place long, value long")
    got = parts.groupBy("place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    return {r.place: int(r.value) for r in got}


def triangular_factor(a: np.ndarray) -> np.ndarray:
    """G with a = G G' by Cholesky with diagonal pivots: as many columns as the rank; rows in the given order."""
    d = len(a)
    a, g, order = a.astype(np.float64).copy(), np.zeros((d, d)), np.arange(d)
    first = a.diagonal().max(initial=0.0)
    for k in range(d):
        p = k + int(np.argmax(a.diagonal()[k:]))
        if a[p, p] <= RANK * first or a[p, p] <= 0:
            out = np.zeros((d, k))
            out[order] = g[:, :k]
            return out
        for m in (a, g):
            m[[k, p]] = m[[p, k]]
        a[:, [k, p]] = a[:, [p, k]]
        order[[k, p]] = order[[p, k]]
        g[k, k] = np.sqrt(a[k, k])
        g[k + 1 :, k] = a[k + 1 :, k] / g[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(g[k + 1 :, k], g[k + 1 :, k])
    out = np.zeros((d, d))
    out[order] = g
    return out


def orthogonal_columns(g: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The columns of g rotated in pairs until all are orthogonal to double precision, longest first."""
    g = np.asfortranarray(g, np.float64)
    r = g.shape[1]
    for _ in range(sweeps):
        turned = False
        for i in range(r - 1):
            for j in range(i + 1, r):
                u, v = g[:, i], g[:, j]
                p, q, c = u @ u, v @ v, u @ v
                if abs(c) <= 1e-16 * np.sqrt(p * q) or c == 0:
                    continue
                turned = turned or abs(c) > 4e-16 * np.sqrt(p * q)
                t = (q - p) / (2 * c)
                t = (1.0 if t >= 0 else -1.0) / (abs(t) + np.hypot(1.0, t))
                cos = 1 / np.hypot(1.0, t)
                g[:, i], g[:, j] = cos * (u - t * v), cos * (v + t * u)
        if not turned:
            break
    return g[:, np.argsort(-(g * g).sum(0), kind="stable")]


@dataclass
class Whitening:
    """n, exact sums S, unit components as columns, eigenvalues of the covariance and its trace."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        return self.n * x - self.sums

    def whiten(self, y: np.ndarray) -> np.ndarray:
        """Of n * x - S: x - S/n projected on the components, over the roots of their eigenvalues."""
        return (y.astype(np.float64) / self.n) @ self.components / np.sqrt(self.values)


def fit(rows: DataFrame, vec: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Of all usable rows that have the most frequent length (of equal ones the longest); None without any."""
    prepare(rows.sparkSession)
    good = usable(rows, vec)
    lengths = good.groupBy(F.size(vec).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if lengths is None:
        return None
    dim, n = lengths.d, lengths.n
    good = good.filter(F.size(vec) == dim)
    s = _summed(good, vec, dim, lambda x: x.sum(0))
    sums = np.array([s.get(i, 0) for i in range(dim)], object)
    middle = np.array([(2 * int(v) + n) // (2 * n) for v in sums], np.int64)
    got = _summed(good, vec, dim, lambda x: products(x - middle))
    rest = [int(v) - n * int(m) for v, m in zip(sums, middle)]
    scatter = np.array([[n * got.get(i * dim + j, 0) - rest[i] * rest[j] for j in range(dim)] for i in range(dim)], object)
    square = float(n) ** 2
    trace = float(sum(scatter[i, i] for i in range(dim))) / square
    turned = orthogonal_columns(triangular_factor(np.array(scatter / square, np.float64)))
    values = (turned * turned).sum(0)
    keep = np.flatnonzero(values > 0)[:components]
    model = Whitening(n, sums.astype(np.int64), turned[:, keep] / np.sqrt(values[keep]), values[keep], trace)
    model.identity_error = _identity_error(good, vec, dim, model)
    return model


def _identity_error(good: DataFrame, vec: str, dim: int, model: Whitening) -> float:
    """The largest entry of the whitened rows' own covariance minus the identity, from the rows."""
    k = len(model.values)
    if not k:
        return 0.0
    shared = good.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        total, mean = np.zeros((k, k)), np.zeros(k)
        for b in batches:
            w = shared.value.whiten(shared.value.centred(whole_numbers(b[vec], dim)))
            total, mean = total + w.T @ w, mean + w.sum(0)
        v = np.concatenate([total.ravel(), mean])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(v))), pa.array(v)], ["place", "value"])

    parts = good.select(vec).mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
    v = np.zeros(k * k + k)
    for r in parts:
        v[r.place] = r.value / model.n
    return float(np.abs(v[: k * k].reshape(k, k) - np.outer(v[k * k :], v[k * k :]) - np.eye(k)).max())


def whiten(rows: DataFrame, model: Whitening | None, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """A row for each usable row and component: key, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty, of another length than the model's, or holds
    null, non-finite or entries over LARGEST give none.  ``deviation`` is exact,
    and null where it passes 64 bits.  Components whose eigenvalue is 0 (a rank
    below the dimension) can't be whitened and give no rows.  Repeated rows and
    null keys give repeated rows; other columns are ignored.  Without a model
    (no usable row) there are no rows.
    """
    kind = rows.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    dim, k = len(model.sums), len(model.values)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            y = m.centred(whole_numbers(b[vec], dim))
            top = float(np.abs(y.astype(np.float64)).max(initial=0.0))
            if top * top * dim < 2.0**62:
                deviation = pa.array((y * y).sum(1))
            else:
                each = [sum(int(v) ** 2 for v in r) for r in y]
                deviation = pa.array([v if v < 1 << 63 else None for v in each], pa.int64())
            row = pa.array(np.repeat(np.arange(len(y)), k))
            share = m.values / m.trace if m.trace else m.values
            yield pa.RecordBatch.from_arrays(
                [
                    pc.take(b[key], row), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(y))), pa.array(np.full(len(row), m.n, np.int64)), pc.take(deviation, row),
                    pa.array(m.whiten(y).ravel()), pa.array(np.tile(share, len(y))), pa.array(np.full(len(row), m.identity_error)),
                ],
                schema=pa.schema([(key, b.schema.field(key).type), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())]),
            )

    good = usable(rows.select(F.col(key).alias(key), F.col(vec).alias(vec)), vec).filter(F.size(vec) == dim)
    return good.mapInArrow(run, schema)
