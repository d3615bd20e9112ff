"""Whitening of vectors by Welford's updates and the symmetric QR algorithm.

Entries c count as long x = floor(256 * c). The fit list holds each distinct x vector once; it is written as a table. Tasks
stream over it with one rank-one update a vector (count, exact sums, mean, centred products); the states of tasks are merged by
the parallel update formula in two steps, so neither one group nor the driver holds more than some hundred states. The driver
solves the covariance by Householder reflections to tridiagonal form and implicit QR steps with Wilkinson shifts. A second pass
over the list measures the covariance of the whitened components by the same updates.

Rows without vector or with null or non-finite entries go; so do empty vectors, which have no component. Vectors of different
lengths are lists of their own. Copies are projected each but fitted once. Components of no variance (below 1e-13 of the trace,
as of one single vector) have whitened null and explained 0 (null where the trace is 0), and don't count in identity_error,
which is null if all are such. A deviation beyond a long is null; entries beyond a long count as the nearest long. Rows without
vec_id are kept. Other columns are ignored.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumispan.llm.common import materialize

PARTS = 256  # groups in which states of tasks are merged first
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
STATE = "width int, n long, sums array<decimal(38,0)>, mean array<double>, products array<double>"


class Welford:
    """Count, sum, mean and centred products of vectors, one rank-one update each."""

    def __init__(self, width: int):
        self.n, self.mean, self.products = 0, np.zeros(width), np.zeros((width, width))
        self._held = np.empty((width, width))

    def add(self, x: np.ndarray) -> None:
        self.n += 1
        before = x - self.mean
        self.mean += before / self.n
        np.multiply(before[:, None], x - self.mean, out=self._held)
        self.products += self._held

    def merge(self, n: int, mean: np.ndarray, products: np.ndarray) -> None:
        """The parallel update formula (Chan, Golub and LeVeque)."""
        if not n:
            return
        total = self.n + n
        gap = mean - self.mean
        self.products += products + np.outer(gap, gap) * (self.n * n / total)
        self.mean += gap * (n / total)
        self.n = total


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors in columns of a symmetric matrix."""
    a = (a + a.T) / 2
    n = len(a)
    q = np.eye(n)
    for k in range(n - 2):  # Householder reflections to tridiagonal form
        v = a[k + 1 :, k].copy()
        norm = np.sqrt(v @ v)
        if norm == 0:
            continue
        v[0] += np.copysign(norm, v[0])
        v /= np.sqrt(v @ v)
        a[k + 1 :, k:] -= 2 * np.outer(v, v @ a[k + 1 :, k:])
        a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    d, e = np.diag(a).copy(), np.diag(a, -1).copy()
    rows = q.T.copy()  # rotations then work on whole rows
    high = n - 1
    small = np.finfo(float).eps
    tiny = np.finfo(float).tiny
    for _ in range(60 * max(n, 1)):
        while high > 0 and abs(e[high - 1]) <= small * (abs(d[high - 1]) + abs(d[high])) + tiny:
            e[high - 1] = 0.0
            high -= 1
        if high <= 0:
            break
        low = high - 1
        while low > 0 and abs(e[low - 1]) > small * (abs(d[low - 1]) + abs(d[low])) + tiny:
            low -= 1
        if low > 0:
            e[low - 1] = 0.0
        half = (d[high - 1] - d[high]) / 2
        shift = d[high] - e[high - 1] ** 2 / (half + np.copysign(np.hypot(half, e[high - 1]), half))
        x, z = d[low] - shift, e[low]
        for k in range(low, high):  # chase the bulge
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > low:
                e[k - 1] = r
            p, t, u = d[k], d[k + 1], e[k]
            d[k] = c * c * p + 2 * c * s * u + s * s * t
            d[k + 1] = s * s * p - 2 * c * s * u + c * c * t
            e[k] = c * s * (t - p) + (c * c - s * s) * u
            if k < high - 1:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            rows[[k, k + 1]] = np.array([[c, s], [-s, c]]) @ rows[[k, k + 1]]
    else:
        raise ArithmeticError("the QR steps did not settle")
    order = np.argsort(-d, kind="stable")
    return d[order], rows[order].T


def _matrices(batch, column: str):
    """(width, rows, matrix) for each width in a batch."""
    lists = batch.column(column)
    widths = lists.value_lengths().to_numpy()
    for w in np.unique(widths):
        at = np.flatnonzero(widths == w)
        yield int(w), at, lists.take(pa.array(at)).flatten().to_numpy().reshape(len(at), w)


def _record(states: dict[int, tuple[Welford, list[int]]]) -> pa.RecordBatch:
    w = sorted(states)
    kinds = [pa.int32(), pa.int64(), pa.list_(pa.decimal128(38, 0)), pa.list_(pa.float64()), pa.list_(pa.float64())]
    columns = [w, [states[i][0].n for i in w], [[Decimal(s) for s in states[i][1]] for i in w], [states[i][0].mean.tolist() for i in w], [states[i][0].products.ravel().tolist() for i in w]]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["width", "n", "sums", "mean", "products"])


def fit_states(distinct: DataFrame, column: str, change=None) -> dict[int, tuple[Welford, list[int]]]:
    """For each width: Welford's state and exact sums of the vectors in ``column``, or of what ``change(width, matrix)`` makes of them."""

    def run(batches):
        states: dict[int, tuple[Welford, list[int]]] = {}
        for batch in batches:
            for width, _, x in _matrices(batch, column):
                y = x.astype(np.float64) if change is None else change(width, x)
                state, sums = states.setdefault(width, (Welford(y.shape[1]), [0] * y.shape[1]))
                if change is None:
                    exact = x.sum(axis=0).tolist() if len(x) and np.abs(y).max() < 2**40 else [sum(map(int, c)) for c in x.T.tolist()]
                    sums[:] = [a + b for a, b in zip(sums, exact, strict=True)]
                for row in y:
                    state.add(row)
        if states:
            yield _record(states)

    def merged(some: pd.DataFrame) -> pd.DataFrame:
        state, sums = None, None
        for r in sorted(some.itertuples(), key=lambda r: (r.n, tuple(r.mean))):
            state = state or Welford(len(r.mean))
            state.merge(r.n, np.asarray(r.mean), np.asarray(r.products).reshape(len(r.mean), -1))
            sums = list(r.sums) if sums is None else [a + b for a, b in zip(sums, r.sums, strict=True)]
        return pd.DataFrame({"width": [some["width"].iloc[0]], "n": [state.n], "sums": [sums], "mean": [state.mean.tolist()], "products": [state.products.ravel().tolist()]})

    first = distinct.select(column).mapInArrow(run, STATE).withColumn("part", F.spark_partition_id() % PARTS)
    both = first.groupBy("width", "part").applyInPandas(merged, STATE).groupBy("width").applyInPandas(merged, STATE)
    out = {}
    for r in both.toLocalIterator():  # one state of d * d numbers for each width
        state = Welford(len(r.mean))
        state.merge(r.n, np.array(r.mean), np.array(r.products).reshape(len(r.mean), -1))
        out[r.width] = (state, [int(s) for s in r.sums])
    return out


def _centred(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, list]:
    """x - S/n, and the exact sum of squares of n*x - S (None beyond a long)."""
    most = n * max(1, float(np.abs(x.astype(np.float64)).max(initial=0))) + max(map(abs, sums))
    if most < 2**62 and most * most * x.shape[1] < 2**62:
        gap = x * n - np.array(sums, np.int64)
        return gap / n, np.einsum("nd,nd->n", gap, gap).tolist()
    gaps = [[a * n - s for a, s in zip(row, sums, strict=True)] for row in x.tolist()]
    squares = [sum(g * g for g in row) for row in gaps]
    return np.array([[float(g) for g in row] for row in gaps]) / n, [s if s < 2**63 else None for s in squares]


def whiten(vectors: DataFrame, components: int = 4, scale: int = 256) -> DataFrame:
    """Projections of each vector (vec_id, embedding) on its leading components, scaled to unit variance, with the quality of the fit."""
    spark = vectors.sparkSession
    v = F.col("embedding").cast("array<double>")
    good = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * scale)).alias("x"))
    distinct = materialize(rows.select("x").distinct(), "distinct")
    models = {}
    for width, (state, sums) in fit_states(distinct, "x").items():
        cov = state.products / state.n
        values, axes = symmetric_qr(cov)
        k, trace = min(components, width), float(np.trace(cov))
        live = values[:k] > 1e-13 * trace
        models[width] = (state.n, sums, np.where(live, values[:k], 0.0), axes[:, :k], trace)
    if not models:
        return spark.createDataFrame([], RESULT)

    def scores(width: int, x: np.ndarray) -> tuple[np.ndarray, list]:
        n, sums, values, axes, _ = models[width]
        centred, squares = _centred(x, n, sums)
        return centred @ (axes * np.where(values > 0, 1 / np.sqrt(np.where(values > 0, values, 1.0)), 0.0)), squares

    errors = {}
    for width, (state, _) in fit_states(distinct, "x", lambda width, x: scores(width, x)[0]).items():
        live = models[width][2] > 0
        off = np.abs(state.products / state.n - np.eye(len(live)))[np.ix_(live, live)]
        errors[width] = float(off.max()) if live.any() else None

    def project(batches):
        for batch in batches:
            for width, at, x in _matrices(batch, "x"):
                n, _, values, _, trace = models[width]
                y, squares = scores(width, x)
                k, m = y.shape[1], len(x)
                ids = batch.column("vec_id").take(pa.array(np.repeat(at, k)))
                share = [float(e / trace) if trace > 0 else None for e in values]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)), pa.array([s for s in squares for _ in range(k)], pa.int64()), pa.array(y.ravel(), mask=np.tile(values <= 0, m)), pa.array(share * m, pa.float64()), pa.array([errors[width]] * (m * k), pa.float64())],
                    names=[c.split()[0] for c in RESULT.split(", ")],
                )

    return rows.mapInArrow(project, RESULT)
