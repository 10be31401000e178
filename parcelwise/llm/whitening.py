"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on its factor.

Entries become whole numbers x = floor(64 c) + 1000000.  Each distinct x vector
counts once in the fit: its count n, its sums S (exact) and its scatter about
S / n, all summed inside tasks and then by row of the matrix.  What comes to the
driver is bounded by the dimension d alone: d sums and a d x d matrix.  There
the scatter A is factored, A = G G', with the largest remaining diagonal as
pivot, and pairs of columns of G are rotated until all are orthogonal: their
squared norms over n are the eigenvalues of the covariance, and the normalised
columns are its components.  The factor keeps the relative accuracy of small
eigenvalues, which a product of the factor with itself would lose.

Defined results: rows whose vector is null, empty, or holds null or non-finite
entries take no part, nor do vectors of another length than the most common one
(of equally common ones the longest); entries beyond +-2^61 after scaling are
set there; a null vec_id is kept; repeated rows each have their result, but
count once in the fit; a component without variance beyond rounding is left out, so that fewer
than `components` may come, and none at all from fewer than two distinct
vectors or an empty table; a deviation beyond a long is null; other columns
play no part.  A component's sign makes its largest entry positive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.session import released, stored

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
#: Bytes of vectors that are worked on at once inside a task.
CHUNK_BYTES = 8 << 20
#: Columns count as orthogonal from this cosine down; more sweeps than this are never needed in practice.
COSINE, SWEEPS = 1e-15, 60

RESULT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Whitening:
    """What a fit leaves: n distinct vectors, their sums S, unit components as rows, eigenvalues, trace, and the error."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float = 0.0

    def projection(self) -> np.ndarray:
        return self.components.T / np.sqrt(self.eigenvalues)


def whole(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """`vec_id`, vector -> vec_id, x (array of longs) of the rows that take part."""
    entry = lambda c: c.cast("double")
    good = F.forall(vector, lambda c: F.coalesce(~F.isnan(entry(c)) & (F.abs(entry(c)) < float("inf")), F.lit(False)))
    kept = embeddings.filter(F.col(vector).isNotNull() & (F.size(vector) > 0) & good)
    most = float(2**61)
    x = F.transform(vector, lambda c: F.floor(F.greatest(F.least(entry(c) * SCALE, F.lit(most)), F.lit(-most))).cast("bigint") + SHIFT)
    rows = kept.select(F.col("vec_id").cast("bigint").alias("vec_id"), x.alias("x"))
    size = kept.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.filter(F.size("x") == (size[0]["d"] if size else 0))


def _chunks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches with their vectors as rows of a matrix of longs."""
    rows = max(1, CHUNK_BYTES // (8 * d))
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part, part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


Kernel = Callable[[np.ndarray], np.ndarray]


def _partial_sums(batches: Iterator[pa.RecordBatch], d: int, kernel: Kernel) -> Iterator[pa.RecordBatch]:
    """The kernel's matrices summed over a task, a row of the result for each row of the matrix."""
    total = None
    for _, x in _chunks(batches, d):
        found = kernel(x)
        total = found if total is None else total + found
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], names=["i", "row"])


def _totals(kind: str) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def total(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        summed = sum(np.frombuffer(r, kind) for r in rows["row"])
        return pd.DataFrame({"i": [key[0]], "row": [summed.tobytes()]})

    return total


def matrix_sum(rows: DataFrame, d: int, kernel: Kernel, kind: str) -> np.ndarray | None:
    """The sum of kernel(x) over all rows of x: by task, then by row of the matrix; None for no rows."""
    parts = rows.select("x").mapInArrow(partial(_partial_sums, d=d, kernel=kernel), "i int, row binary")
    found = parts.groupBy("i").applyInPandas(_totals(kind), "i int, row binary").orderBy("i").collect()
    return np.stack([np.frombuffer(r["row"], kind) for r in found]) if found else None


def _sums(x: np.ndarray) -> np.ndarray:
    """The sums of the upper and of the lower 32 bits, apart, so that they stay in longs; and the number of rows."""
    return np.vstack([np.append((x >> 32).sum(0), 0), np.append((x & 0xFFFFFFFF).sum(0), len(x))])


def _scatter(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    away = x - mean
    return away.T @ away


def _moments(x: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """Scatter of the whitened rows, and as a last row their sums."""
    z = (x - mean) @ projection
    return np.vstack([z.T @ z, z.sum(0)])


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """G with a = G G', a column for each pivot, while a pivot is more than rounding; rows stay in their order."""
    rest, columns = np.array(np.diag(a), float), []
    least = len(a) * np.finfo(float).eps * max(rest.max(initial=0.0), 0.0)
    g = np.zeros((len(a), 0))
    left = np.ones(len(a), bool)
    while left.any():
        p = int(np.argmax(np.where(left, rest, -np.inf)))
        if rest[p] <= least:
            break
        column = (a[:, p] - g @ g[p]) / np.sqrt(rest[p])
        column[p] = np.sqrt(rest[p])
        column[~left] = 0.0
        columns.append(column)
        g = np.column_stack(columns)
        rest = rest - column**2
        left[p] = False
    return g


def one_sided_jacobi(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared norms, falling, and unit columns (as rows) of G rotated until its columns are orthogonal.

    In a round every column is in one pair; the rounds of a sweep bring all pairs together.
    """
    g = np.array(g, float)
    if g.shape[1] % 2:
        g = np.column_stack([g, np.zeros(len(g))])
    k = g.shape[1]
    ring = np.arange(k)
    for _ in range(SWEEPS):
        worst = 0.0
        for _ in range(max(k - 1, 0)):
            p, q = ring[: k // 2], ring[: k // 2 - 1 : -1]
            gp, gq = g[:, p], g[:, q]
            alpha, beta, gamma = (gp * gp).sum(0), (gq * gq).sum(0), (gp * gq).sum(0)
            size = np.sqrt(alpha * beta)
            cosine = np.abs(gamma) / np.where(size > 0, size, 1.0)
            worst = max(worst, cosine.max(initial=0.0))
            turn = cosine > COSINE
            zeta = (beta - alpha) / np.where(turn, 2 * gamma, 1.0)
            t = np.where(turn, np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta)), 0.0)
            c = 1 / np.sqrt(1 + t * t)
            g[:, p], g[:, q] = c * (gp - t * gq), c * (t * gp + gq)
            ring = np.concatenate([ring[:1], np.roll(ring[1:], 1)])
        if worst <= 4 * COSINE:
            break
    norms = (g * g).sum(0)
    order = np.argsort(-norms, kind="stable")
    order = order[norms[order] > 0]
    units = (g[:, order] / np.sqrt(norms[order])).T
    signs = np.sign(units[np.arange(len(units)), np.abs(units).argmax(1)]) if len(units) else np.ones(0)
    return norms[order], units * signs[:, None]


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of rows of `whole`; None if there is no row, components of length 0 if no variance."""
    first = rows.select(F.size("x").alias("d")).limit(1).collect()
    if not first:
        return None
    d = first[0]["d"]
    distinct = stored(rows.select("x").distinct())
    upper, lower = matrix_sum(distinct, d, _sums, "<i8").astype(object)
    sums, n = (upper * 2**32 + lower)[:-1], int(lower[-1])
    mean = (sums / n).astype(float)
    scatter = matrix_sum(distinct, d, partial(_scatter, mean=mean), "<f8")
    norms, units = one_sided_jacobi(pivoted_cholesky(scatter))
    model = Whitening(n, sums, units[:components], norms[:components] / n, float(np.trace(scatter)) / n)
    k = len(model.components)
    error = 0.0
    if k:
        moments = matrix_sum(distinct, d, partial(_moments, mean=mean, projection=model.projection()), "<f8")
        shift = moments[-1] / n
        error = float(np.abs(moments[:-1] / n - np.outer(shift, shift) - np.eye(k)).max())
    released(distinct)
    return Whitening(model.n, model.sums, model.components, model.eigenvalues, model.trace, error)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """The sums over dimensions of (n x - S)^2, exactly; None beyond a long."""
    near = np.abs(x).max(initial=0) < 2**62 // n and max(map(abs, sums), default=0) < 2**62
    whole = sums.astype(np.int64) if near else np.zeros(len(sums), np.int64)
    away = x * n - whole if near else x - whole
    rough = (away.astype(float) ** 2).sum(1)
    out: list[int | None] = (away * away).sum(1).tolist()
    for i in np.flatnonzero(rough > 2.0**62) if near else range(len(x)):
        true = sum((int(v) * n - int(s)) ** 2 for v, s in zip(x[i], sums, strict=True))
        out[i] = true if true < 2**63 else None
    return out


def _whitened(batches: Iterator[pa.RecordBatch], model: Whitening) -> Iterator[pa.RecordBatch]:
    k, mean, projection = len(model.components), (model.sums / model.n).astype(float), model.projection()
    names = [c.split()[0] for c in RESULT.split(", ")]
    for part, x in _chunks(batches, len(mean)):
        z = (x - mean) @ projection
        each = np.repeat(np.arange(len(x)), k)
        columns = [
            part.column("vec_id").take(pa.array(each)),
            pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
            pa.array(np.full(len(each), model.n)),
            pa.array(deviations(x, model.n, model.sums), pa.int64()).take(pa.array(each)),
            pa.array(z.ravel()),
            pa.array(np.tile(model.eigenvalues / model.trace, len(x))),
            pa.array(np.full(len(each), model.identity_error)),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def whiten(embeddings: DataFrame, components: int = COMPONENTS, vector: str = "embedding") -> DataFrame:
    """A row for each vector that takes part and each component: RESULT."""
    rows = whole(embeddings, vector)
    model = fit(rows, components)
    if model is None or not len(model.components):
        return embeddings.sparkSession.createDataFrame([], RESULT)
    return rows.mapInArrow(partial(_whitened, model=model), RESULT)
