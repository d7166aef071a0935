"""Principal components and whitening of integer-coded embeddings.

The centred scatter is summed exactly on the executors (integers, one partial a partition, then one
aggregate). On the driver, which holds only the ``d x d`` scatter, a pivoted Cholesky factor ``L`` of the
covariance is orthogonalised column by column by one-sided Jacobi rotations: ``L W = U diag(s)``, so the
covariance ``L L^T`` is ``U diag(s^2) U^T``. Rotated column norms squared are the eigenvalues, normalised
columns the components. Every row is then whitened on the executors, and the covariance of what comes out
is measured against the identity in one more aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .vectors import matrix

#: Rows of one block of exact integer products; the bound on entries below keeps a block's sums within 63 bits.
BLOCK = 4096
#: Entries c with |c| at or above this become no long as floor(1024 c) and take no part.
LARGEST = float(2**40)
#: Cholesky stops at a residual variance below this share of the trace; components of no variance are not returned.
RANK_TOLERANCE = 1e-13


def integer_vectors(df: DataFrame, key: str, vector: str, scale: int, offset: int) -> DataFrame:
    """``id, x``: each usable row with ``x = floor(scale * c) + offset`` per entry.

    Rows whose vector is null, empty or holds a null, non-finite or too large entry are dropped; of vectors
    of different lengths only those of the most frequent length (of equally frequent ones the shortest)
    stay. Rows are not merged: a repeated row counts as often as it comes; a null key stays a null key.
    """
    c = F.col
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < LARGEST))
    rows = df.select(c(key).cast("bigint").alias("id"), c(vector).alias("v")).where(c("v").isNotNull() & (F.size("v") > 0) & good)
    lengths = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("m")).orderBy(F.desc("m"), "n").limit(1).collect()
    rows = rows.where(F.size("v") == (lengths[0]["n"] if lengths else 0))
    coded = F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("bigint") + offset)
    return rows.select("id", coded.alias("x"))


def _exact_scatter(rows: DataFrame, dim: int) -> tuple[int, list[int], list[list[int]]]:
    """``n``, per-dimension sums and sums of products of the rows' ``x``, exactly."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, [0] * dim, np.zeros((dim, dim), dtype=object)
        for batch in batches:
            x = matrix(batch.column("x")).astype(np.int64) if batch.num_rows else np.zeros((0, dim), np.int64)
            for at in range(0, len(x), BLOCK):
                part = x[at : at + BLOCK]
                n += len(part)
                sums = [a + int(b) for a, b in zip(sums, part.sum(axis=0, dtype=object))]
                products += (part.T @ part).astype(object) if np.abs(part).max() < 2**24 else part.astype(object).T @ part.astype(object)
        cells = [str(n)] + [str(s) for s in sums] + [str(int(v)) for v in products.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(cells)), pa.int32()), pa.array(cells)], names=["cell", "value"])

    summed = rows.mapInArrow(partial, "cell int, value string").groupBy("cell").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    cells = {r["cell"]: int(r["value"]) for r in summed.collect()}
    sums = [cells.get(1 + i, 0) for i in range(dim)]
    products = [[cells.get(1 + dim + i * dim + j, 0) for j in range(dim)] for i in range(dim)]
    return cells.get(0, 0), sums, products


def pivoted_cholesky(a: np.ndarray, tolerance: float) -> np.ndarray:
    """``L`` with ``a = L L^T`` up to the residual ``tolerance``, rows in ``a``'s order, one column a pivot.

    Each step takes the row of largest residual variance; a row's entries in later columns are zero, so
    ``L`` is triangular in pivot order.
    """
    d = len(a)
    factor = np.zeros((d, d))
    residual = a.diagonal().astype(np.float64).copy()
    taken = np.zeros(d, dtype=bool)
    for k in range(d):
        left = np.where(taken, -np.inf, residual)
        p = int(np.argmax(left))
        if left[p] <= tolerance:
            return factor[:, :k]
        column = (a[:, p] - factor[:, :k] @ factor[p, :k]) / np.sqrt(left[p])
        column[taken] = 0.0
        column[p] = np.sqrt(left[p])
        factor[:, k] = column
        taken[p] = True
        residual = residual - column**2
    return factor


def one_sided_jacobi(a: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Column norms and normalised columns of ``a`` rotated from the right until its columns are orthogonal."""
    a = a.copy()
    m = a.shape[1]
    for _ in range(sweeps):
        turned = False
        for p in range(m - 1):
            for q in range(p + 1, m):
                alpha, beta, gamma = a[:, p] @ a[:, p], a[:, q] @ a[:, q], a[:, p] @ a[:, q]
                if gamma == 0.0 or abs(gamma) <= 1e-15 * np.sqrt(alpha * beta):
                    continue
                turned = True
                zeta = (beta - alpha) / (2.0 * gamma)
                t = np.copysign(1.0, zeta) / (abs(zeta) + np.sqrt(1.0 + zeta * zeta))
                c = 1.0 / np.sqrt(1.0 + t * t)
                s = c * t
                ap, aq = a[:, p].copy(), a[:, q]
                a[:, p] = c * ap - s * aq
                a[:, q] = s * ap + c * aq
        if not turned:
            break
    norms = np.sqrt((a * a).sum(axis=0))
    return norms, a / np.where(norms > 0, norms, 1.0)


def components(covariance: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, at most ``count``, of nonzero variance only.

    Each vector's entry of largest magnitude (the first of equal ones) is made positive.
    """
    trace = float(np.trace(covariance))
    if not trace > 0:
        return np.zeros(0), np.zeros((len(covariance), 0))
    norms, vectors = one_sided_jacobi(pivoted_cholesky(covariance, RANK_TOLERANCE * trace))
    values = norms**2
    order = np.argsort(-values, kind="stable")
    order = order[values[order] > RANK_TOLERANCE * trace][:count]
    values, vectors = values[order], vectors[:, order]
    lead = vectors[np.argmax(np.abs(vectors), axis=0), np.arange(vectors.shape[1])]
    return values, vectors * np.where(lead < 0, -1.0, 1.0)


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", count: int = 8, scale: int = 1024, offset: int = 100000) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: each usable row by component.

    ``x = floor(scale * c) + offset`` per entry (see ``integer_vectors`` for the rows that take part). Over
    the ``n`` usable rows with sums ``S``: ``deviation`` is the exact ``sum((n x - S)^2)``, ``whitened`` the
    centred row on the component over the square root of its eigenvalue, ``explained`` that eigenvalue's
    share of the trace, ``identity_error`` the largest absolute entry of the covariance of the whitened
    values minus the identity (one value for all rows). Components are numbered from 1 by falling
    eigenvalue, at most ``count``; those of zero variance are left out, so one row, equal rows or an empty
    table give no rows. The result is a table in the shared folder.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "whitening")
    rows = scratch.keep(integer_vectors(df, key, vector, scale, offset))
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    first = rows.select(F.size("x").alias("d")).limit(1).collect()
    if not first:
        scratch.drop(rows)
        return spark.createDataFrame([], schema)
    dim = first[0]["d"]
    n, sums, products = _exact_scatter(rows, dim)
    scaled = [[n * products[i][j] - sums[i] * sums[j] for j in range(dim)] for i in range(dim)]
    covariance = np.array([[float(v) for v in line] for line in scaled]) / float(n) / float(n)
    values, vectors = components(covariance, count)
    k = len(values)
    if k == 0:
        scratch.drop(rows)
        return spark.createDataFrame([], schema)
    projection = vectors / np.sqrt(values)
    total = np.array(sums, dtype=object)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("x")).astype(np.int64).astype(object)
            centred = x * n - total
            deviation = [int(v) for v in (centred * centred).sum(axis=1)]
            if max(deviation) >= 2**63:
                raise OverflowError("sum((n x - S)^2) does not fit a long")
            w = (centred.astype(np.float64) / n) @ projection
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(deviation, pa.int64()), pa.array(list(w), pa.list_(pa.float64()))], names=["vec_id", "deviation", "w"]
            )

    wide = scratch.keep(rows.mapInArrow(project, "vec_id bigint, deviation bigint, w array<double>"))

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second, m = np.zeros(k), np.zeros((k, k)), 0
        for batch in batches:
            if batch.num_rows:
                w = matrix(batch.column("w"))
                first, second, m = first + w.sum(axis=0), second + w.T @ w, m + len(w)
        cells = [float(m), *first.tolist(), *second.ravel().tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(cells)), pa.int32()), pa.array(cells, pa.float64())], names=["cell", "value"])

    cells = {r["cell"]: r["value"] for r in wide.mapInArrow(moments, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()}
    mean = np.array([cells[1 + i] for i in range(k)]) / n
    second = np.array([[cells[1 + k + i * k + j] for j in range(k)] for i in range(k)]) / n
    error = float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())
    scratch.drop(rows)
    shares = F.array(*[F.lit(float(v / np.trace(covariance))) for v in values])
    out = wide.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return out.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        shares[F.col("at")].alias("explained"),
        F.lit(error).alias("identity_error"),
    )
