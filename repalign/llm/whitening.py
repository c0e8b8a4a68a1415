"""Whitening by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

The rows never leave their tasks. A step is one job: a task multiplies its centred rows X by a vector
(X v, the new left vector), multiplies the result by the transposed rows (X'u), and writes sums of
the size of a row. A left vector is never stored: it is X p for a row-sized p that the driver keeps, so
the loss of an executor costs its running tasks only. The driver holds vectors of row size and a small
bidiagonal matrix, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegralType

from .storage import kept

BATCH_CELLS = 1 << 20
EXACT = 1 << 52


@dataclass(frozen=True)
class Whitening:
    """``n`` rows, per dimension the sums (exact for whole numbers), and the leading components as columns.

    ``variances`` are the eigenvalues of the covariance (divisor n), largest first, ``total`` its trace.
    """

    n: int
    sums: tuple
    base: np.ndarray
    rest: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    total: float
    steps: int

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean, which is a whole number and a rest below one, so that large means cost no digits."""
        return (x - self.base).astype(float) - self.rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.variances)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _blocks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[np.ndarray]:
    for batch in batches:
        x = batch.column(batch.schema.get_field_index(column))
        width = max(1, len(x[0])) if len(x) else 1
        for lo in range(0, len(x), max(1, BATCH_CELLS // width)):
            yield _matrix(x.slice(lo, max(1, BATCH_CELLS // width)))


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is not null, holds only finite entries, and has the length that most of these have.

    Of equally frequent lengths the larger counts; empty vectors do not.
    """
    x = F.col(vector)
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    fine = rows.where(x.isNotNull() & (F.size(x) > 0) & whole)
    usual = fine.groupBy(F.size(x).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return fine.where(F.size(x) == (usual["d"] if usual else 0))


def _added(rows: DataFrame, column: str, fold: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of what ``fold`` makes of a block of them: each task adds up its own blocks."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in _blocks(batches, column):
            part = fold(x)
            total = part if total is None else total + part
        if total is not None:
            yield pa.record_batch([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["at", "value"])

    found = rows.select(column).mapInArrow(sums, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(len(found))
    for r in found:
        out[r["at"]] = r["value"]
    return out


def _mean(rows: DataFrame, vector: str, whole: bool) -> tuple[int, tuple, np.ndarray, np.ndarray]:
    """(n, sums, base, rest): mean = base + rest. Sums of whole numbers are exact; doubles take a second, centred pass."""
    cells = rows.select(F.posexplode(vector).alias("at", "c")).groupBy("at")
    kind = F.col("c").cast("decimal(38,0)") if whole else F.col("c").cast("double")
    found = sorted(cells.agg(F.count(F.lit(1)).alias("n"), F.sum(kind).alias("s")).collect(), key=lambda r: r["at"])
    if not found:
        return 0, (), np.zeros(0), np.zeros(0)
    n = found[0]["n"]
    if whole:
        sums = tuple(int(r["s"]) for r in found)
        return n, sums, np.array([s // n for s in sums], np.int64), np.array([(s % n) / n for s in sums])
    base = np.array([r["s"] for r in found]) / n
    rest = _added(rows, vector, lambda x: (x - base).sum(axis=0)) / n
    return n, tuple(r["s"] for r in found), base, rest


def bidiagonalise(pass_over: Callable[[np.ndarray, np.ndarray], tuple[float, np.ndarray, np.ndarray]], d: int, most: int, k: int,
                  seed: int = 0, tolerance: float = 1e-15) -> tuple[np.ndarray, np.ndarray, int]:
    """(singular values, right vectors as columns, steps) of X from products with it.

    ``pass_over(q, P)`` gives |u|^2, U'u and X'u of u = X q, for U = X P: the products X q and X'u of one step.
    Every new left and right vector is made orthogonal to all earlier ones. The upper bidiagonal
    matrix B = U'XV has the singular values of X on the spanned spaces. The steps end when the k leading ones are
    settled to ``tolerance`` of the largest, or the space is used up; a closed space goes on with a
    fresh direction X'X g, so repeated values are found as often as they occur.
    """
    rng = np.random.default_rng(seed)
    right, products, makers = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))  # V, X'U and P with U = X P
    alphas, betas = [], []
    v = pass_over(rng.standard_normal(d), makers)[2]  # X'X g: no direction outside the rows' space
    v, beta, scale = v / np.linalg.norm(v), 0.0, 0.0
    while len(alphas) < most:
        q = v - (beta * makers[:, -1] if makers.shape[1] else 0.0)
        size, along, back = pass_over(q, makers)
        # u = Xq - U (U'Xq): what the rounding of earlier steps left; a large part asks for another pass
        for _ in range(2):
            if size <= 0 or along @ along <= 1e-4 * size:
                break
            q = q - makers @ along
            size, along, back = pass_over(q, makers)
        back, q, size = back - products @ along, q - makers @ along, max(size - along @ along, 0.0)
        alpha = float(np.sqrt(size))
        scale = max(scale, alpha, beta)
        right = np.column_stack([right, v])
        if alpha <= scale * d * np.finfo(float).eps:  # X v lies in the space of the earlier left vectors
            alpha, r = 0.0, np.zeros(d)
            makers, products = np.column_stack([makers, np.zeros(d)]), np.column_stack([products, np.zeros(d)])
        else:
            makers, products = np.column_stack([makers, q / alpha]), np.column_stack([products, back / alpha])
            r = products[:, -1] - alpha * v
        alphas.append(alpha)
        for _ in range(2):
            r = r - right @ (right.T @ r)
        beta = float(np.linalg.norm(r))
        if len(alphas) >= most:
            break
        scale = max(scale, beta)
        if beta <= scale * d * np.finfo(float).eps:
            beta, fresh = 0.0, rng.standard_normal(d)
            for _ in range(2):
                fresh = fresh - right @ (right.T @ fresh)
            size, _, r = pass_over(fresh / max(np.linalg.norm(fresh), 1e-300), makers)
            if np.sqrt(size) <= scale * d * np.finfo(float).eps:
                break  # nothing is left of X
            for _ in range(2):
                r = r - right @ (right.T @ r)
            r = r / np.linalg.norm(r)
        else:
            r = r / beta
            if len(alphas) >= k:
                left, _, _ = np.linalg.svd(np.diag(alphas) + np.diag(betas, 1))
                if (beta * np.abs(left[-1, :k]) <= tolerance * scale).all():
                    break
        betas.append(beta)
        v = r
    _, values, turned = np.linalg.svd(np.diag(alphas) + np.diag(betas[:len(alphas) - 1], 1))
    return values, right @ turned.T, len(alphas)


def fit(rows: DataFrame, vector: str, k: int = 32, seed: int = 0) -> Whitening:
    """Learn from all rows of ``usable``. Directions without variance (to rounding) are no components.

    Fewer than k are returned where the rank is lower: none for an empty table, one row, or equal rows.
    Repeated rows count as often as they occur. With whole numbers the mean is exact.
    """
    whole = isinstance(rows.schema[vector].dataType.elementType, IntegralType)
    n, sums, base, rest = _mean(rows, vector, whole)
    d = len(base)
    none = Whitening(n, sums, base, rest, np.zeros((d, 0)), np.zeros(0), 0.0, 0)
    if not n:
        return none
    total = float(_added(rows, vector, lambda x: np.array([(none.centred(x) ** 2).sum()]))[0])
    if total == 0.0:
        return none

    def pass_over(q: np.ndarray, makers: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        j = makers.shape[1]

        def products(x: np.ndarray) -> np.ndarray:
            c = none.centred(x)
            u = c @ q
            back = c.T @ u
            return np.concatenate([[u @ u], (c @ makers).T @ u, back])

        out = _added(rows, vector, products)
        return float(out[0]), out[1:1 + j], out[1 + j:]

    values, vectors, steps = bidiagonalise(pass_over, d, min(d, n), min(k, d, n), seed)
    values = values[:k]
    values = values[values > max(n, d) * np.finfo(float).eps * values[0]]
    return Whitening(n, sums, base, rest, vectors[:, :len(values)], values ** 2 / n, total / n, steps)


def identity_error(rows: DataFrame, vector: str, model: Whitening) -> float:
    """Largest entry, without sign, of the covariance of the whitened rows less the identity; centred, divisor n."""
    k = len(model.variances)
    if not k:
        return 0.0
    mean = _added(rows, vector, lambda x: model.whitened(x).sum(axis=0)) / model.n

    def squares(x: np.ndarray) -> np.ndarray:
        z = model.whitened(x) - mean
        return (z.T @ z).ravel()

    return float(np.abs(_added(rows, vector, squares).reshape(k, k) / model.n - np.eye(k)).max())


def transform(rows: DataFrame, vector: str, model: Whitening, out: str = "whitened") -> DataFrame:
    """Add ``out``: the whitened coordinates of a row, an array with one entry per component; a column of that name is replaced."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("array<double>")
    def whitened(column: pa.Array) -> pa.Array:
        m = shared.value
        k = len(m.variances)
        z = m.whitened(_matrix(column)) if len(column) else np.zeros((0, k))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * k), pa.array(z.ravel()))

    return rows.withColumn(out, whitened(F.col(vector)))


def whitened_components(vectors: DataFrame, k: int = 32, seed: int = 0) -> DataFrame:
    """A row per vector and component (vectors: vec_id, embedding), as the query wants it.

    An entry c becomes the whole number floor(64 c) + 1,000,000; rows whose vector is null or has null or
    non-finite entries go, and so do those of an unusual length (see ``usable``) or with entries of 2^52 or more
    in size. ``deviation`` is exact; it is null where it does not fit a long. Components without variance have
    no rows. Repeated rows, null ids and equal ids stay rows of their own; other columns go.
    """
    rows = usable(vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")), "embedding")
    rows = rows.where(F.forall("embedding", lambda c: F.abs(c) < float(EXACT)))
    rows = rows.select("vec_id", F.transform("embedding", lambda c: F.floor(c * 64) + 1_000_000).alias("x"))
    rows = kept(rows, "vectors")
    model = fit(rows, "x", k, seed)
    error = identity_error(rows, "x", model)
    return transform(deviations(rows, "x", model), "x", model).select(
        "vec_id", F.posexplode("whitened").alias("at", "whitened"), "deviation").select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(F.array(*[F.lit(float(v / model.total)) for v in model.variances] or [F.lit(0.0)]), F.col("at") + 1).alias("explained"),
        F.lit(error).alias("identity_error"))


def deviations(rows: DataFrame, vector: str, model: Whitening) -> DataFrame:
    """Add ``deviation``: the sum over dimensions of (n x - S)^2 of whole numbers, null beyond a long."""
    sums: Sequence[int] = model.sums
    if not sums or max(map(abs, sums)) >= 1 << 63:
        return rows.withColumn("deviation", F.lit(None).cast("long"))
    apart = F.zip_with(vector, F.array(*[F.lit(s).cast("long") for s in sums]),
                       lambda x, s: F.try_subtract(F.try_multiply(x, F.lit(model.n).cast("long")), s))
    return rows.withColumn("deviation", F.aggregate(apart, F.lit(0).cast("long"), lambda a, e: F.try_add(a, F.try_multiply(e, e))))
