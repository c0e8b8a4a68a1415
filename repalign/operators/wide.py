"""Fits whose vectors are long: the n x n form of ridge, and PCA that never forms a d x d matrix."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .moments import BLOCK_DOUBLES

ROWS_PER_CHUNK = 16_384


def correlations(pred: np.ndarray, y: np.ndarray, on_degenerate: float = 0.0) -> np.ndarray:
    """r per column; deviations within rounding of the mean count as none."""
    p, t = pred - pred.mean(axis=0), y - y.mean(axis=0)
    pp, tt = (p * p).sum(axis=0), (t * t).sum(axis=0)
    flat = (pp <= 1e-26 * len(y) * pred.mean(axis=0) ** 2) | (tt <= 1e-26 * len(y) * y.mean(axis=0) ** 2) | (pp <= 0) | (tt <= 0)
    return np.where(flat, on_degenerate, (p * t).sum(axis=0) / np.sqrt(np.where(flat, 1.0, pp) * np.where(flat, 1.0, tt)))


def kernel_predictions(x: np.ndarray, y: np.ndarray, train: np.ndarray, alpha: float, pca_dim: int | None) -> np.ndarray:
    """Predictions of the other rows, from inner products of rows alone: scaling or PCA on the training rows, then ridge.

    The same numbers as the d x d form gives; no matrix has more than rows x rows or rows x columns.
    """
    mu = x[train].mean(axis=0)
    z = x - mu
    if pca_dim and x.shape[1] > pca_dim and len(x) > pca_dim:
        k = z @ z[train].T
        lam, u = np.linalg.eigh(k[train])
        at = np.argsort(lam)[::-1][:pca_dim]
        at = at[lam[at] > lam.max() * len(lam) * np.finfo(float).eps]
        root = np.sqrt(lam[at])
        scores = k @ u[:, at] / root / (root / np.sqrt(train.sum()) + 1e-8)
        w = np.linalg.solve(scores[train].T @ scores[train] + alpha * np.eye(len(at)), scores[train].T @ y[train])
        return scores[~train] @ w
    z /= x[train].std(axis=0) + 1e-8
    k = z @ z[train].T
    return k[~train] @ np.linalg.solve(k[train] + alpha * np.eye(int(train.sum())), y[train])


def solve_rows(x: np.ndarray, y: np.ndarray, fold: np.ndarray, alpha: float, pca_dim: int | None) -> dict:
    """E2 in the n x n form: out-of-fold r per target of one group's rows."""
    y = y - y.mean(axis=0)
    pred = np.zeros_like(y)
    for f in np.unique(fold):
        pred[fold == f] = kernel_predictions(x, y, fold != f, alpha, pca_dim)
    r = correlations(pred, y)
    return {"target": np.arange(len(r)), "r": r, "alpha": np.full(len(r), alpha), "n": np.full(len(r), len(y))}


def ridge_of_rows(rows: DataFrame, keys: Sequence[str], x: str, y: str, alpha: float, pca_dim: int | None, fields: str) -> DataFrame:
    """``solve_rows`` per group of (keys, fold, x, y). For groups with fewer rows than features: a group is at most d x d."""
    import pandas as pd

    keys = list(keys)

    def fit(key, pdf):
        out = pd.DataFrame(solve_rows(np.vstack(pdf["__x"]), np.vstack(pdf["__y"]), pdf["fold"].to_numpy(), alpha, pca_dim))
        for at, (name, value) in enumerate(zip(keys, key)):
            out.insert(at, name, [value] * len(out))
        return out

    ddl = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in keys) + fields
    cells = rows.select(*keys, "fold", F.col(x).cast("array<double>").alias("__x"), F.col(y).cast("array<double>").alias("__y"))
    return cells.groupBy(*keys).applyInPandas(fit, ddl)


# ---- PCA by a block Krylov space ---------------------------------------------------------

def _pieces(key: tuple, n: int, vals: np.ndarray) -> list[tuple]:
    return [(*key, p, n if p == 0 else 0, vals[lo:lo + BLOCK_DOUBLES]) for p, lo in enumerate(range(0, max(1, len(vals)), BLOCK_DOUBLES))]


def summed_chunks(rows: DataFrame, model: DataFrame, keys: Sequence[str], item: str, fold: Callable) -> DataFrame:
    """(keys, part, n, vals): ``fold(block of x, model row)`` added up over all rows of each key.

    Rows meet their key's model in chunks of bounded size, so a hot key spreads over tasks; the sums of
    the chunks are cut into parts and added as a stream, never gathered.
    """
    import pandas as pd

    from .ridge import apply_in_chunks

    keys = list(keys)
    names = [*keys, "part", "n", "vals"]
    key_ddl = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in keys)
    ddl = key_ddl + "part int, n bigint, vals array<double>"

    def chunk(key, a, b):
        if not len(a) or not len(b):
            return pd.DataFrame(columns=names)
        return pd.DataFrame(_pieces(key, len(a), fold(np.vstack(a["__x"]), b.iloc[0])), columns=names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list] = {}
        types = None
        for batch in batches:
            types = [batch.schema.field(k).type for k in keys]
            columns = [batch.column(k).to_pylist() for k in range(len(keys) + 2)]
            for r, (*key, part, n) in enumerate(zip(*columns)):
                v = batch.column(len(keys) + 2)[r].values.to_numpy(zero_copy_only=False)
                slot = sums.setdefault((*key, part), [0, 0.0])
                slot[0], slot[1] = slot[0] + n, slot[1] + v
        for (*key, part), (n, v) in sums.items():
            yield pa.RecordBatch.from_arrays([*(pa.array([k], t) for k, t in zip(key, types)), pa.array([part], pa.int32()), pa.array([n], pa.int64()),
                                              pa.array([v], pa.list_(pa.float64()))], names=names)

    partial = apply_in_chunks(rows, model, keys, item, chunk, ddl, ROWS_PER_CHUNK)
    return partial.repartition(*[F.col(k) for k in keys], F.col("part")).mapInArrow(add, ddl)


def _whole(pdf) -> tuple[int, np.ndarray]:
    pdf = pdf.sort_values("part")
    return int(pdf["n"].sum()), np.concatenate(pdf["vals"].tolist())


def krylov_pca(df: DataFrame, keys: Sequence[str], item: str, vector: str, k: int, passes: int = 5, oversample: int = 8, seed: int = 0) -> DataFrame:
    """(keys, mu, basis, variances, explained): leading k components per key without a d x d matrix.

    A block of k + ``oversample`` random directions is multiplied by the covariance C in each of ``passes`` passes
    over the rows, as tall products X (X'Q); each new block is made orthogonal to all before. On the space
    of all blocks C is known from the passes, so its eigenvectors there (Rayleigh-Ritz) need no further pass. A key's
    state is d x (block x passes) numbers in a table of the shared folder, a pass ships d x block. ``basis`` is
    flattened d x k', k' <= k being what the rank allows; signs make the largest loading positive. Keys must not be null.
    """
    import pandas as pd

    keys = list(keys)
    rows = df.select(*keys, item, F.col(vector).cast("array<double>").alias("__x"))
    key_ddl = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keys)
    block = k + oversample

    names = [*keys, "mu", "q", "space", "products", "total"]
    ddl = key_ddl + "mu array<double>, q array<double>, space array<double>, products array<double>, total double"
    again = lambda t: t.select(*[F.col(c).alias(c) for c in t.columns])  # noqa: E731  columns of its own, for a cogroup with its relatives
    plain = again(rows.select(*keys)).distinct()
    first = summed_chunks(rows, plain, keys, item, lambda x, _: x.sum(axis=0))

    def start(a):
        n, total = _whole(a)
        d = len(total)
        q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, min(block, d))))[0]
        return total / n, q.ravel(), np.zeros(0), np.zeros(0), 0.0

    state = cut_lineage(first.groupBy(*keys).applyInPandas(lambda key, a: pd.DataFrame([(*key, *start(a))], columns=names), ddl))

    def product(x, m):
        z = x - m["mu"]
        q = np.asarray(m["q"]).reshape(z.shape[1], -1)
        return np.concatenate([(z.T @ (z @ q)).ravel(), [(z * z).sum()]])

    def grow(a, b):
        m = b.iloc[0]
        n, vals = _whole(a)
        mu = np.asarray(m["mu"])
        d = len(mu)
        q = np.asarray(m["q"]).reshape(d, -1)
        y, total = vals[:-1].reshape(d, -1) / n, vals[-1] / n
        space = np.hstack([np.asarray(m["space"]).reshape(d, -1), q])
        products = np.hstack([np.asarray(m["products"]).reshape(d, -1), y])
        fresh = y
        for _ in range(2):
            fresh = fresh - space @ (space.T @ fresh)
        u, s, _ = np.linalg.svd(fresh, full_matrices=False)
        fresh = u[:, s > 1e-13 * max(np.abs(y).max(), 1e-300)][:, :max(0, d - space.shape[1])]
        fresh = fresh - space @ (space.T @ fresh)
        fresh = np.linalg.qr(fresh)[0] if fresh.shape[1] else fresh
        return mu, fresh.ravel(), space.ravel(), products.ravel(), total

    done = None
    for _ in range(passes):
        going = state.where(F.size("q") > 0)
        if going.isEmpty():
            break
        sums = summed_chunks(rows, going.select(*keys, "mu", "q"), keys, item, product)
        grown = cut_lineage(sums.groupBy(*keys).cogroup(again(going).groupBy(*keys)).applyInPandas(lambda key, a, b: pd.DataFrame([(*key, *grow(a, b))] if len(a) and len(b) else [], columns=names), ddl))
        closed = state.where(F.size("q") == 0)
        done, state = closed if done is None else done.unionByName(closed), grown
    state = state if done is None else state.unionByName(done)

    def ritz(key, pdf):
        m = pdf.iloc[0]
        mu = np.asarray(m["mu"])
        space, products = (np.asarray(m[c]).reshape(len(mu), -1) for c in ("space", "products"))
        t = space.T @ products
        lam, vec = np.linalg.eigh((t + t.T) / 2)
        at = np.argsort(lam)[::-1][:k]
        at = at[lam[at] > 1e-14 * max(lam.max(), 1e-300)]
        basis = space @ vec[:, at]
        if len(at):
            basis = basis * np.sign(basis[np.abs(basis).argmax(axis=0), np.arange(len(at))])
        return pd.DataFrame([(*key, mu, basis.ravel(), lam[at], float(lam[at].sum() / m["total"]) if m["total"] else 0.0)], columns=[*keys, "mu", "basis", "variances", "explained"])

    return state.groupBy(*keys).applyInPandas(ritz, key_ddl + "mu array<double>, basis array<double>, variances array<double>, explained double")
