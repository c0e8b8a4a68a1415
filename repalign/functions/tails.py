"""Tail probabilities without scipy: numpy kernels and the pandas UDFs that carry them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def _each(fn, x) -> np.ndarray:
    """A scalar function over an array. (np.vectorize caches objects that tasks cannot receive.)"""
    x = np.asarray(x, float)
    return np.array([fn(v) for v in x.ravel()], float).reshape(x.shape)


def _lgamma(x) -> np.ndarray:
    return _each(math.lgamma, x)


def _erfc(x) -> np.ndarray:
    return _each(math.erfc, x)


def _beta_fraction(a, b, x, rounds: int = 400):
    """Continued fraction of the incomplete beta function, all elements at once."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    out = d.copy()
    for m in range(1, rounds):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for step in (even, odd):
            d = 1.0 + step * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + step / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            out = out * c * d
        if np.all(np.abs(c * d - 1.0) < 1e-15):
            break
    return out


def incomplete_beta(a, b, x) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b)."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    inner = np.clip(x, 1e-300, 1.0 - 1e-16)
    front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(inner) + b * np.log1p(-inner))
    flip = inner > (a + 1.0) / (a + b + 2.0)
    aa, bb, xx = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1.0 - inner, inner)
    part = front * _beta_fraction(aa, bb, xx) / aa
    res = np.where(flip, 1.0 - part, part)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, res))


def student_two_sided(t, df) -> np.ndarray:
    """Two-sided p of Student's t; NaN where t or df is not usable."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    out = np.full(t.shape, np.nan)
    ok = np.isfinite(t) & (df > 0)
    if ok.any():
        out[ok] = incomplete_beta(df[ok] / 2.0, 0.5, df[ok] / (df[ok] + t[ok] ** 2))
    out[np.isinf(t) & (df > 0)] = 0.0
    return out


def normal_upper(z) -> np.ndarray:
    return 0.5 * _erfc(np.asarray(z, float) / math.sqrt(2.0))


def rank_sum_counts(m: int, n: int) -> np.ndarray:
    """How many of the C(m+n, m) splits give each value of U (no ties)."""
    ways = [[np.array([1.0]) for _ in range(n + 1)] for _ in range(m + 1)]
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            acc = np.zeros(i * j + 1)
            a, b = ways[i - 1][j], ways[i][j - 1]
            acc[j:j + a.size] += a
            acc[:b.size] += b
            ways[i][j] = acc
    return ways[m][n]


def mann_whitney_greater(u: float, m: int, n: int, ties: float) -> float:
    """One-sided p that the first sample is larger.

    Exact by enumeration when the smaller sample has at most eight values and there are no
    ties; otherwise normal with tie and continuity correction. ``ties`` is sum(t^3 - t).
    """
    if min(m, n) <= 8 and ties == 0:
        counts = rank_sum_counts(m, n)
        return float(counts[int(math.ceil(u)):].sum() / counts.sum())
    size = m + n
    sd = math.sqrt(m * n / 12.0 * (size + 1 - ties / (size * (size - 1))))
    return float("nan") if sd == 0 else float(normal_upper((u - m * n / 2.0 - 0.5) / sd))


@pandas_udf(DoubleType())
def _student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(student_two_sided(t.to_numpy(float), df.to_numpy(float)))


@pandas_udf(DoubleType())
def _mann_whitney_p(u: pd.Series, m: pd.Series, n: pd.Series, ties: pd.Series) -> pd.Series:
    return pd.Series([mann_whitney_greater(a, int(b), int(c), d) for a, b, c, d in zip(u, m, n, ties)])


def student_p(t: Column, df: Column) -> Column:
    """Two-sided Student p as a column."""
    return _student_p(t.cast("double"), df.cast("double"))


def correlation_p(r: Column, n: Column) -> Column:
    """p of a Pearson or Spearman coefficient: t with n - 2 degrees of freedom (I8)."""
    slack = F.greatest(F.lit(1.0) - r * r, F.lit(0.0))
    t = F.when(slack > 0, r * F.sqrt((n - 2) / slack)).otherwise(F.lit(float("inf")))
    return student_p(t, (n - 2).cast("double"))


def mann_whitney_p(u: Column, m: Column, n: Column, ties: Column) -> Column:
    return _mann_whitney_p(u.cast("double"), m.cast("double"), n.cast("double"), ties.cast("double"))
