"""CKA and RSA between two vectors of the same items.

Linear CKA and Pearson RSA on correlation distances depend on the pairs only through Gram
matrices, so both are computed from one pass over the rows: the sum over all pairs of
(x_i.x_j)(y_i.y_j) is the squared Frobenius norm of X^T Y. Spearman RSA and RBF CKA need the
pairs themselves and use tiles.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import pearson
from ..functions.vectors import with_unit_rows
from .moments import Moments, moment_parts, per_group
from .pairs import euclidean_block, pack_blocks, pair_medians, parts, rdm, tile_map
from .rankpairs import pair_correlations

CKA_METHODS = ("linear", "kernel")
# A variance that is this small a share of the mean square is rounding.
NO_SPREAD = 1e-12


def linear_cka_value(g: Moments, a: np.ndarray, b: np.ndarray) -> float:
    """CKA of two column sets of one stacked x, 0 where the denominator is below 1e-10."""
    c = g.centred_xx()
    den = np.linalg.norm(c[np.ix_(a, a)]) * np.linalg.norm(c[np.ix_(b, b)])
    return 0.0 if den < 1e-10 else float(np.linalg.norm(c[np.ix_(a, b)]) ** 2 / den)


def _spans(segments: dict[str, int]) -> dict[str, np.ndarray]:
    spans, at = {}, 0
    for name, width in segments.items():
        spans[name] = np.arange(at, at + width)
        at += width
    return spans


def cka_matrix(df: DataFrame, keys: Sequence[str], stacked: str, left: dict[str, int],
               right: dict[str, int]) -> DataFrame:
    """Linear CKA of every left segment with every right one.

    ``stacked`` is one vector per item holding all segments in order; the dicts give name and
    width. One Gram pass serves the whole matrix.
    """
    spans = _spans({**left, **right})

    def solve(groups):
        (g,) = groups.values()
        rows = [(a, b, linear_cka_value(g, spans[a], spans[b])) for a in left for b in right]
        return {"left": [r[0] for r in rows], "right": [r[1] for r in rows], "cka": [r[2] for r in rows]}

    return per_group(moment_parts(df, keys, stacked), keys, [], solve, "left string, right string, cka double")


def linear_cka(df: DataFrame, keys: Sequence[str], x: str, y: str, dx: int, dy: int) -> DataFrame:
    stacked = df.select(*keys, F.concat(F.col(x).cast("array<double>"), F.col(y).cast("array<double>")).alias("__z"))
    return cka_matrix(stacked, keys, "__z", {"x": dx}, {"y": dy}).select(*keys, "cka")


def pearson_rsa_parts(g: Moments, diag_a: np.ndarray, diag_b: np.ndarray, a, b) -> tuple[float, float]:
    """(sum expected of products, denominator) of the Pearson r of two correlation RDMs, which hold whatever the order of the items.

    From the Gram of unit rows; ``diag_*`` begin with sum(k_ii) and sum(k_ii^2), corrections for rows of zero length.
    """
    n = g.n
    pairs = n * (n - 1) / 2
    if pairs < 2:
        return float("nan"), float("nan")
    sa = (np.sum(g.sx[a] ** 2) - diag_a[0]) / 2
    sb = (np.sum(g.sx[b] ** 2) - diag_b[0]) / 2
    saa, sbb = ((np.sum(g.xx[np.ix_(p, p)] ** 2) - d) / 2 for p, d in ((a, diag_a[1]), (b, diag_b[1])))
    den = np.sqrt(max(saa - sa * sa / pairs, 0.0) * max(sbb - sb * sb / pairs, 0.0))
    return float(sa * sb / pairs), float(den) if den > 0 else float("nan")


def pearson_rsa_value(g: Moments, diag_a: np.ndarray, diag_b: np.ndarray, a, b) -> float:
    """Pearson r of two correlation RDMs from the Gram of unit rows.

    ``diag_*`` hold sum(k_ii) and sum(k_ii^2)-type corrections for rows of zero length.
    """
    expected, den = pearson_rsa_parts(g, diag_a, diag_b, a, b)
    return float(((np.sum(g.xx[np.ix_(a, b)] ** 2) - diag_a[2]) / 2 - expected) / den)


def stack_units(rows: DataFrame, keys: Sequence[str], ux: str, uy: str) -> DataFrame:
    """(keys, __z): both unit rows and the diagonal terms a pair sum has to leave out."""
    sq = lambda v: F.aggregate(F.col(v), F.lit(0.0), lambda s, e: s + e * e)
    extra = F.array(sq(ux), sq(uy), sq(ux) * sq(ux), sq(uy) * sq(uy), sq(ux) * sq(uy))
    return rows.select(*keys, F.concat(ux, uy, extra).alias("__z"))


def rsa_of_stack(stacked: DataFrame, keys: Sequence[str], dx: int, dy: int) -> DataFrame:
    """(keys, rsa, expected, den): r, and the parts of it that no permutation of the items changes."""
    a, b = np.arange(dx), dx + np.arange(dy)

    def solve(groups):
        (g,) = groups.values()
        ka, kb, kaa, kbb, kab = g.sx[dx + dy:]
        args = g, np.array([ka, kaa, kab]), np.array([kb, kbb, kab]), a, b
        expected, den = pearson_rsa_parts(*args)
        return {"rsa": [pearson_rsa_value(*args)], "expected": [expected], "den": [den]}

    return per_group(moment_parts(stacked, keys, "__z"), keys, [], solve, "rsa double, expected double, den double")


def pearson_rsa(df: DataFrame, keys: Sequence[str], x: str, y: str, dx: int, dy: int) -> DataFrame:
    """Pearson RSA on correlation distances in one linear pass: no pair is ever formed (M5).

    The distances are 1 - k, so their correlation is that of the similarities k.
    """
    rows = with_unit_rows(with_unit_rows(df, x, "__ux"), y, "__uy")
    return rsa_of_stack(stack_units(rows, keys, "__ux", "__uy"), list(keys), dx, dy).drop("expected", "den")


def pearson_ceiling(df: DataFrame, keys: Sequence[str], subjects: dict[str, int]) -> DataFrame:
    """``rdm_ceiling`` by Pearson on correlation distances in one linear pass (M7); ``subjects`` gives the width of each vector.

    The mean RDMs are sums of the subjects' RDMs, so their correlations follow from the covariances of the latter, and
    those from the Gram of all unit rows side by side. The distances are 1 - k and correlate as the similarities k.
    """
    if len(subjects) < 2:
        raise ValueError("a ceiling needs two subjects")
    keys, spans, squares = list(keys), list(_spans(subjects).values()), sum(subjects.values()) + np.arange(len(subjects))
    units = [f"__u{k}" for k in range(len(subjects))]
    rows = df
    for name, unit in zip(subjects, units):
        rows = with_unit_rows(rows, name, unit)
    square = lambda v: F.aggregate(F.col(v), F.lit(0.0), lambda s, e: s + e * e)
    stacked = rows.select(*keys, F.concat(*units, F.array(*[square(u) for u in units])).alias("__z"))

    def solve(groups):
        (g,) = groups.values()
        s, pairs = len(spans), g.n * (g.n - 1) / 2
        if not pairs:
            return {"upper": [], "lower": [], "n_subjects": []}
        xx, sums = g.xx, np.array([np.sum(g.sx[p] ** 2) for p in spans])
        sums = (sums - g.sx[squares]) / 2
        products = (np.array([[np.sum(xx[np.ix_(p, q)] ** 2) for q in spans] for p in spans]) - xx[np.ix_(squares, squares)]) / 2
        cov = products - np.outer(sums, sums) / pairs
        cov[np.diag(cov) <= NO_SPREAD * np.diag(products)] = np.nan  # an RDM of one distance correlates with none

        def mean_r(means):
            """Mean over the subjects of r with the mean RDM whose weights are their row of ``means``."""
            full = np.nan_to_num(cov)
            with np.errstate(divide="ignore", invalid="ignore"):
                r = (means * full).sum(axis=1) / np.sqrt(np.diag(cov) * ((means @ full) * means).sum(axis=1))
            return float(np.mean(r[np.isfinite(r)])) if np.isfinite(r).any() else None

        return {"upper": [mean_r(np.full((s, s), 1 / s))], "lower": [mean_r((1 - np.eye(s)) / (s - 1))], "n_subjects": [s]}

    return per_group(moment_parts(stacked, keys, "__z"), keys, [], solve, "upper double, lower double, n_subjects bigint")


def rsa(df: DataFrame, keys: Sequence[str], item: str, x: str, y: str, method: str = "spearman",
        metric: str = "correlation") -> DataFrame:
    """(keys, rsa, n_pairs): RSA of two vectors of the same items; both distances come from one tile."""
    r = pair_correlations(df, keys, item, [x, y], [(0, 1)], method, metric)
    return r.select(*keys, F.col("r").alias("rsa"), "n_pairs")


def segment_rdms(df: DataFrame, keys: Sequence[str], item: str, segments: Sequence[str],
                 metric: str = "correlation") -> DataFrame:
    """(keys, segment, i, j, d): RDMs of several vector columns of the same items, in one pass (M4)."""
    wide = rdm(df, keys, item, {s: s for s in segments}, metric)
    cells = F.explode(F.array(*[F.struct(F.lit(s).alias("segment"), F.col(s).alias("d")) for s in segments]))
    return wide.select(*keys, "i", "j", cells.alias("c")).select(*keys, "c.segment", "i", "j", "c.d")


def rsa_matrix(df: DataFrame, keys: Sequence[str], item: str, left: Sequence[str], right: Sequence[str],
               method: str = "spearman", metric: str = "correlation") -> DataFrame:
    """RSA of every left vector column with every right one (M6, J13): all distances of a pair share one tile."""
    names = [*left, *right]
    cells = [(p, len(left) + q) for p in range(len(left)) for q in range(len(right))]
    r = pair_correlations(df, keys, item, names, cells, method, metric)
    label = F.array(*[F.lit(n) for n in names])
    return r.select(*keys, F.get(label, F.col("a")).alias("left"), F.get(label, F.col("b")).alias("right"), F.col("r").alias("rsa"))


def kernel_cka(df: DataFrame, keys: Sequence[str], item: str, x: str, y: str, sigma: float | None = None,
               rows_per_block: int | None = None) -> DataFrame:
    """CKA with RBF kernels (M10); the bandwidth is the mean of the two median distances.

    Centring needs only row sums, so each tile returns sums per item and not its cells.
    """
    keys = list(keys)
    blocks = pack_blocks(df, keys, item, [x, y], rows_per_block)
    if sigma is None:
        mid = pair_medians(blocks, keys, [x, y]).select(*keys, ((F.col(x) + F.col(y)) / 2).alias("sigma"))
        band = mid.select(*keys, F.when(F.col("sigma") < 1e-10, 1.0).otherwise(F.col("sigma")).alias("sigma"))
    else:
        band = df.select(*keys).distinct().withColumn("sigma", F.lit(float(sigma)))

    def kernel(same, ids_a, mats_a, ids_b, mats_b, extra):
        # one row per item with its row sums, one row per tile with the products
        r_a, r_b, sums = np.zeros((2, len(ids_a))), np.zeros((2, len(ids_b))), np.zeros(3)
        for p, q, rows, others in parts(same, len(ids_a), len(ids_b)):
            k = [np.exp(-euclidean_block(mats_a[v][rows], mats_b[v][others]) ** 2 / (2 * extra["sigma"] ** 2)) for v in (x, y)]
            once = same and p == q
            sums += [(1.0 if once else 2.0) * np.sum(k[f] * k[g]) for f, g in ((0, 1), (0, 0), (1, 1))]
            for s in (0, 1):
                r_a[s, rows] += k[s].sum(axis=1)
                if not once:
                    r_b[s, others] += k[s].sum(axis=0)
        ids, (rx, ry) = (ids_a, r_a + r_b) if same else (np.concatenate([ids_a, ids_b]), np.hstack([r_a, r_b]))
        pad = np.zeros(len(ids))
        return {"id": ids, "rx": rx, "ry": ry, **{c: np.concatenate([[v], pad[1:]]) for c, v in zip(("sxy", "sxx", "syy"), sums)}}

    cells = tile_map(blocks, keys, [x, y], kernel,
                     "id bigint, rx double, ry double, sxy double, sxx double, syy double", band, ["sigma"], whole=True)
    items = cells.groupBy(*keys, "id").agg(*[F.sum(c).alias(c) for c in ("rx", "ry", "sxy", "sxx", "syy")])
    g = items.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("rx").alias("tx"), F.sum("ry").alias("ty"),
        F.sum(F.col("rx") * F.col("ry")).alias("rxy"), F.sum(F.col("rx") * F.col("rx")).alias("rxx"),
        F.sum(F.col("ry") * F.col("ry")).alias("ryy"), *[F.sum(c).alias(c) for c in ("sxy", "sxx", "syy")])

    def hsic(s, r, t, u):
        n = F.col("n")
        return (F.col(s) - F.lit(2.0) * F.col(r) / n + F.col(t) * F.col(u) / (n * n)) / F.pow(n - 1, F.lit(2))

    den = F.sqrt(F.greatest(hsic("sxx", "rxx", "tx", "tx") * hsic("syy", "ryy", "ty", "ty"), F.lit(0.0)))
    return g.select(*keys, F.when(den < 1e-10, 0.0).otherwise(hsic("sxy", "rxy", "tx", "ty") / den).alias("cka"), "n")


def cka(df: DataFrame, keys: Sequence[str], item: str, x: str, y: str, dx: int, dy: int,
        method: str = "linear") -> DataFrame:
    """CKA by method name."""
    if method not in CKA_METHODS:
        raise ValueError(f"unknown method: {method}")
    return linear_cka(df, keys, x, y, dx, dy) if method == "linear" else kernel_cka(df, keys, item, x, y).drop("n")
