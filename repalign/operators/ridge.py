"""Ridge encoders solved from second moments.

Fold assignment and sums are Spark work over all rows. What remains per fit is linear algebra
on (d x d) matrices, whatever the number of rows: scaling, PCA, every penalty, and even the
out-of-fold correlation follow from the sums of each fold, so predictions are never written out.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .moments import Moments, assemble, moment_parts, per_group
from .order import joined_back, kfold, random_holdout, running_totals
from .wide import krylov_pca, ridge_of_rows

# Penalty grids of the encoders.
ALPHAS_NESTED = (1.0, 10.0, 100.0, 1000.0, 10000.0)
ALPHAS_OPTIMISTIC = (1.0, 10.0, 100.0, 1000.0, 10000.0, 100000.0)
ALPHAS_LOO = (0.01, 0.1, 1.0, 10.0, 100.0, 1000.0)
ALPHAS_HOLDOUT = (100.0, 1000.0, 10000.0, 100000.0)
ALPHA_FINAL = 10000.0
ALPHA_PARTITION = 1000.0

# From this vector length on PCA takes passes over the rows instead of d x d sums.
WIDE = 1024

SCORE_FIELDS = "target int, r double, alpha double, n bigint"


# ---- per-fit linear algebra on moments -------------------------------------------------

class Scores:
    """Running centred moments of predictions and targets, for their correlation."""

    def __init__(self, v: int):
        self.n = 0.0
        self.p, self.y, self.pp, self.py, self.yy = (np.zeros(v) for _ in range(5))

    def add(self, g: Moments, w: np.ndarray, b: np.ndarray | float = 0.0) -> "Scores":
        """Add the rows of ``g``, predicted as x w + b."""
        if g.n <= 0:
            return self
        n = self.n + g.n
        gap_p, gap_y, f = g.mx @ w + b - self.p, g.my - self.y, self.n * g.n / n
        self.pp += np.einsum("iv,ij,jv->v", w, g.centred_xx(), w, optimize=True) + f * gap_p ** 2
        self.py += np.einsum("iv,iv->v", w, g.centred_xy()) + f * gap_p * gap_y
        self.yy += g.cyy + f * gap_y ** 2
        self.p, self.y, self.n = self.p + g.n / n * gap_p, self.y + g.n / n * gap_y, n
        return self

    def r(self, on_degenerate: float = 0.0) -> np.ndarray:
        """r per target; deviations within rounding of the mean count as none."""
        n = max(self.n, 1.0)
        flat = (self.pp <= 1e-26 * n * self.p ** 2) | (self.yy <= 1e-26 * n * self.y ** 2) | (self.pp <= 0) | (self.yy <= 0)
        den = np.sqrt(np.where(flat, 1.0, self.pp) * np.where(flat, 1.0, self.yy))
        return np.where(flat, on_degenerate, self.py / den)


def _principal(cov: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    lam, vec = np.linalg.eigh(cov)
    at = np.argsort(lam)[::-1][:k]
    return np.maximum(lam[at], 0.0), vec[:, at]


def _deviation(g: Moments, unit_zero: bool) -> np.ndarray:
    sd = np.sqrt(np.maximum(np.diag(g.centred_xx()) / g.n, 0.0))
    if unit_zero:
        return np.where(sd <= 1e-12 * np.maximum(1.0, np.abs(g.mx)), 1.0, sd)
    return sd + 1e-8


def reduce_then_scale(train: Moments, n_total: float, pca_dim: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(mu, A): PCA on the training rows if it reduces, then unit variance."""
    mu = train.mx
    if pca_dim and train.d > pca_dim and n_total > pca_dim:
        lam, vec = _principal(train.centred_xx() / train.n, pca_dim)
        return mu, vec / (np.sqrt(lam) + 1e-8)
    return mu, np.diag(1.0 / _deviation(train, False))


def scale_then_reduce(g: Moments, k: int | None, unit_zero: bool) -> tuple[np.ndarray, np.ndarray]:
    """(mu, A): unit variance, then PCA to k dimensions."""
    inv = 1.0 / _deviation(g, unit_zero)
    if not k or k >= g.d and not unit_zero:
        return g.mx, np.diag(inv)
    _, vec = _principal(g.centred_xx() * np.outer(inv, inv) / g.n, min(k, g.d))
    return g.mx, inv[:, None] * vec


def solve_path(xx: np.ndarray, xy: np.ndarray, alphas: Sequence[float]) -> list[np.ndarray]:
    """Ridge weights for every penalty from one eigendecomposition."""
    lam, q = np.linalg.eigh(xx)
    rot = q.T @ xy
    return [q @ (rot / (np.maximum(lam, 0.0) + a)[:, None]) for a in alphas]


def _sum(groups) -> Moments:
    it = iter(groups)
    acc = next(it)
    for g in it:
        acc = acc + g
    return acc


def _rows(r, alpha, n) -> dict:
    v = len(r)
    return {"target": np.arange(v), "r": r, "alpha": np.broadcast_to(np.asarray(alpha, float), (v,)).copy(),
            "n": np.full(v, int(n))}


def _by_fold(groups: dict) -> dict:
    folds: dict = {}
    for key, g in groups.items():
        folds[key[0]] = folds[key[0]] + g if key[0] in folds else g
    return folds


def solve_fold_local(groups, alpha: float, pca_dim: int | None) -> dict:
    """Centring of targets over all rows; PCA and scaling on the training folds only."""
    folds = _by_fold(groups)
    whole = _sum(folds.values())
    ybar = whole.my
    acc = Scores(len(ybar))
    for test in folds.values():
        train = whole - test
        mu, a = reduce_then_scale(train, whole.n, pca_dim)
        z = train.shift_y(ybar).affine(mu, a)
        (w,) = solve_path(z.xx, z.xy, [alpha])
        acc.add(test.shift_y(ybar).affine(mu, a), w)
    return _rows(acc.r(), alpha, whole.n)


def solve_nested(groups, alphas) -> dict:
    """The penalty of a fold is chosen on the last rows of its training part."""
    folds = _by_fold(groups)
    whole = _sum(folds.values())
    ybar = whole.my
    acc, chosen = Scores(len(ybar)), []
    for at, (f, test) in enumerate(folds.items()):
        train = whole - test
        mu, a = reduce_then_scale(train, whole.n, None)
        z = train.shift_y(ybar).affine(mu, a)
        inner = [g for (g_fold, mask), g in groups.items() if g_fold != f and (int(mask) >> int(f)) & 1]
        valid = _sum(inner).shift_y(ybar).affine(mu, a)
        rest = z - valid
        means = [Scores(len(ybar)).add(valid, w).r().mean() for w in solve_path(rest.xx, rest.xy, alphas)]
        best = alphas[int(np.argmax(means))]
        chosen.append(best)
        (w,) = solve_path(z.xx, z.xy, [best])
        acc.add(test.shift_y(ybar).affine(mu, a), w)
    return _rows(acc.r(), np.median(chosen), whole.n)


def solve_test_fold(groups, alphas, n_components: int | None, scaled: bool = True) -> dict:
    """E5: scaling and PCA before the folds and the penalty chosen on the test fold (optimistic)."""
    folds = _by_fold(groups)
    whole = _sum(folds.values())
    ybar = whole.my
    k = None
    if n_components and whole.d > n_components and whole.n > n_components:
        k = n_components
    elif n_components and whole.d > whole.n:
        k = int(min(whole.n - 1, whole.d))
    mu, a = scale_then_reduce(whole, k, False)
    z = {f: g.shift_y(ybar).affine(mu, a) for f, g in folds.items()}
    total = _sum(z.values())
    acc, chosen = Scores(len(ybar)), []
    per_alpha = np.zeros(len(alphas))
    for test in z.values():
        train = total - test
        path = solve_path(train.xx, train.xy, alphas)
        means = np.array([Scores(len(ybar)).add(test, w).r().mean() for w in path])
        per_alpha += means / len(z)
        best = int(np.argmax(means))
        chosen.append(alphas[best])
        acc.add(test, path[best])
    out = _rows(acc.r(), np.median(chosen), whole.n)
    out["alpha_mean_r"] = [per_alpha.tolist()] * len(ybar)
    return out


def solve_partition(groups, spans: dict[str, np.ndarray], fit: Callable) -> dict:
    """Run ``fit`` on several column sets of one stacked x: one row per (model, target)."""
    frames = {"model": [], "target": [], "r": [], "alpha": [], "n": []}
    for name, idx in spans.items():
        res = fit({key: g.select_x(idx) for key, g in groups.items()})
        frames["model"] += [name] * len(res["target"])
        for c in ("target", "r", "alpha", "n"):
            frames[c] += list(res[c])
    return frames


def solve_plain(groups, alpha: float, pca_dim: int | None) -> dict:
    """The fixed-penalty fit of the variance partition (E13): no scaling, raw sums, no intercept."""
    folds = _by_fold(groups)
    whole = _sum(folds.values())
    if pca_dim and whole.d > pca_dim and whole.n > pca_dim:
        _, vec = _principal(whole.centred_xx() / whole.n, pca_dim)
        folds = {f: g.affine(whole.mx, vec) for f, g in folds.items()}
        whole = _sum(folds.values())
    acc = Scores(len(whole.my))
    for test in folds.values():
        train = whole - test
        (w,) = solve_path(train.xx, train.xy, [alpha])
        acc.add(test, w)
    return _rows(acc.r(), alpha, whole.n)


def solve_single_split(groups, alpha: float) -> dict:
    """One random test part, targets centred on the training part."""
    train, test = groups[(True,)], groups[(False,)]
    ybar = train.my
    mu, a = reduce_then_scale(train, train.n, None)
    z = train.shift_y(ybar).affine(mu, a)
    (w,) = solve_path(z.xx, z.xy, [alpha])
    return _rows(Scores(len(ybar)).add(test.affine(mu, a), w).r(), alpha, train.n + test.n)


def _with_intercept(g: Moments, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    (w,) = solve_path(g.centred_xx(), g.centred_xy(), [alpha])
    return w, g.my - g.mx @ w


def solve_holdout(groups, alphas, n_components: int) -> dict:
    """Penalty from the last 20 % of the training items, refit, score each test condition."""
    early, late = groups[("fit",)], groups[("valid",)]
    whole = early + late
    k = int(min(n_components, whole.n - 1, whole.d))
    mu, a = scale_then_reduce(whole, k, True)
    z_early, z_late = early.affine(mu, a), late.affine(mu, a)
    z = z_early + z_late
    best, best_score = alphas[0], -1e9
    for alpha in alphas:
        w, b = _with_intercept(z_early, alpha)
        r = Scores(len(b)).add(z_late, w, b).r(np.nan)
        score = np.nanmean(r) if np.isfinite(r).any() else np.nan
        if score > best_score:
            best, best_score = alpha, score
    w, b = _with_intercept(z, best)
    out = {"condition": [], "target": [], "r": [], "alpha": [], "n": []}
    for (name,), g in groups.items():
        if name in ("fit", "valid"):
            continue
        r = Scores(len(b)).add(g.affine(mu, a), w, b).r(np.nan)
        out["condition"] += [name] * len(r)
        out["target"] += range(len(r))
        out["r"] += [None if np.isnan(v) else float(v) for v in r]
        out["alpha"] += [best] * len(r)
        out["n"] += [int(g.n)] * len(r)
    return out


# ---- Spark plans ------------------------------------------------------------------------

FORMS = ("auto", "gram", "rows")


def fold_local_ridge(df: DataFrame, keys, item, x, y, k: int = 5, alpha: float = ALPHA_FINAL,
                     pca_dim: int | None = 256, seed: int = 42, form: str = "auto") -> DataFrame:
    """Out-of-fold r per target, everything fitted inside the fold.

    ``gram`` works on d x d sums of each fold, ``rows`` on the n x n inner products of a group's rows; the results
    are equal. ``auto`` takes the rows of groups that have fewer rows than features, and sums for all others.
    """
    if form not in FORMS:
        raise ValueError(f"unknown form: {form}")
    keys = list(keys)
    rows = kfold(df, keys, item, k, seed)
    by_sums = lambda part: per_group(moment_parts(part, [*keys, "fold"], x, y), keys, ["fold"], lambda g: solve_fold_local(g, alpha, pca_dim), SCORE_FIELDS)
    by_rows = lambda part: ridge_of_rows(part, keys, x, y, alpha, pca_dim, SCORE_FIELDS)
    if form != "auto":
        return by_sums(rows) if form == "gram" else by_rows(rows)
    shapes = df.groupBy(*keys).agg((F.count(F.lit(1)) < F.max(F.size(x))).alias("__few"))
    kinds = {r["__few"] for r in shapes.select("__few").distinct().collect()}
    if len(kinds) < 2:
        return by_rows(rows) if True in kinds else by_sums(rows)
    rows = cut_lineage(joined_back(rows, shapes, keys))
    return by_sums(rows.where(~F.col("__few"))).unionByName(by_rows(rows.where("__few")))


def null_ridge(df: DataFrame, keys, item, x, y, reps: int, k: int = 5, alpha: float = ALPHA_FINAL, pca_dim: int | None = 256,
               seed: int = 42, reps_per_fit: int = 256) -> DataFrame:
    """(keys, rep, target, r): the fold-local fit of the targets (rep -1) and of ``reps`` permutations of them.

    Permutations move targets only: those of up to ``reps_per_fit`` replicates are further columns of one fit,
    so the products of the features, their PCA and the factorisation are computed once per fold. Folds and
    permutations are those of ``kfold`` and ``permutation_table``. Items must be unique within keys.
    """
    from .inference import permutation_table

    keys = list(keys)
    perm = permutation_table(df, keys, item, reps, seed).unionByName(df.select(*keys, F.lit(-1).alias("rep"), item, F.col(item).alias("other")))
    targets = df.select(*keys, F.col(item).alias("other"), F.col(y).cast("array<double>").alias("__y"))
    at = F.col("rep") + 1
    moved = joined_back(perm, targets, [*keys, "other"]).withColumn("__fit", F.floor(at / reps_per_fit).cast("int"))
    stacked = moved.groupBy(*keys, item, "__fit").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("rep", "__y"))), lambda s: s["__y"])).alias("__y"))
    rows = joined_back(stacked, kfold(df.select(*keys, item, x), keys, item, k, seed), [*keys, item])
    parts = moment_parts(rows, [*keys, "__fit", "fold"], x, "__y")

    def fit(groups):
        out = solve_fold_local(groups, alpha, pca_dim)
        return {**out, "width": np.full(len(out["r"]), len(out["r"]))}

    scores = per_group(parts, [*keys, "__fit"], ["fold"], fit, SCORE_FIELDS + ", width int")
    held = F.least(F.lit(reps_per_fit), F.lit(reps + 1) - F.col("__fit") * reps_per_fit)
    width = (F.col("width") / held).cast("int")
    return scores.select(*keys, (F.col("__fit") * reps_per_fit + F.floor(F.col("target") / width) - 1).cast("int").alias("rep"),
                         F.pmod("target", width).cast("int").alias("target"), "r")


def mark_inner_rows(df: DataFrame, keys: Sequence[str], item: str, k: int) -> DataFrame:
    """Add ``mask``: bit f is set if the row is among the last n_train // k training rows of fold f."""
    sums = {f"__c{f}": F.when(F.col("fold") == f, 0).otherwise(1).cast("long") for f in range(k)}
    res = running_totals(df, keys, [item], sums)
    mask = F.lit(0).cast("long")
    for f in range(k):
        n_train = F.col(f"__c{f}_all")
        n_inner = F.greatest(F.lit(1), F.floor(n_train / k))
        late = (F.col("fold") != f) & (n_train - F.col(f"__c{f}") < n_inner)
        mask = mask + F.when(late, F.lit(1 << f)).otherwise(F.lit(0))
    return res.withColumn("mask", mask).drop(*[c for f in range(k) for c in (f"__c{f}", f"__c{f}_all")])


def nested_ridge(df: DataFrame, keys, item, x, y, k: int = 5, alphas=ALPHAS_NESTED, seed: int = 42) -> DataFrame:
    """Out-of-fold r with the penalty chosen inside each training part."""
    rows = mark_inner_rows(kfold(df, keys, item, k, seed), keys, item, k)
    parts = moment_parts(rows, [*keys, "fold", "mask"], x, y)
    return per_group(parts, keys, ["fold", "mask"], lambda g: solve_nested(g, alphas), SCORE_FIELDS)


def single_split_ridge(df: DataFrame, keys, item, x, y, alpha: float = ALPHA_FINAL, test_share: float = 0.2,
                       seed: int = 42) -> DataFrame:
    """One split, for smoke tests and the semantic encoder."""
    parts = moment_parts(random_holdout(df, keys, item, test_share, seed), [*keys, "is_train"], x, y)
    return per_group(parts, keys, ["is_train"], lambda g: solve_single_split(g, alpha), SCORE_FIELDS)


def optimistic_ridge(df: DataFrame, keys, item, x, y, k: int = 5, alphas=ALPHAS_OPTIMISTIC,
                     n_components: int | None = 512, seed: int = 42) -> DataFrame:
    """Penalty chosen on the test fold (E5); ``alpha_mean_r`` lists the mean r of each penalty."""
    parts = moment_parts(kfold(df, keys, item, k, seed), [*keys, "fold"], x, y)
    return per_group(parts, keys, ["fold"], lambda g: solve_test_fold(g, alphas, n_components),
                     SCORE_FIELDS + ", alpha_mean_r array<double>")


def partitioned_ridge(df: DataFrame, keys, item, stacked: str, models: dict[str, Sequence[tuple[int, int]]], y: str,
                      k: int = 5, alphas=ALPHAS_OPTIMISTIC, n_components: int | None = 512,
                      fixed_alpha: float | None = None, seed: int = 42) -> DataFrame:
    """(keys, model, target, r): several column sets of one stacked vector from one data pass.

    ``models`` gives each model's (start, length) pieces. With ``fixed_alpha`` the plain fit of
    the variance partition is used (E13), else the test-fold search (E12).
    """
    spans = {m: np.concatenate([np.arange(s, s + w) for s, w in pieces]) for m, pieces in models.items()}
    fit = ((lambda g: solve_plain(g, fixed_alpha, n_components)) if fixed_alpha is not None
           else (lambda g: solve_test_fold(g, alphas, n_components)))
    parts = moment_parts(kfold(df, keys, item, k, seed), [*keys, "fold"], stacked, y)
    return per_group(parts, keys, ["fold"], lambda g: solve_partition(g, spans, fit), "model string, " + SCORE_FIELDS)


def holdout_ridge(train: DataFrame, tests: dict[str, DataFrame], keys, item, x, y, alphas=ALPHAS_HOLDOUT,
                  n_components: int = 512, share: float = 0.8) -> DataFrame:
    """(keys, condition, target, r): fit on the training items, score each test condition.

    Every frame has (keys, item, x, y); r is null for constant targets.
    """
    from .order import ordered_holdout

    rows = ordered_holdout(train.select(*keys, item, x, y), keys, item, share)
    rows = rows.select(*keys, x, y, F.when(F.col("is_train"), "fit").otherwise("valid").alias("split"))
    for name, t in tests.items():
        rows = rows.unionByName(t.select(*keys, x, y, F.lit(name).alias("split")))
    parts = moment_parts(rows, [*keys, "split"], x, y)
    return per_group(parts, keys, ["split"], lambda g: solve_holdout(g, alphas, n_components),
                     "condition string, " + SCORE_FIELDS)


def apply_in_chunks(rows: DataFrame, model: DataFrame, keys: Sequence[str], item: str, fn: Callable, ddl: str,
                    rows_per_chunk: int = 8192) -> DataFrame:
    """Second pass over the rows with the per-key model at hand.

    Rows are cut into chunks of bounded size and the model row is repeated per chunk, so a hot
    key spreads over many tasks.
    """
    keys = list(keys)
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / rows_per_chunk).cast("int").alias("__nc"))
    cut = (rows.join(sizes, keys).withColumn("__chunk", F.pmod(F.xxhash64(item), F.col("__nc")).cast("int"))
           .drop("__nc"))
    spread = (model.join(sizes, keys)
              .withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.col("__nc") - 1))).drop("__nc"))
    return (cut.groupBy(*keys, "__chunk").cogroup(spread.groupBy(*keys, "__chunk"))
            .applyInPandas(lambda key, a, b: fn(key[:-1], a, b), ddl))


def loo_ridge(df: DataFrame, keys, item, x, y, k: int = 5, alphas=ALPHAS_LOO, seed: int = 42) -> DataFrame:
    """(keys, fold, target, r, alpha): penalty by leave-one-out error of the training rows.

    The leave-one-out residual of a row needs its leverage, hence a second pass over the rows;
    the model it carries is one eigenbasis per fold.
    """
    import pandas as pd

    keys = list(keys)
    rows = kfold(df.select(*keys, item, F.col(x).cast("array<double>").alias("__x"),
                           F.col(y).cast("array<double>").alias("__y")), keys, item, k, seed)
    parts = moment_parts(rows, [*keys, "fold"], "__x", "__y")

    def models(groups):
        folds = _by_fold(groups)
        whole = _sum(folds.values())
        out = {c: [] for c in ("fold", "n_train", "mu", "ybar", "lam", "q", "rot")}
        for f, test in folds.items():
            g = whole - test
            lam, q = np.linalg.eigh(g.centred_xx())
            for c, v in zip(out, (int(f), int(g.n), g.mx, g.my, np.maximum(lam, 0.0), q.ravel(),
                                  (q.T @ g.centred_xy()).ravel())):
                out[c].append(v)
        return out

    model_ddl = ("fold int, n_train bigint, mu array<double>, ybar array<double>, lam array<double>, "
                 "q array<double>, rot array<double>")
    model = per_group(parts, keys, ["fold"], models, model_ddl)

    def residuals(key, a, b):
        out = {c: [] for c in ("fold", "alpha", "sq")}
        if len(a):
            xs, ys, own = np.vstack(a["__x"]), np.vstack(a["__y"]), a["fold"].to_numpy()
            for m in b.itertuples(index=False):
                use = own != m.fold
                d, v = len(m.mu), len(m.ybar)
                z = (xs[use] - m.mu) @ np.asarray(m.q).reshape(d, d)
                rot = np.asarray(m.rot).reshape(d, v)
                for alpha in alphas:
                    inv = 1.0 / (np.asarray(m.lam) + alpha)
                    lever = 1.0 / m.n_train + (z * z) @ inv
                    res = (ys[use] - m.ybar - z @ (rot * inv[:, None])) / (1.0 - lever)[:, None]
                    out["fold"].append(m.fold)
                    out["alpha"].append(alpha)
                    out["sq"].append(float((res ** 2).sum()))
        frame = pd.DataFrame(out)
        for at, (name, value) in enumerate(zip(keys, key)):
            frame.insert(at, name, [value] * len(frame))
        return frame

    key_ddl = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keys)
    loss = apply_in_chunks(rows, model, keys, item, residuals, key_ddl + "fold int, alpha double, sq double")
    chosen = (loss.groupBy(*keys, "fold", "alpha").agg(F.sum("sq").alias("sq"))
              .groupBy(*keys, "fold").agg(F.min_by("alpha", F.struct("sq", "alpha")).alias("alpha")))

    def score(key, p, c):
        pick = dict(zip(c["fold"], c["alpha"]))
        folds = {f: assemble(int(g["d"].iloc[0]), g["part"], g["vals"]) for f, g in p.groupby("fold")}
        whole = _sum(folds.values())
        out = []
        for f, test in folds.items():
            w, b = _with_intercept(whole - test, pick[f])
            r = Scores(len(b)).add(test, w, b).r()
            out.append(pd.DataFrame({"fold": f, "target": np.arange(len(r)), "r": r, "alpha": pick[f], "n": int(test.n)}))
        frame = pd.concat(out)
        for at, (name, value) in enumerate(zip(keys, key)):
            frame.insert(at, name, [value] * len(frame))
        return frame

    return (parts.groupBy(*keys).cogroup(chosen.groupBy(*keys))
            .applyInPandas(score, key_ddl + "fold int, " + SCORE_FIELDS))


def pca(df: DataFrame, keys: Sequence[str], item: str, vector: str, k: int, out: str = "pc",
        fit_rows: DataFrame | None = None, method: str = "auto") -> DataFrame:
    """Centred PCA scores and the explained share (E1); the basis may come from a subset of rows.

    With fewer than k + 1 rows or dimensions the vectors are kept as they are. Signs are fixed
    by making the largest loading positive. ``gram`` sums d x d products in one pass; ``krylov`` takes a few
    passes without them (see ``krylov_pca``); ``auto`` chooses by the longest vector.
    """
    import pandas as pd

    if method not in ("auto", "gram", "krylov"):
        raise ValueError(f"unknown method: {method}")
    keys = list(keys)
    fitted = df if fit_rows is None else fit_rows
    if method == "auto":
        longest = fitted.agg(F.max(F.size(vector))).first()[0]
        method = "krylov" if (longest or 0) > WIDE else "gram"

    def basis(groups):
        (g,) = groups.values()
        if not (g.d > k and g.n > k):
            return {"mu": [np.zeros(g.d)], "basis": [np.eye(g.d).ravel()], "explained": [1.0]}
        lam, vec = _principal(g.centred_xx() / g.n, g.d)
        head = vec[:, :k]
        head = head * np.sign(head[np.abs(head).argmax(axis=0), np.arange(k)])
        return {"mu": [g.mx], "basis": [head.ravel()], "explained": [float(lam[:k].sum() / max(lam.sum(), 1e-300))]}

    if method == "gram":
        model = per_group(moment_parts(fitted, keys, vector), keys, [], basis, "mu array<double>, basis array<double>, explained double")
    else:
        sizes = fitted.groupBy(*keys).agg((F.count(F.lit(1)) > k).alias("__use"), F.max(F.size(vector)).alias("__d"))
        use = F.col("__use") & (F.col("__d") > k)
        zero = F.transform(F.sequence(F.lit(1), F.col("__d")), lambda i: F.lit(0.0))
        eye = F.transform(F.sequence(F.lit(0), F.col("__d") * F.col("__d") - 1), lambda i: F.when(F.pmod(i, F.col("__d") + 1) == 0, 1.0).otherwise(0.0))
        found = krylov_pca(joined_back(fitted, sizes.where(use), keys), keys, item, vector, k).drop("variances")
        model = found.unionByName(sizes.where(~use).select(*keys, zero.alias("mu"), eye.alias("basis"), F.lit(1.0).alias("explained")))
    key_ddl = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keys)
    item_ddl = f"`{item}` {df.schema[item].dataType.simpleString()}, "

    def project(key, a, b):
        if not len(a):
            return pd.DataFrame(columns=[*keys, item, out, "explained"])
        m = b.iloc[0]
        scores = (np.vstack(a["__x"]) - m["mu"]) @ np.asarray(m["basis"]).reshape(len(m["mu"]), -1)
        frame = pd.DataFrame({item: a[item], out: list(scores), "explained": m["explained"]})
        for at, (name, value) in enumerate(zip(keys, key)):
            frame.insert(at, name, [value] * len(frame))
        return frame

    rows = df.select(*keys, item, F.col(vector).cast("array<double>").alias("__x"))
    return apply_in_chunks(rows, model, keys, item, project, key_ddl + item_ddl + f"`{out}` array<double>, explained double")


def whiten(df: DataFrame, keys: Sequence[str], item: str, vector: str) -> DataFrame:
    """Vectors whose sample covariance within each key is the identity; flat directions are dropped (M3)."""
    import pandas as pd

    keys = list(keys)

    def basis(groups):
        (g,) = groups.values()
        lam, vec = np.linalg.eigh(g.centred_xx() / max(g.n - 1, 1.0))
        keep = lam > 1e-12 * max(lam.max(), 1e-300)
        return {"w": [np.where(keep, vec / np.sqrt(np.where(keep, lam, 1.0)), 0.0).ravel()]}

    model = per_group(moment_parts(df, keys, vector), keys, [], basis, "w array<double>")
    key_ddl = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keys)

    def apply(key, a, b):
        if not len(a):
            return pd.DataFrame(columns=[*keys, item, vector])
        x = np.vstack(a["__x"])
        frame = pd.DataFrame({item: a[item], vector: list(x @ np.asarray(b["w"].iloc[0]).reshape(x.shape[1], -1))})
        for at, (name, value) in enumerate(zip(keys, key)):
            frame.insert(at, name, [value] * len(frame))
        return frame

    rows = df.select(*keys, item, F.col(vector).cast("array<double>").alias("__x"))
    return apply_in_chunks(rows, model, keys, item, apply,
                           key_ddl + f"`{item}` {df.schema[item].dataType.simpleString()}, `{vector}` array<double>")


def mahalanobis_rdm(df: DataFrame, keys: Sequence[str], item: str, vector: str, out: str = "d") -> DataFrame:
    """Euclidean RDM of the whitened vectors (M3)."""
    from .pairs import rdm

    return rdm(whiten(df, keys, item, vector), keys, item, {out: vector}, "euclidean")
