"""Long vectors: the n x n ridge, PCA without d x d matrices, permuted targets as columns of one fit."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from repalign.operators import inference as I, moments as M, order as O, ridge as G, wide as W
from test_numeric import folds_of, pearson, ridge


def frame(spark, groups):
    rows = [(g, int(i), [float(c) for c in a], [float(c) for c in b]) for g, (x, y) in groups.items() for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "g string, item bigint, x array<double>, y array<double>").repartition(5)


def scores(df):
    return {(r["g"], r["target"]): r["r"] for r in df.collect()}


@pytest.mark.parametrize("k_pca", [None, 30])
def test_rows_and_sums_give_equal_ridge(spark, k_pca):
    """n = 100 rows of d = 512 features, with a group of more rows than features and one with a null key beside it."""
    rng = np.random.default_rng(0)
    x = rng.standard_normal((100, 512)) * np.linspace(0.1, 3, 512) + 5
    y = x[:, :4] @ rng.standard_normal((4, 3)) + rng.standard_normal((100, 3))
    small = rng.standard_normal((90, 6))
    groups = {"wide": (x, y), "tall": (small, small[:, :3] + rng.standard_normal((90, 3))), None: (x[:40], y[:40])}
    df = frame(spark, groups)
    got = {form: scores(G.fold_local_ridge(df, ["g"], "item", "x", "y", alpha=50.0, pca_dim=k_pca, form=form)) for form in G.FORMS}
    assert set(got["auto"]) == {(g, t) for g in groups for t in range(3)}
    for key in got["auto"]:
        assert got["auto"][key] == pytest.approx(got["gram"][key], abs=1e-9) == pytest.approx(got["rows"][key], abs=1e-9)
    fold, yc, pred = folds_of(list(range(100))), y - y.mean(0), np.zeros_like(y)
    for f in range(5):
        tr, te = fold != f, fold == f
        a, b = x[tr], x[te]
        if k_pca:
            vec = np.linalg.svd(a - a.mean(0), full_matrices=False)[2][:k_pca].T
            a, b = (a - x[tr].mean(0)) @ vec, (b - x[tr].mean(0)) @ vec
        mu, sd = a.mean(0), a.std(0) + 1e-8
        pred[te] = (b - mu) / sd @ ridge((a - mu) / sd, yc[tr], 50.0)
    for t in range(3):
        assert got["auto"]["wide", t] == pytest.approx(pearson(pred[:, t], y[:, t]), abs=1e-9)
    with pytest.raises(ValueError):
        G.fold_local_ridge(df, ["g"], "item", "x", "y", form="other")


def test_flat_targets_and_features(spark):
    x = np.zeros((6, 9))
    x[:, 0] = range(6)
    got = scores(G.fold_local_ridge(frame(spark, {"a": (x, np.ones((6, 2)))}), ["g"], "item", "x", "y"))
    assert got == {("a", 0): 0.0, ("a", 1): 0.0}


def planted(rng, n, d, k):
    basis = np.linalg.qr(rng.standard_normal((d, d)))[0]
    spread = np.concatenate([np.linspace(30, 10, k), 2.0 * 0.97 ** np.arange(d - k)])
    return rng.standard_normal((n, d)) * spread @ basis.T + rng.standard_normal(d) * 1e4


def test_krylov_pca_finds_the_planted_space(spark, monkeypatch):
    monkeypatch.setattr(W, "ROWS_PER_CHUNK", 60)
    monkeypatch.setattr(W, "BLOCK_DOUBLES", 500)
    rng = np.random.default_rng(1)
    groups = {g: planted(rng, n, 120, 5) for g, n in (("a", 400), ("b", 150))}
    df = frame(spark, {g: (x, x[:, :1]) for g, x in groups.items()})
    for r in W.krylov_pca(df, ["g"], "item", "x", 5).collect():
        x = groups[r["g"]]
        lam, vec = np.linalg.eigh(np.cov(x.T, bias=True))
        lam, vec = lam[::-1], vec[:, ::-1]
        basis = np.array(r["basis"]).reshape(120, 5)
        assert np.linalg.norm(basis @ basis.T - vec[:, :5] @ vec[:, :5].T, 2) < 1e-6
        np.testing.assert_allclose(r["variances"], lam[:5], rtol=1e-9)
        assert r["explained"] == pytest.approx(lam[:5].sum() / lam.sum(), rel=1e-9)
        assert np.abs(basis.T @ basis - np.eye(5)).max() < 1e-10


def test_pca_methods_agree(spark):
    rng = np.random.default_rng(2)
    groups = {"a": planted(rng, 200, 40, 3), "few": rng.standard_normal((2, 40)), "flat": np.ones((30, 40)), "low": rng.standard_normal((50, 2)) @ rng.standard_normal((2, 40))}
    df = frame(spark, {g: (x, x[:, :1]) for g, x in groups.items()})
    got = {m: {(r["g"], r["item"]): r for r in G.pca(df, ["g"], "item", "x", 3, method=m).collect()} for m in ("gram", "krylov", "auto")}
    assert set(got["gram"]) == set(got["krylov"]) == set(got["auto"])
    for key, r in got["krylov"].items():
        want = got["gram"][key]
        width = {"a": 3, "few": 40, "flat": 0, "low": 2}[key[0]]
        np.testing.assert_allclose(r["pc"][:width], want["pc"][:width], atol=1e-6)
        if key[0] != "flat":
            assert r["explained"] == pytest.approx(want["explained"], abs=1e-9)


@pytest.mark.parametrize("reps_per_fit", [256, 3])
def test_null_ridge_equals_a_fit_per_replicate(spark, reps_per_fit):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 7))
    df = frame(spark, {"a": (x, x[:, :2] + rng.standard_normal((60, 2))), None: (x[:30], x[:30, 3:5] ** 2)})
    got = {(r["g"], r["rep"], r["target"]): r["r"] for r in G.null_ridge(df, ["g"], "item", "x", "y", 7, alpha=3.0, reps_per_fit=reps_per_fit).collect()}
    null = G.fold_local_ridge(I.shuffled_targets(df.where("g is not null"), ["g"], "item", "y", 7), ["g", "rep"], "item", "x", "y", alpha=3.0).collect()
    real = scores(G.fold_local_ridge(df, ["g"], "item", "x", "y", alpha=3.0))
    assert len(got) == 2 * 8 * 2
    for r in null:
        assert got[r["g"], r["rep"], r["target"]] == pytest.approx(r["r"], abs=1e-9)
    for (g, t), r in real.items():
        assert got[g, -1, t] == pytest.approx(r, abs=1e-9)


def test_null_ridge_has_one_gram_per_fold(spark, monkeypatch):
    made = []
    parts = M.moment_parts
    monkeypatch.setattr(G, "moment_parts", lambda df, keys, *a: made.append(parts(df, keys, *a)) or made[-1])
    x = np.random.default_rng(4).standard_normal((50, 3))
    G.null_ridge(frame(spark, {"a": (x, x)}), ["g"], "item", "x", "y", 200)
    (table,) = made
    assert {(r["g"], r["fold"], r["part"]) for r in table.collect()} == {("a", f, p) for f in range(5) for p in (-1, 0)} and table.count() == 10
