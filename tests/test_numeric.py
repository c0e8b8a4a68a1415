"""Operators against direct numpy computation, planted signals and edge cases."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from repalign.operators import inference as I, order as O, pairs as P, rankpairs as K, ridge as G, similarity as S, summaries as R


def pearson(a, b):
    a, b = a - a.mean(), b - b.mean()
    return float((a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum()))


def ranks(x):
    return pd.Series(x).rank().to_numpy()


def folds_of(ids, k=5, seed=42):
    order = sorted(range(len(ids)), key=lambda t: hashlib.md5(f"{seed}-{ids[t]}".encode()).hexdigest())
    out = np.empty(len(ids), int)
    for f, part in enumerate(np.array_split(order, k)):
        out[part] = f
    return out


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    n, d, v = 90, 12, 5
    x = rng.standard_normal((n, d)) * np.linspace(0.5, 3, d) + 1.0
    y = x @ rng.standard_normal((d, v)) * 0.2 + rng.standard_normal((n, v)) + 2.0
    pdf = pd.DataFrame({"g": 0, "item": np.arange(n) + 10, "x": list(x), "y": list(y)})
    df = spark.createDataFrame(pdf, "g int, item bigint, x array<double>, y array<double>").repartition(5).cache()
    return df, x, y, pdf["item"].to_numpy()


def by_target(df, col="r"):
    return np.array([r[col] for r in sorted(df.collect(), key=lambda r: r["target"])])


def ridge(x, y, a):
    return np.linalg.solve(x.T @ x + a * np.eye(x.shape[1]), x.T @ y)


@pytest.mark.parametrize("k_pca", [None, 4])
def test_fold_local_ridge(data, k_pca):
    df, x, y, ids = data
    fold, yc, pred = folds_of(ids), y - y.mean(0), np.zeros_like(y)
    for f in range(5):
        tr, te = fold != f, fold == f
        a, b = x[tr], x[te]
        if k_pca:
            mu = a.mean(0)
            vec = np.linalg.eigh(np.cov(a.T))[1][:, ::-1][:, :k_pca]
            a, b = (a - mu) @ vec, (b - mu) @ vec
        mu, sd = a.mean(0), a.std(0) + 1e-8
        pred[te] = (b - mu) / sd @ ridge((a - mu) / sd, yc[tr], 100.0)
    want = [pearson(pred[:, j], y[:, j]) for j in range(y.shape[1])]
    got = by_target(G.fold_local_ridge(df, ["g"], "item", "x", "y", alpha=100.0, pca_dim=k_pca))
    np.testing.assert_allclose(got, want, atol=1e-9)


def test_nested_ridge(data):
    df, x, y, ids = data
    fold, yc, pred, alphas = folds_of(ids), y - y.mean(0), np.zeros_like(y), (1.0, 30.0, 1000.0)
    for f in range(5):
        tr, te = np.flatnonzero(fold != f), fold == f
        mu, sd = x[tr].mean(0), x[tr].std(0) + 1e-8
        a, b, t = (x[tr] - mu) / sd, (x[te] - mu) / sd, yc[tr]
        m = max(1, len(tr) // 5)
        score = [np.mean([pearson((a[-m:] @ ridge(a[:-m], t[:-m], al))[:, j], t[-m:, j]) for j in range(y.shape[1])]) for al in alphas]
        pred[te] = b @ ridge(a, t, alphas[int(np.argmax(score))])
    want = [pearson(pred[:, j], y[:, j]) for j in range(y.shape[1])]
    got = by_target(G.nested_ridge(df, ["g"], "item", "x", "y", alphas=alphas))
    np.testing.assert_allclose(got, want, atol=1e-9)


def test_optimistic_ridge(data):
    df, x, y, ids = data
    fold, yc, pred, alphas = folds_of(ids), y - y.mean(0), np.zeros_like(y), (1.0, 30.0, 1000.0)
    z = (x - x.mean(0)) / (x.std(0) + 1e-8)
    z = (z - z.mean(0)) @ np.linalg.eigh(np.cov(z.T))[1][:, ::-1][:, :6]
    for f in range(5):
        tr, te = fold != f, fold == f
        path = [z[te] @ ridge(z[tr], yc[tr], al) for al in alphas]
        score = [np.mean([pearson(p[:, j], yc[te][:, j]) for j in range(y.shape[1])]) for p in path]
        pred[te] = path[int(np.argmax(score))]
    want = [pearson(pred[:, j], y[:, j]) for j in range(y.shape[1])]
    got = by_target(G.optimistic_ridge(df, ["g"], "item", "x", "y", alphas=alphas, n_components=6))
    np.testing.assert_allclose(got, want, atol=1e-8)


def test_loo_ridge(data):
    df, x, y, ids = data
    fold, alphas = folds_of(ids), (0.1, 10.0, 300.0)
    got = G.loo_ridge(df, ["g"], "item", "x", "y", alphas=alphas).toPandas()
    for f in range(5):
        tr, te = fold != f, fold == f
        a, t = x[tr], y[tr]
        errors = []
        for al in alphas:
            e = []
            for i in range(len(a)):
                keep = np.arange(len(a)) != i
                # leaving a row out keeps the centre of the full training part in the closed form
                mu, yb = a.mean(0), t.mean(0)
                z = a - mu
                h = 1 / len(a) + z[i] @ np.linalg.solve(z.T @ z + al * np.eye(x.shape[1]), z[i])
                e.append((t[i] - yb - z[i] @ ridge(z, t - yb, al)) / (1 - h))
                assert keep.sum() == len(a) - 1
            errors.append(np.mean(np.square(e)))
        al = alphas[int(np.argmin(errors))]
        mu, yb = a.mean(0), t.mean(0)
        pred = yb + (x[te] - mu) @ ridge(a - mu, t - yb, al)
        rows = got[got.fold == f].sort_values("target")
        assert (rows.alpha == al).all()
        np.testing.assert_allclose(rows.r, [pearson(pred[:, j], y[te][:, j]) for j in range(y.shape[1])], atol=1e-9)


def test_holdout_ridge(data):
    df, x, y, ids = data
    alphas, k = (1.0, 50.0, 2000.0), 5
    test = df.where("item % 3 = 0")
    got = G.holdout_ridge(df, {"within": test, "cross": test.withColumn("y", F.reverse("y"))}, ["g"], "item", "x", "y", alphas, k).toPandas()
    sd = x.std(0)
    z = (x - x.mean(0)) / sd
    z = z @ np.linalg.eigh(np.cov(z.T))[1][:, ::-1][:, :k]
    cut = int(len(x) * 0.8)

    def fit(a, t, al):
        w = ridge(a - a.mean(0), t - t.mean(0), al)
        return lambda b: t.mean(0) + (b - a.mean(0)) @ w

    score = [np.mean([pearson(fit(z[:cut], y[:cut], al)(z[cut:])[:, j], y[cut:, j]) for j in range(y.shape[1])]) for al in alphas]
    pred = fit(z, y, alphas[int(np.argmax(score))])(z)
    sel = ids % 3 == 0
    for name, target in (("within", y), ("cross", y[:, ::-1])):
        rows = got[got.condition == name].sort_values("target")
        np.testing.assert_allclose(rows.r, [pearson(pred[sel][:, j], target[sel][:, j]) for j in range(y.shape[1])], atol=1e-9)


def test_planted_signal_and_shuffle(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((200, 16))
    y = x @ rng.standard_normal((16, 4)) + 0.05 * rng.standard_normal((200, 4))
    df = spark.createDataFrame(pd.DataFrame({"g": 0, "item": np.arange(200), "x": list(x), "y": list(y)}),
                               "g int, item bigint, x array<double>, y array<double>")
    assert by_target(G.fold_local_ridge(df, ["g"], "item", "x", "y", alpha=1.0)).min() > 0.99
    null = I.shuffled_targets(df, ["g"], "item", "y", 4)
    r = G.fold_local_ridge(null, ["g", "rep"], "item", "x", "y", alpha=1.0).agg(F.avg("r")).first()[0]
    assert abs(r) < 0.15


def test_constant_target_scores_zero(spark):
    rng = np.random.default_rng(0)
    y = np.column_stack([np.full(40, 3.0), rng.standard_normal(40)])
    df = spark.createDataFrame(pd.DataFrame({"g": 0, "item": np.arange(40), "x": list(rng.standard_normal((40, 3))), "y": list(y)}),
                               "g int, item bigint, x array<double>, y array<double>")
    assert by_target(G.fold_local_ridge(df, ["g"], "item", "x", "y"))[0] == 0.0
    r = G.holdout_ridge(df, {"t": df}, ["g"], "item", "x", "y").where("target = 0").first()["r"]
    assert r is None


def test_pca(data):
    df, x, _, ids = data
    got = G.pca(df, ["g"], "item", "x", 3).toPandas().sort_values("item")
    z = np.vstack(got["pc"])
    lam, vec = np.linalg.eigh(np.cov(x.T))
    want = (x - x.mean(0)) @ vec[:, ::-1][:, :3]
    np.testing.assert_allclose(np.abs(z), np.abs(want), atol=1e-8)
    assert got["explained"].iloc[0] == pytest.approx(lam[::-1][:3].sum() / lam.sum())


def test_cka_against_numpy_and_rotation(data):
    df, x, y, _ = data
    xc, yc = x - x.mean(0), y - y.mean(0)
    want = np.linalg.norm(yc.T @ xc) ** 2 / np.linalg.norm(xc.T @ xc) / np.linalg.norm(yc.T @ yc)
    assert S.linear_cka(df, ["g"], "x", "y", 12, 5).first()["cka"] == pytest.approx(want)
    q = np.linalg.qr(np.random.default_rng(3).standard_normal((12, 12)))[0]
    turned = df.sparkSession.createDataFrame(pd.DataFrame({"g": 0, "x": list(x @ q), "y": list(y)}), "g int, x array<double>, y array<double>")
    assert S.linear_cka(turned, ["g"], "x", "y", 12, 5).first()["cka"] == pytest.approx(want)

    def kernel(z, s):
        d2 = ((z[:, None] - z[None]) ** 2).sum(-1)
        c = np.eye(len(z)) - 1 / len(z)
        return c @ np.exp(-d2 / (2 * s * s)) @ c

    def med(z):
        return np.median(np.sqrt(((z[:, None] - z[None]) ** 2).sum(-1))[np.triu_indices(len(z), 1)])

    s = (med(x) + med(y)) / 2
    a, b = kernel(x, s), kernel(y, s)
    want = (a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum())
    assert S.kernel_cka(df, ["g"], "item", "x", "y", rows_per_block=20).first()["cka"] == pytest.approx(want)


def corr_rdm(z):
    return 1 - np.corrcoef(z)[np.triu_indices(len(z), 1)]


def test_mahalanobis(data):
    df, x, _, ids = data
    got = G.mahalanobis_rdm(df, ["g"], "item", "x").orderBy("i", "j").toPandas()["d"]
    inv, diff = np.linalg.inv(np.cov(x.T)), (x[:, None] - x[None])[np.triu_indices(len(x), 1)]
    np.testing.assert_allclose(got, np.sqrt(np.einsum("pi,ij,pj->p", diff, inv, diff)), atol=1e-9)


@pytest.mark.parametrize("rows", [13, 256])
def test_rsa_tiles(data, rows):
    df, x, y, _ = data
    a, b = corr_rdm(x), corr_rdm(y)
    got = K.rank_correlations(df, ["g"], "item", ["x", "y"], [(0, 1)], rows_per_block=rows).first()
    assert got["r"] == pytest.approx(pearson(ranks(a), ranks(b)), abs=1e-10) and got["n_pairs"] == len(a)
    assert K.distance_correlations(df, ["g"], "item", ["x", "y"], [(0, 1)], rows_per_block=rows).first()["r"] == pytest.approx(pearson(a, b))
    assert S.pearson_rsa(df, ["g"], "x", "y", 12, 5).first()["rsa"] == pytest.approx(pearson(a, b))


def test_rsa_with_copies_and_constant_rows(spark):
    """A third of the items are copies of one vector and some rows are constant: many tied distances."""
    rng = np.random.default_rng(5)
    x = np.vstack([np.repeat(rng.standard_normal((1, 6)), 30, 0), rng.standard_normal((55, 6)), np.full((5, 6), 2.0)])
    y = rng.standard_normal((90, 6))
    df = spark.createDataFrame(pd.DataFrame({"g": 0, "item": np.arange(90), "x": list(x), "y": list(y)}), "g int, item bigint, x array<double>, y array<double>")

    def rdm(z):
        u = z - z.mean(1, keepdims=True)
        u = u / np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-8)
        return np.round(1 - np.clip(u @ u.T, -1, 1), 12)[np.triu_indices(len(z), 1)]

    got = K.rank_correlations(df, ["g"], "item", ["x", "y"], [(0, 1)], rows_per_block=25).first()["r"]
    assert got == pytest.approx(pearson(ranks(rdm(x)), ranks(rdm(y))), abs=2e-3)
    assert S.pearson_rsa(df, ["g"], "x", "y", 6, 6).first()["rsa"] == pytest.approx(pearson(rdm(x), rdm(y)), abs=1e-9)


def test_relabelling_keeps_rsa(data):
    df, *_ = data
    a = S.rsa(df, ["g"], "item", "x", "y").first()["rsa"]
    b = S.rsa(df.withColumn("item", (F.col("item") * 7919) % 100003), ["g"], "item", "x", "y").first()["rsa"]
    assert a == pytest.approx(b)


def small_bounds(monkeypatch, rows):
    monkeypatch.setattr(O, "GROUP_ROWS", rows)
    monkeypatch.setattr(O, "RANGE_ROWS", max(1, rows // 2))


@pytest.mark.parametrize("rows", [1_000_000, 20])
def test_average_rank_in_windows_and_ranges(spark, monkeypatch, rows):
    small_bounds(monkeypatch, rows)
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"k": rng.integers(0, 3, 3000), "v": np.where(rng.random(3000) < 0.4, -0.25, rng.standard_normal(3000).round(2)), "u": rng.integers(0, 9, 3000)})
    pdf.loc[:50, "v"] = 0.0
    got = O.average_ranks(spark.createDataFrame(pdf), ["k"], {"v": "rank", "u": "other"}).toPandas()
    np.testing.assert_allclose(got["rank"], got.groupby("k")["v"].rank())
    np.testing.assert_allclose(got["other"], got.groupby("k")["u"].rank())
    assert len(got) == len(pdf)


def test_ranges_of_timestamps_and_of_equal_values(spark, monkeypatch):
    """200,000 consecutive microseconds, and as many equal values told apart by their ids, spread over ranges."""
    small_bounds(monkeypatch, 20_000)
    n = 200_000
    rows = spark.range(n).select((F.col("id") % 2).alias("k"), F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id")).alias("t"), F.lit(1.5).alias("v"), F.col("id"), F.md5(F.col("id").cast("string")).alias("h"))
    for by in (["t"], ["v", "id"], ["h"]):
        ranged = O.in_ranges(rows, ["k"], by)
        sizes = [r["count"] for r in ranged.groupBy("__g", "__r").count().collect()]
        assert max(sizes) <= O.RANGE_ROWS and sum(sizes) == n and len(sizes) >= 20
        edges = ranged.groupBy("__g", "__r").agg(F.min(F.struct(*by)).alias("lo"), F.max(F.struct(*by)).alias("hi")).orderBy("__g", "__r").collect()
        assert all(a["__g"] != b["__g"] or tuple(a["hi"]) < tuple(b["lo"]) for a, b in zip(edges, edges[1:]))
    got = O.position_by_value(rows, ["k"], "v", ["id"]).where((F.col("pos") != F.floor(F.col("id") / 2)) | (F.col("n") != n // 2))
    assert got.count() == 0
    assert O.average_rank(rows, ["k"], "v").where(F.col("rank") != (n / 2 + 1) / 2).count() == 0


def test_split_codes_keep_order():
    v = np.random.default_rng(4).standard_normal(500)
    assert (np.diff(K.bucket_codes(np.sort(v), 64.0)) >= 0).all()


@pytest.mark.parametrize("rows", [1_000_000, 30])
def test_order_of_all_kinds(spark, monkeypatch, rows):
    small_bounds(monkeypatch, rows)
    rng = np.random.default_rng(5)
    n = 400
    v = rng.choice([0.0, -1.5, 2.25, np.nan, np.inf, -np.inf, 1e-300, 7.0], n)
    pdf = pd.DataFrame({"k": rng.choice(["a", None], n), "v": v, "i": rng.permutation(n), "s": [f"{x:04d}" * 12 for x in rng.integers(0, 90, n)]})
    df = spark.createDataFrame([(k, None if i % 11 == 0 else float(x), int(i), s) for k, x, i, s in pdf.itertuples(index=False)], "k string, v double, i long, s string")
    table = [tuple(r) for r in df.collect()]
    last = lambda x: (x is None, x is not None and x != x, 0 if x is None or x != x else x)
    for by, key in ((["v", "i"], lambda r: (last(r[1]), r[2])), (["s", "v", "i"], lambda r: (r[3], last(r[1]), r[2]))):
        want = {}
        for k in ("a", None):
            for p, r in enumerate(sorted((r for r in table if r[0] == k), key=key)):
                want[r[2]] = p
        got = {r["i"]: r["pos"] for r in O.ordered_position(df, ["k"], by).collect()}
        assert got == want


@pytest.mark.parametrize("rows", [1_000_000, 30])
def test_exact_quantiles(spark, monkeypatch, rows):
    small_bounds(monkeypatch, rows)
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"k": rng.integers(0, 2, 501), "v": rng.standard_normal(501).round(1)})
    got = O.exact_quantiles(spark.createDataFrame(pdf), ["k"], "v", {"a": 0.0, "b": 0.31, "c": 1.0}).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        np.testing.assert_allclose(got.loc[k, ["a", "b", "c"]], np.quantile(g["v"], [0, 0.31, 1]))


def test_fold_sizes(spark):
    df = spark.range(23).select(F.lit(0).alias("g"), "id")
    sizes = [r["count"] for r in O.kfold(df, ["g"], "id", 5).groupBy("fold").count().orderBy("fold").collect()]
    assert sizes == [5, 5, 5, 4, 4]


def test_bootstrap_rsa_counts_copies_as_zero_distance(spark):
    rng = np.random.default_rng(8)
    n, reps = 9, 6
    a, b = np.abs(rng.standard_normal((2, n, n))) + 0.1
    rows = [(0, i, j, float(a[i, j]), float(b[i, j])) for i in range(n) for j in range(i + 1, n)]
    pairs = spark.createDataFrame(rows, "g int, i bigint, j bigint, a double, b double")
    stats = []
    for rep in range(reps):
        idx = [int(hashlib.md5(f"42-{rep}-{p}".encode()).hexdigest()[:8], 16) % n for p in range(n)]
        get = lambda m, p, q: 0.0 if idx[p] == idx[q] else m[min(idx[p], idx[q]), max(idx[p], idx[q])]
        va, vb = (np.array([get(m, p, q) for p in range(n) for q in range(p + 1, n)]) for m in (a, b))
        stats.append(pearson(ranks(va), ranks(vb)))
    got = I.bootstrap_rsa(pairs, ["g"], "a", "b", reps).first()
    assert got["ci_low"] == pytest.approx(np.percentile(stats, 2.5))
    assert got["se"] == pytest.approx(np.std(stats))


def test_benjamini_hochberg(spark):
    p = np.array([0.001, 0.2, 0.03, 0.03, 0.9, 0.0, 0.04])
    got = I.benjamini_hochberg(spark.createDataFrame(pd.DataFrame({"k": 0, "p": p})), ["k"], "p").toPandas().sort_values("p")
    s = np.sort(p)
    want = np.minimum(np.minimum.accumulate((s * len(s) / np.arange(1, len(s) + 1))[::-1])[::-1], 1)
    np.testing.assert_allclose(got["adjusted_p"], want)
    assert I.fdr_summary(spark.createDataFrame(got), ["k"], "p").first()["threshold"] == s[want <= 0.05].max()


# Published t statistics with five degrees of freedom and their p.
PUBLISHED = ((5.28, 0.0033), (4.49, 0.0065), (4.81, 0.0048), (7.73, 0.0006), (1.99, 0.1027), (3.30, 0.0214))


def test_student_tail():
    from repalign.functions.tails import student_two_sided

    for t, p in PUBLISHED:
        assert student_two_sided(t, 5) == pytest.approx(p, abs=1e-3)
    assert student_two_sided(2.0, 1) == pytest.approx(2 * (0.5 - np.arctan(2.0) / np.pi))
    assert np.isnan(student_two_sided(1.0, 0))


def test_mann_whitney_exact():
    from itertools import combinations

    from repalign.functions.tails import mann_whitney_greater

    u = [sum(c) - 6 for c in combinations(range(1, 10), 3)]
    for x in (0, 7, 12, 18):
        assert mann_whitney_greater(x, 3, 6, 0) == pytest.approx(np.mean(np.array(u) >= x))


def test_paired_t_single_row(spark):
    row = I.paired_t(spark.createDataFrame([(0, 1.0, 0.5)], "k int, a double, b double"), ["k"], "a", "b").first()
    assert (row["t"], row["p"], row["n_pos"]) == (0.0, 1.0, 1)


def test_ceiling_needs_two_subjects(spark):
    one = spark.createDataFrame([("s", 1, 0, 0.5), ("s", 2, 0, 0.7)], "subject string, item int, target int, value double")
    assert I.target_ceiling(one, [], "subject", "item", "target", "value").count() == 0


def test_square_view(spark):
    pairs = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.25), (2, 3, 1.0)], "i bigint, j bigint, d double")
    sq = P.square_view(pairs, "d").toPandas().pivot(index="i", columns="j", values="d").to_numpy()
    np.testing.assert_allclose(sq, [[0, 0.5, 0.25], [0.5, 0, 1], [0.25, 1, 0]])


def test_peak_ignores_missing_and_prefers_first(spark):
    rows = [("a", 0, None), ("a", 1, 0.4), ("a", 2, 0.4), ("b", 0, float("nan")), ("b", 5, -0.2)]
    got = {r["roi"]: r["peak_layer"] for r in R.peak(spark.createDataFrame(rows, "roi string, layer int, r double"), ["roi"], "layer", "r").collect()}
    assert got == {"a": 1, "b": 5}


@pytest.mark.parametrize("call", [
    lambda df: P.rdm(df, ["g"], "i", {"d": "a"}, "cosine"),
    lambda df: I.permutation_test(df, [], "i", F.lit(True), "a", 2, "median"), lambda df: S.cka(df, ["g"], "i", "a", "b", 1, 1, "poly")])
def test_unknown_names_are_errors(spark, call):
    with pytest.raises(ValueError):
        call(spark.createDataFrame([(0, 1, 2.0, 3.0)], "g int, i int, a double, b double"))


ODD = [(None, 2.0, 1), (None, 1.0, 2), ("a", None, 3), ("a", float("nan"), 4), ("a", float("inf"), 5), ("a", float("-inf"), 6), ("a", -3.0, 7), ("a", 1e-320, 8), ("a", 3.0, 9), ("a", None, 10)]


@pytest.mark.parametrize("rows", [1_000_000, 2])
def test_order_keeps_nulls_nan_infinities_and_null_keys(spark, monkeypatch, rows):
    small_bounds(monkeypatch, rows)
    df = spark.createDataFrame(ODD, "k string, v double, i int")
    pos = {r["i"]: (r["pos"], r["n"]) for r in O.position_by_value(df, ["k"], "v", ["i"]).collect()}
    assert pos == {2: (0, 2), 1: (1, 2), 6: (0, 8), 7: (1, 8), 8: (2, 8), 9: (3, 8), 5: (4, 8), 4: (5, 8), 3: (6, 8), 10: (7, 8)}
    ranks = {r["i"]: r["rank"] for r in O.average_rank(df, ["k"], "v").collect()}
    assert ranks == {2: 1, 1: 2, 6: 1, 7: 2, 8: 3, 9: 4, 5: 5, 4: 6, 3: None, 10: None}
    assert sorted(r["i"] for r in O.kfold(df, ["k"], "i", 3).collect()) == list(range(1, 11))


@pytest.mark.parametrize("rows", [1_000_000, 3])
def test_fdr_with_ties_nulls_and_null_keys(spark, monkeypatch, rows):
    small_bounds(monkeypatch, rows)
    p = [0.01, 0.04, 0.04, 0.03, 0.5, 1.0, 1.0, 1.0]
    rows = [(k, x) for k in (None, "a") for x in [*p, None]]
    got = I.benjamini_hochberg(spark.createDataFrame(rows, "k string, p double"), ["k"], "p").collect()
    order = np.sort(p)
    step = np.minimum.accumulate((order * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1]
    want = {x: min(1.0, step[np.searchsorted(order, x)]) for x in p}
    assert len(got) == len(rows)
    for r in got:
        assert r["adjusted_p"] is None if r["p"] is None else abs(r["adjusted_p"] - want[r["p"]]) < 1e-12


def test_semantic_basis_is_fitted_on_all_rows(spark, monkeypatch):
    from repalign.operators import features as X

    rng = np.random.default_rng(3)
    sem = spark.createDataFrame([(0, t, i, rng.standard_normal(6).tolist()) for i in range(60) for t in range(2)], "layer int, token int, item bigint, vector array<double>")
    y = spark.createDataFrame([(0, i, rng.standard_normal(3).tolist()) for i in range(60)], "subject int, item bigint, y array<double>")
    run = lambda **o: sorted((r.layer, r.token, r.target, round(r.r, 9)) for r in X.semantic_encoding(sem, y, ["subject"], "item", 3, **o).collect())
    whole, part = run(fit_rows=120), run(fit_rows=20)
    monkeypatch.setattr(X, "random_subset", lambda *a, **o: pytest.fail("rows are drawn"))
    assert run() == whole != part


@pytest.mark.parametrize("offset", [0.0, 1e7])
def test_results_do_not_depend_on_large_means(spark, data, offset):
    """Ridge, CKA, PCA and Pearson RSA of columns whose mean is very far from zero, against the same columns without it."""
    df, x, y, ids = data
    grid = 2.0 ** -20  # so that adding the offset rounds nothing away
    x, y = np.round(x / grid) * grid, np.round(y / grid) * grid
    make = lambda o: spark.createDataFrame(pd.DataFrame({"g": 0, "item": ids, "x": list(x + o), "y": list(y + o)}), "g int, item bigint, x array<double>, y array<double>").repartition(5)
    plain, moved = make(0.0), make(offset)
    for fit in (lambda d: G.fold_local_ridge(d, ["g"], "item", "x", "y", alpha=100.0, pca_dim=4), lambda d: G.nested_ridge(d, ["g"], "item", "x", "y"),
                lambda d: G.optimistic_ridge(d, ["g"], "item", "x", "y", n_components=6)):
        np.testing.assert_allclose(by_target(fit(moved)), by_target(fit(plain)), atol=1e-9)
    for value in (lambda d: S.linear_cka(d, ["g"], "x", "y", 12, 5).first()["cka"], lambda d: G.pca(d, ["g"], "item", "x", 3).first()["explained"],
                  lambda d: S.pearson_rsa(d, ["g"], "x", "y", 12, 5).first()["rsa"]):
        assert value(moved) == pytest.approx(value(plain), abs=1e-9)


def test_moments_merge_and_part(spark):
    from repalign.operators import moments as M

    rng = np.random.default_rng(8)
    x, y = rng.standard_normal((40, 7)) + 1e8, rng.standard_normal((40, 3)) - 1e8
    w = rng.integers(0, 4, 40).astype(float)
    whole = M.Moments.of(x, y, w)
    parts = [M.Moments.of(x[k::3], y[k::3], w[k::3]) for k in range(3)]
    again = M.Moments.of(np.repeat(x, w.astype(int), 0), np.repeat(y, w.astype(int), 0))
    for other in (parts[0] + parts[1] + parts[2], (whole - parts[1]) + parts[1], again):
        assert other.n == whole.n
        np.testing.assert_allclose(other.c, whole.c, atol=1e-5)
        np.testing.assert_allclose(other.cyy, whole.cyy, rtol=1e-7)
    exact = np.cov((np.repeat(x, w.astype(int), 0) - 1e8).T, bias=True) * whole.n
    np.testing.assert_allclose(whole.centred_xx(), exact, atol=1e-5)
    pieces = [M.pieces_of(p) for p in parts]
    built = M.assemble(7, [k for p in pieces for k in p], [v for p in pieces for v in p.values()])
    np.testing.assert_allclose(built.c, whole.c, atol=1e-5)


def test_bootstrap_in_tiles_equals_pairs_with_draws(spark, data, monkeypatch):
    df, *_ = data
    monkeypatch.setattr(P, "ROWS_PER_BLOCK", 16)
    monkeypatch.setattr(P.pack_blocks, "__defaults__", (16,))
    pairs = P.rdm(df, ["g"], "item", {"a": "x", "b": "y"})
    want = I.bootstrap_rsa(pairs, ["g"], "a", "b", 9, "pearson").first()
    got = I.bootstrap_rsa_in_tiles(df, ["g"], "item", "x", "y", 9).first()
    assert [got[c] for c in ("ci_low", "ci_high", "se")] == pytest.approx([want[c] for c in ("ci_low", "ci_high", "se")], abs=1e-9)
