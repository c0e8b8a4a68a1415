"""Whitening against numpy's eigenvectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from repalign.llm import whitening


@pytest.mark.parametrize("shape, rank, k", [((200, 30), 30, 8), ((40, 60), 60, 40), ((300, 20), 7, 10), ((5, 3), 3, 3)])
def test_bidiagonalisation(shape, rank, k):
    rng = np.random.default_rng(shape[0])
    x = rng.standard_normal(shape) @ np.diag(10.0 ** -np.linspace(0, 4, shape[1]))
    if rank < min(shape):
        x = rng.integers(-3, 4, (shape[0], rank)) @ rng.integers(-2, 3, (rank, shape[1])).astype(float)
    values, vectors, _ = whitening.bidiagonalise(lambda q, p: ((x @ q) @ (x @ q), (x @ p).T @ (x @ q), x.T @ (x @ q)), shape[1], min(shape), min(k, *shape))
    want = np.linalg.svd(x, compute_uv=False)
    m = min(k, rank, *shape)
    assert len(values) >= m
    assert np.abs(values[:m] - want[:m]).max() <= 1e-13 * want[0]
    assert np.abs(vectors.T @ vectors - np.eye(vectors.shape[1])).max() < 1e-13
    assert np.abs(np.linalg.norm(x @ vectors[:, :m], axis=0) - want[:m]).max() <= 1e-12 * want[0]


def test_repeated_singular_values():
    x = np.eye(12)
    values, vectors, steps = whitening.bidiagonalise(lambda q, p: ((x @ q) @ (x @ q), (x @ p).T @ (x @ q), x.T @ (x @ q)), 12, 12, 12)
    assert steps == 12 and np.allclose(values, 1) and np.allclose(vectors.T @ vectors, np.eye(12))


def plain(vectors, k):
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(axis=0)
    deviation = [int(sum(e * e for e in n * row - s)) for row in x]
    c = ((n * x - s) / n).astype(float)
    values, basis = np.linalg.eigh(c.T @ c / n)
    values, basis = values[::-1][:k], basis[:, ::-1][:, :k]
    return deviation, c @ basis / np.sqrt(values), values / np.trace(c.T @ c / n)


@pytest.mark.parametrize("element", ["float", "double"])
def test_whitened_components(spark, element):
    rng = np.random.default_rng(1)
    good = [[float(np.float32(c)) for c in v] for v in rng.standard_normal((150, 10)) * np.linspace(0.3, 3, 10)]
    good += [good[0], good[0], [5e4] + [0.0] * 9]
    odd = [None, [], [None] + [1.0] * 9, [float("nan")] * 10, [float("inf")] + [0.0] * 9, [1.0] * 4, [1.0] * 4]
    rows = [(k, v, 1) for k, v in enumerate(good + odd)]
    rows[1] = (None, rows[1][1], 1)
    table = spark.createDataFrame(rows, f"vec_id long, embedding array<{element}>, label int").withColumn("n", F.lit("x")).withColumn("x", F.lit("y")).repartition(4)
    got = whitening.whitened_components(table, 8).collect()
    deviation, z, share = plain(good, 8)
    assert len(got) == 8 * len(good) and {r.vec_id for r in got} == {None, *range(len(good))} - {1}
    for r in got:
        i = 1 if r.vec_id is None else r.vec_id
        assert r.n == len(good) and r.deviation == deviation[i] and r.identity_error < 1e-10
        assert abs(abs(r.whitened) - abs(z[i, r.component - 1])) < 1e-8 and abs(r.explained / share[r.component - 1] - 1) < 1e-9
    sign = {c: {np.sign(r.whitened * z[1 if r.vec_id is None else r.vec_id, c - 1]) for r in got if r.component == c and abs(r.whitened) > 1e-6} for c in range(1, 9)}
    assert all(len(s) == 1 for s in sign.values())


def test_few_or_equal_rows(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whitening.whitened_components(make([])).count() == 0
    assert whitening.whitened_components(make([(1, [1.0, 2.0])])).count() == 0
    assert whitening.whitened_components(make([(k, [1.0, 2.0]) for k in range(4)])).count() == 0
    two = whitening.whitened_components(make([(1, [1.0, 2.0, 0.0]), (2, [3.0, 1.0, 0.0]), (3, [1e30] * 3)])).collect()
    assert sorted((r.vec_id, r.component, round(abs(r.whitened), 12), round(r.explained, 12)) for r in two) == [(1, 1, 1.0, 1.0), (2, 1, 1.0, 1.0)]


def test_large_means_and_plain_doubles(spark):
    x = np.random.default_rng(3).standard_normal((300, 6)) * [5, 4, 3, 2, 1, 0.5]
    rows = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(x + 1e9)], "k long, v array<double>")
    model = whitening.fit(rows, "v", 6)
    c = (x + 1e9) - (x + 1e9).astype(np.longdouble).mean(axis=0)
    want = np.linalg.eigvalsh((c.T @ c / 300).astype(float))[::-1]
    assert np.allclose(model.variances, want, rtol=1e-9) and whitening.identity_error(rows, "v", model) < 1e-9
    z = np.array([r.white for r in whitening.transform(rows, "v", model, "white").orderBy("k").collect()])
    assert np.abs(z.T @ z / 300 - np.eye(6)).max() < 1e-9
