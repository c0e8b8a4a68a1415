"""Bootstrap of given statistics against numpy on the written-out samples."""

import numpy as np
import pytest

from repalign.operators import resample as R


def gini():
    def state(values, m, before, n):
        end = before[:, None] + np.cumsum(m, axis=1)
        ranks = m * (2 * end - m - n)  # sum of 2r + 1 - n over the ranks of one value
        return np.stack([ranks @ values, m @ values], axis=1)

    return R.Statistic(2, state, lambda s, n: s[:, 0] / (n * s[:, 1]))


def gini_of(x):
    x = np.sort(x)
    return np.sum((2 * np.arange(len(x)) + 1 - len(x)) * x) / (len(x) * x.sum())


def trimmed_of(share):
    def f(x):
        cut = int(share * len(x))
        return np.sort(x)[cut:len(x) - cut].mean()
    return f


def written_out(values, group, reps, rows, seed=42):
    """Every resample as a plain array."""
    values, n = np.sort(values), len(values)
    parts = [[] for _ in range(reps)]
    for b in range(-(-n // rows)):
        inside = values[b * rows:(b + 1) * rows]
        own, before = R.block_draws(seed, group, n, b, reps, rows)
        assert before.tolist() == [sum(map(len, p)) for p in parts]
        for at, m in R.multiplicities(seed, group, b, len(inside), own):
            for k, counts in enumerate(m):
                parts[at + k].append(np.repeat(inside, counts))
    return [np.concatenate(p) for p in parts]


@pytest.mark.parametrize("statistic, plain", [
    ("mean", np.mean), ("median", np.median), ("min", np.min), ("max", np.max), (R.quantile(0.3), lambda x: np.quantile(x, 0.3)),
    (R.trimmed_mean(0.1), trimmed_of(0.1)), (gini(), gini_of)])
def test_statistics_equal_numpy(spark, statistic, plain):
    rng = np.random.default_rng(5)
    data = {"a": rng.lognormal(size=333), "b": np.repeat([1.0, 2.0], 20), "c": np.array([7.5]), None: rng.normal(9, 1, 50)}
    rows = [(k, float(v), 1) for k, vs in data.items() for v in vs]
    rows += [("a", None, 1), ("a", float("nan"), 1), ("b", float("inf"), 1), ("gone", None, 1)]
    df = spark.createDataFrame(rows, "k string, v double, rep int")
    df = df.withColumn("g", df.k)
    reps, size = 70, 32
    got = {(r.k, r.rep): r for r in R.resampled(df, ["k"], "v", statistic, reps, block_rows=size).collect()}
    groups = {r.k: r.g for r in df.selectExpr("k", "xxhash64(0, k) AS g").distinct().collect()}
    assert {k for k, _ in got} == set(data) and len(got) == len(data) * (reps + 1)
    for k, values in data.items():
        assert got[k, -1].n == len(values) and np.isclose(got[k, -1].stat, plain(values), rtol=1e-12)
        for rep, sample in enumerate(written_out(values, groups[k], reps, size)):
            assert len(sample) == len(values) and np.isclose(got[k, rep].stat, plain(sample), rtol=1e-12)


def test_draws_are_those_of_sampling_with_replacement():
    n, rows, reps = 100, 16, 4000
    counts = np.concatenate([np.concatenate([m for _, m in R.multiplicities(1, 9, b, min(rows, n - b * rows), R.block_draws(1, 9, n, b, reps, rows)[0])])
                             for b in range(-(-n // rows))], axis=1)
    assert counts.shape == (reps, n) and (counts.sum(axis=1) == n).all()
    assert abs(counts.mean(axis=0) - 1).max() < 0.08 and abs(counts.var(axis=0) - (1 - 1 / n)).max() < 0.15
    between = np.cov(counts.T)
    assert abs(between[~np.eye(n, dtype=bool)].mean() + 1 / n) < 0.002


def test_interval_and_edge_cases(spark):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(float(v),) for v in rng.normal(3, 2, 900)], "v double")
    row = R.bootstrap_statistic(df, [], "v", R.trimmed_mean(0.2), 600, block_rows=128).first()
    assert row.n == 900 and row.ci_low < row.observed < row.ci_high and 0.05 < row.se < 0.09
    assert R.bootstrap_statistic(df.where("v > 1e9"), [], "v", "median", 10).count() == 0
    with pytest.raises(ValueError):
        R.trimmed_mean(0.5)
    with pytest.raises(KeyError):
        R.statistic_of(df, [], "v", "unknown")
