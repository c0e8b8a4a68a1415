"""Whole reports on hand-made score tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from repalign.operators import summaries as R

RANGES = (("early", 0, 1), ("late", 2, 3), ("beyond", 9, 9))


def test_stage_task_report(spark):
    drops = {"a": [4.0, 2.0, 1.0, 0.0], "b": [0.5, 0.5, None, 6.0], "odd": [9.0] * 4}
    rows = [(t, k, v) for t, vs in drops.items() for k, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "task string, layer int, score double")
    got = {(r["stage"], r["task"]): r for r in R.stage_task_report(df, "task", "score", RANGES, ["a", "b"]).collect()}
    assert set(got) == {(s, t) for s, _, _ in RANGES for t in "ab"}
    assert [got["early", t]["score"] for t in "ab"] == [3.0, 0.5] and [got["late", t]["score"] for t in "ab"] == [0.5, 6.0]
    assert got["early", "b"]["diagonal"] == 3.0 and got["early", "a"]["off_max"] == 0.5 and got["early", "a"]["ratio"] == 6.0
    assert got["late", "a"]["ratio"] == 12.0 and got["beyond", "a"]["ratio"] is None and got["beyond", "a"]["score"] is None
    assert (got["late", "b"]["peak_layer"], got["late", "b"]["peak_score"], got["late", "a"]["peak_layer"]) == (3, 6.0, 0)
    assert R.stage_task_report(df.limit(0), "task", "score", RANGES, ["a", "b"]).count() == 0


def labour(spark, preference):
    """``preference(layer, known)`` is how much stream i of a region is above stream t."""
    rows = [(layer, roi, s, 1.0 + (preference(layer, known) if s == "i" else 0.0)) for layer in range(3)
            for roi, known in R.VISUAL_SCORE.items() for s in "it"]
    df = spark.createDataFrame(rows, "layer int, roi string, stream string, value double")
    known = spark.createDataFrame(list(R.VISUAL_SCORE.items()), "roi string, known double")
    return {r["scope"]: r for r in R.labour_report(df, known, "i", "t").collect()}


def test_labour_report_with_and_without_the_first_layer(spark):
    # layer 0 prefers t everywhere and by so much that the average over all layers is lost
    got = labour(spark, lambda layer, known: -9.0 if layer == 0 else (known or -0.1) * layer)
    assert set(got) == {"L0", "L1", "L2", "all", "beyond first"}
    assert got["L1"]["verdict"] == got["beyond first"]["verdict"] == "DOUBLE" and got["L0"]["verdict"] == "-"
    assert got["L0"]["first_wins"] == 0 and got["L0"]["second_wins"] == got["L0"]["second_n"] == 4
    assert got["all"]["verdict"] == "partial" and got["all"]["first_wins"] == 0
    assert got["beyond first"]["spearman"] > 0.97 and {r["peak_layer"] for r in got.values()} == {1}
    assert got["L0"]["spearman"] is None


def test_variance_report(spark):
    r = spark.createDataFrame([(0, "V", 0.5), (0, "L", 0.4), (0, "VL", 0.6), (1, "V", -0.5), (1, "L", None), (1, "VL", 0.1)], "t int, model string, r double")
    snr = spark.createDataFrame([(0, 1.0)], "t int, snr double")
    a, b = R.variance_report(r, ["t"], snr).orderBy("t").collect()
    assert a["unique_vision"] == pytest.approx(0.2) and a["unique_language"] == pytest.approx(0.11) and a["shared"] == pytest.approx(0.05)
    assert a["noise_ceiling_r2"] == pytest.approx(0.75) and b["noise_ceiling_r2"] is None
    assert b["r2_vision"] == 0.25 and b["unique_vision"] is None


def test_convergence_report(spark):
    rng = np.random.default_rng(2)
    m = {name: rng.standard_normal((4, 3)) for name in "xyz"}
    df = spark.createDataFrame(pd.DataFrame([(n, layer, roi, v[layer, roi]) for n, v in m.items() for layer in range(4) for roi in range(3)],
                                            columns=["model", "layer", "roi", "value"]), "model string, layer int, roi int, value double")
    got = R.convergence_report(df, "model", "roi", "value", ["x", "y", "z"]).toPandas()
    rank = {n: pd.Series(v.ravel()).rank() for n, v in m.items()}
    want = {(a, b): rank[a].corr(rank[b]) for a, b in ("xy", "xz", "yz")}
    assert {(a, b): pytest.approx(r) for a, b, r in zip(got.model_a, got.model_b, got.rho)} == want
    assert got["mean_rho"].unique() == pytest.approx([np.mean(list(want.values()))]) and got["p"].between(0, 1).all()
