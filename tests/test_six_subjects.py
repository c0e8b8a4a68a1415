"""The remaining queries without a model take all six subjects, too."""

import numpy as np
import pytest

from repalign.plans import catalog

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def answers(spark):
    """Labels and values by item, subject and target."""
    rows = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").orderBy("vec_id").collect()
    return np.array([r["vec_id"] for r in rows]), np.array([r["label"] for r in rows]), np.array([r["embedding"][:48] for r in rows]).reshape(-1, 6, 8)


def test_counts(spark):
    assert {r["n"] for r in catalog.QUERIES["snr_ceiling"](spark, SF_DIR).collect()} == {48}
    assert catalog.QUERIES["rsa_noise_ceiling"](spark, SF_DIR).first()["n_subjects"] == 6


def test_r_by_target_pools_six_subjects(spark, answers):
    ids, labels, x = answers
    for r in catalog.QUERIES["pearson_by_target"](spark, SF_DIR).collect():
        own = labels == r["label"]
        want = np.corrcoef(x[own, :, r["target"]].ravel(), np.repeat(ids[own], 6))[0, 1]
        assert r["r"] == pytest.approx(want, abs=2e-6)


def test_raw_score_averages_six_subjects(spark, answers):
    _, labels, x = answers
    loo = (x.sum(axis=1, keepdims=True) - x) / 5
    for r in catalog.QUERIES["ceiling_normalised_encoder"](spark, SF_DIR).collect():
        own = labels == r["roi"]
        want = np.mean([np.corrcoef(x[own, s, t], x[own, s, t] * loo[own, s, t])[0, 1] for s in range(6) for t in range(8)])
        assert r["raw_all"] == pytest.approx(want, abs=2e-6)
