"""Queries without a model take all six subjects."""

import pytest

from repalign.plans import catalog

SF_DIR = "/root/testdata/sf0.001"
COUNTS = {"target_ceiling": "n_subjects", "encoding_noise_ceiling": "n_subjects", "subject_average": "n", "paired_t": "n",
          "rsa_noise_ceiling_pearson": "n_subjects", "rank_reliability": "n"}
ROWS = {"loo_mean": ("item_id", "target", "subject"), "pack_targets": ("subject", "target_block", "item_id")}


@pytest.mark.parametrize("name", COUNTS)
def test_all_subjects_count(spark, name):
    assert {r[0] for r in catalog.QUERIES[name](spark, SF_DIR).select(COUNTS[name]).distinct().collect()} == {6}


@pytest.mark.parametrize("name", ROWS)
def test_all_subjects_have_rows(spark, name):
    assert {r[0] for r in catalog.QUERIES[name](spark, SF_DIR).select("subject").distinct().collect()} == set(range(6))
