"""Registered queries against their SQL at the smallest scale.

REPALIGN_ALL=1 runs every query; the default takes some of each kind.
"""

import os

import pytest

from oracle import compare, connect
from repalign.plans import catalog

SF_DIR = os.environ.get("REPALIGN_SF_DIR", "/root/testdata/sf0.001")
QUICK = """rdm_euclidean rdm_square_row_sums average_rank rsa_spearman_by_label rsa_pearson rsa_matrix_euclidean_pearson rsa_noise_ceiling
rank_reliability top1_retrieval linear_cka_by_label cka_matrix kernel_cka_fixed_band cosine_streams zscore_rows softmax_top_k kfold_md5
ridge_fold_local_one_feature ridge_loo_one_feature ridge_holdout_one_feature ridge_plain_two_features inner_rows encoding_within_cross
encoding_noise_ceiling bootstrap_ci_mean bootstrap_cka permutation_table perm_two_sample_mean paired_t two_sample_t bh_fdr exact_quantiles
trial_sessions rep_index hemisphere_used shared_trials complete_subjects roi_mask roi_fallback largest_object multi_object_scenes
task_metadata path_resolution mean_pool ablate_noise semantic_vectors normalize_answer vqa_accuracy binding_accuracy language_quality
mc_accuracy performance_drop stage_means peak_layers dissociation_stats interaction win_verdict grid_coherence attention_bins
layer_resample model_convergence""".split()
NAMES = list(catalog.QUERIES) if os.environ.get("REPALIGN_ALL") else QUICK

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    ok, note = compare(spark, con, SF_DIR, name, catalog.QUERIES[name], catalog.ORACLE.get(name))
    assert ok, note


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLE) <= set(catalog.QUERIES)
