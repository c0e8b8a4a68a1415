"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from repalign.plans import catalog  # noqa: E402
from repalign.session import local_session  # noqa: E402

HEADLINE = (
    "rdm_correlation", "rsa_spearman", "rsa_spearman_by_label", "rsa_pearson", "rsa_matrix_spearman", "rsa_noise_ceiling_pearson",
    "top1_retrieval", "linear_cka", "cka_matrix", "kernel_cka_by_label", "kernel_cka_fixed_band",
    "encoding_layer_subject", "encoding_nested", "encoding_optimistic", "encoding_loo", "encoding_within_cross",
    "encoding_cross_modal", "encoding_token_spatial", "encoding_semantic", "target_ceiling",
    "bootstrap_ci_mean", "bootstrap_cka", "perm_cka", "perm_two_sample_mean", "bh_fdr", "null_encoder",
    "trial_sessions", "largest_object", "task_metadata", "path_resolution", "language_quality", "vqa_accuracy",
    "binding_accuracy", "attention_distance",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
