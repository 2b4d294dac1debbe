"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from siftlake import session
from siftlake.plans import registry

HEADLINE = (
    "flagship_detector_ranking",
    "m1_roc_auc",
    "m2_average_precision",
    "m4_partial_auc",
    "m13_model_centrality",
    "m20_regret",
    "a4_weighted_mean",
    "f15_point_anomaly_series",
    "u5_three_way_split",
    "u8_three_way_block_split",
    "u9_fingerprint",
    "w2_window_statistics",
    "w2_window_descriptor",
    "w7_argmax_triviality",
    "e4_composite_cluster_scores",
    "k2_lof",
    "k3_hbos",
    "k4_ecod",
    "k6_pca",
    "k9_iforest",
    "k14_pool_scores",
    "h4_j8_severity",
    "h5_two_stage_hardening",
    "r1_rank_aggregation",
    "r15_probe_combination",
    "t9_drop_one_detector",
    "g2_subset_memberships",
    "g3_pseudo_auc",
    "y2_histogram_draw",
    "x1_x2_neighbour_structure",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = session.local(cpus, cpus, "12g")
    registry.QUERIES[registry.FLAGSHIP](spark, sf_dir).write.format("noop").mode("overwrite").save()  # classes are loaded once
    times = {}
    for name in HEADLINE:
        began = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").rsplit("/", 1)[-1].removeprefix("sf")}), flush=True)


if __name__ == "__main__":
    main()
