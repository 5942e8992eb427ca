"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from graphloom import catalog  # noqa: E402
from graphloom.session import local_session  # noqa: E402

HEADLINE = [
    "s03_decode_text", "s05_encode_text", "f02_degrees", "f03_bipartite", "f04_connected", "f05_diameter", "f07_triangles",
    "f08_clustering", "f10_matching_exact", "f12_spectral_gap", "f15_f16_rich_spectrum", "f17_f18_pauli_terms",
    "f17_f18_pauli_terms_wide", "f20_wl_keys", "f24_feature_table_with_gap", "g01_g06_g07_random_graphs",
    "w01_balanced_within_size", "w02_stratified_split", "a01_balance_report", "a10_medians", "a12_correlation",
    "t03_zscore_within_size", "e01_e09_all_metrics", "e10_w09_roc_points", "e12_calibration_quantile",
    "e18_label_free_report", "e20_overlap_report", "m02_naive_bayes", "m05_knn_classifier", "i01_incremental_features",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=16)
    spark.sparkContext.setLogLevel("ERROR")
    # The tables are small and the work per graph is not: keep more, smaller partitions
    # (BENCH_DEFAULTS=1 leaves Spark's own sizes). The settings stand beside the figures.
    settings = {} if os.environ.get("BENCH_DEFAULTS") else {
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k", "spark.sql.files.maxPartitionBytes": "2m"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    queries = catalog.queries()
    queries["a01_balance_report"](spark, sf_dir).collect()  # start the workers
    times = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total seconds of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "settings": settings, "sf": sf_dir.rstrip("/").split("sf")[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
