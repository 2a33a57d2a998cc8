"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8) choose data and cores.
Each query runs once to warm up and then ``BENCH_RUNS`` (default 3) times; the median counts. A run covers
fitting, transforming and writing the whole result to a sink that discards it. ``BENCH_QUERIES`` may name other
queries, separated by commas, or be ``all``.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

HEADLINE = (
    "missing_profile", "describe_numeric", "skewness_report", "impute_flag_scale", "impute_median", "impute_mode",
    "outlier_report", "outlier_winsorize", "tx_boxcox", "tx_quantile_normal", "scale_robust", "encode_onehot",
    "encode_frequency", "encode_target", "vif", "vif_history", "corr_matrix", "pca", "select_univariate",
    "split_stratified", "impute_knn", "smote", "outlier_isoforest", "train_logreg", "score_batch", "roc_curve",
    "classification_report", "six_steps")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("tabprep-bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from tabprep.queries import QUERIES
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    times = {}
    for name in names:
        took = []
        for _ in range(1 + runs):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        times[name] = round(statistics.median(took[1:]) if runs else took[0], 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total median seconds of the headline queries",
                      "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": scale}))


if __name__ == "__main__":
    main()
