"""Time the headline queries and print one JSON line.

Each query is run once to warm up and then three times; the median counts. Queries that
train models run once after the warm-up of the session, because each is minutes of work
in one process.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from riskflow.plans.queries import QUERIES

HEADLINE = [
    "survey_encoded", "fill_mean", "fill_median", "exact_medians", "standardize_lineitem",
    "score_params", "score_requests", "stream_score", "global_rank_lineitem",
    "running_sum_events", "random_folds", "ordered_folds_lineitem", "stratified_folds",
    "gaussian_jitter", "flip_labels", "class_weights", "knn_join", "knn_join_blocked",
    "knn_classify", "cv_knn", "binary_metrics", "weighted_metrics", "auc_exact", "auc_binned",
    "auc_lineitem", "roc_curve", "fold_report_params", "bootstrap_metrics",
    "bootstrap_multinomial", "reliability_score",
]
TRAINING = ["params_export", "cv_logreg", "cv_logreg_balanced", "cv_forest", "cv_rbf_svm"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = set(sys.argv[1:])
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("riskflow-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times: dict[str, float] = {}
    for name in HEADLINE + TRAINING:
        if only and name not in only:
            continue
        if name in TRAINING:
            times[name] = run(name)
        else:
            run(name)
            times[name] = statistics.median(run(name) for _ in range(3))
        print(f"{name}: {times[name]:.2f}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": {n: round(t, 3) for n, t in times.items()},
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
