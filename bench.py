"""Time the headline queries and print one JSON line.

BENCH_SF_DIR   input folder (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_QUERIES  comma-separated names, or "all"
BENCH_RUNS     timed runs per query; the median counts (default 1, after one warm-up)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.queries import QUERIES  # noqa: E402

HEADLINE = (
    "monthly_trends", "describe_table", "densify_full", "missing_months_per_entity",
    "rolling_mean_impute", "forward_fill", "fill_across_entities", "impute_chain",
    "lag_features", "group_mean_feature", "feature_bundle", "feature_bundle_rounds",
    "model_matrix", "series_extract", "correlation_matrix", "correlation_matrix_wide",
    "standard_scale", "minmax_scale", "median_impute", "column_profile",
    "sequence_window", "sequences_io", "sequences_across_entities",
    "isolation_forest_fit", "isolation_forest_score", "pseudo_label", "forest_importance",
    "permutation_importance", "reconstruction_fit", "reconstruction_score",
)


def run(spark: SparkSession, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = list(QUERIES) if wanted == "all" else wanted.split(",") if wanted else HEADLINE
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("panel-bench")
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.driver.memory", "16g")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        run(spark, name, sf_dir)
        seconds[name] = round(statistics.median(run(spark, name, sf_dir) for _ in range(runs)), 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
