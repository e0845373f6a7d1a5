"""Time the headline queries; prints one JSON line.

Each query runs once to warm up and three times measured; the median counts. Results go to a sink that
discards them, so that all of the result is computed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from repurchase.catalog import load  # noqa: E402

HEADLINE = (
    "repeat_buyer_ranking", "snapshot_all", "l3_train_set", "rolling_all", "rolling_train_set", "rolling_dense",
    "w14_extra", "l1_label_future", "p2_describe_numeric", "p5_summary_table", "c10_range_report", "m4_topn_sweep",
    "m5_label_top_n", "m8_auc", "n2_anova", "n3_mutual_info", "t1_stratified", "t2_ordered", "k2_assign", "k4_fit",
    "k6_predict", "k7_pca",
)
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog = load()
    chosen = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in chosen:
        times = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            catalog[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds_headline_queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
