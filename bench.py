"""Times the headline queries and prints one JSON line.

Every query is run once to warm up and three times measured; its full result goes to a
no-op sink. The reported value is the sum of the medians.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from registry.queries import bind  # noqa: E402

HEADLINE = [
    "transaction_id_md5",
    "int_customer_transaction_features",
    "dim_customer",
    "join_star_fact_dims",
    "mart_fraud_by_transaction_type",
    "mart_fraud_daily",
    "mart_transaction_behavior",
    "mart_customer_risk",
    "mart_fraud_training_features",
    "baseline_rules_metrics",
    "amount_by_class",
    "graph_overview",
    "pr_curve",
    "check_history_consistent",
]
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    timings = {}
    for name in HEADLINE:
        run = bind(name)
        measured = []
        for attempt in range(RUNS + 1):
            started = time.perf_counter()
            run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            if attempt:
                measured.append(time.perf_counter() - started)
        timings[name] = round(statistics.median(measured), 3)
    print(
        json.dumps(
            {
                "metric": "sum of median query times",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
