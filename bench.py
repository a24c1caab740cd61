"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the folder of tables, BENCH_CPUS the threads. Each query runs
once to warm up and then three times into a sink without output; its figure is
the median.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from tessera.plans import catalogue
from tessera.session import local_session

HEADLINE = (
    "revenue_by_flag_status", "merge_outer", "semi_join", "drop_duplicate_rows", "group_nulls_as_zero", "pivot_sum", "crosstab_counts",
    "describe_column", "correlation_matrix", "top_orders", "rolling_basic", "expanding_basic", "rolling_zscores", "rolling_risk",
    "shift_diff_pct", "average_rank", "string_functions", "date_fields", "elementwise", "histogram_quantity", "ewm_stats", "test_spearman", "sparse_product",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):
            began = time.perf_counter()
            catalogue.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(statistics.median(runs[1:]), 4)
    print(json.dumps({"metric": "total_median_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
