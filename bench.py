"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line. Median of warm runs."""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

HEADLINES = [
    "merge_full_outer",
    "merge_full_outer_exact",
    "merge_policy_drop",
    "merge_conflicts",
    "merge_unmatched",
    "merge_report_counts",
    "dup_key_groups",
    "key_overlap_ids",
    "key_overlap_names",
    "norm_key_id",
    "norm_key_id_exact",
    "num_text",
    "similar_keys_top3",
]
RUNS = 3


def main() -> None:
    os.chdir(os.path.dirname(os.path.abspath(__file__)))
    sys.path.insert(0, os.getcwd())
    from pyspark.sql import SparkSession

    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.master": f"local[{cpus}]", "spark.driver.memory": "8g", "spark.sql.shuffle.partitions": cpus.replace("*", "8"), "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC"}
    spark = SparkSession.builder.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from keyloom.queries import QUERIES

    took = {}
    for name in HEADLINES:
        runs = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        took[name] = round(median(runs[1:]), 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf).removeprefix("sf")}))


if __name__ == "__main__":
    main()
