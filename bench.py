"""Run the headline queries once each and print one JSON line with their seconds."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from wayfold.plans import registry

HEADLINE = "q_ride_stats q_gap_segments q_resample q_overlap_count q_resume_encounters q_edge_counts q_dir_max_sum q_validity_join q_grid_radius q_self_parallel q_od_demand q_boro_rollup".split()


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = registry.queries(), {}
    queries["q_ride_stats"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm up
    for name in HEADLINE:
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
