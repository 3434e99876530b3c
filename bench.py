"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line.

Each query runs once to warm up; its time is the median of three more runs."""

from __future__ import annotations

import json
import os
import time

HEADLINE = ("median_3x3", "median_3x3_iter2", "escape_v2", "strided_sum", "blocked_sum", "guarded_moves", "region_labels", "overlap_pairs", "particle_step", "lane_ops", "ema", "kalman")


def main() -> None:
    from gridweave.plans import catalogue
    from gridweave.session import session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", **{"spark_ui_enabled": "false", "spark_driver_memory": "12g", "spark_sql_shuffle_partitions": cpus, "spark_ui_showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors
    times = {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):
            start = time.perf_counter()
            catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(sorted(runs[1:])[1], 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
