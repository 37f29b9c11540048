"""Time the checked queries; prints one line of JSON.

Each query runs up to ``BENCH_WARMUPS`` times to warm up and then up to
``BENCH_RUNS`` times, each for 10 seconds at most; the median counts, building the
plan included. Results go to Spark's no-op sink.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

import catalog  # noqa: E402

HEADLINE = [
    "etl_flagship",
    "etl_op_list",
    "arith",
    "where_flag",
    "masked_update",
    "pred_mix",
    "fillna",
    "groupby_agg",
    "std_var_nunique",
    "first_last",
    "median",
    "reduce_median",
    "median_split",
    "window_frame",
    "window_frame_split",
    "join_left",
    "join_full",
    "join_left_salted",
    "op_list_join",
    "top_k",
    "order_by",
    "union",
    "distinct",
    "csv_round_trip",
]


def timed(spark: SparkSession, folder: str, name: str, runs: int) -> list[float]:
    """Seconds of each run; at least one run, none begun after 10 seconds."""
    times: list[float] = []
    while not times or (len(times) < runs and sum(times) < 10):
        start = time.perf_counter()
        result = catalog.QUERIES[name](spark, folder)
        result.write.format("noop").mode("overwrite").save()
        times.append(time.perf_counter() - start)
    return times


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    warmups = int(os.environ.get("BENCH_WARMUPS", "5"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tabflow-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds, counts = {}, {}
    for name in sys.argv[1:] or HEADLINE:
        timed(spark, folder, name, warmups)
        times = timed(spark, folder, name, runs)
        seconds[name] = round(statistics.median(times), 4)
        counts[name] = len(times)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "sum of median seconds over the headline queries",
                "value": round(sum(seconds.values()), 4),
                "unit": "sec",
                "queries": seconds,
                "runs": counts,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
