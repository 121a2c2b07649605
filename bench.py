"""Time the headline queries and print one JSON line.

BENCH_SF_DIR chooses the data, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import time

from skyledger.plans import catalog
from skyledger.session import drop_scratch, get_session

HEADLINE = [
    "d16_horizon_report",
    "d01_aggregate_window_1hour",
    "d02_aggregate_window_empty",
    "d08_catalog_summary",
    "d11_latest_wide",
    "d17_error_series_rmse",
    "d19_describe",
    "d23_error_runs",
    "e03_align_all",
    "e09_reconcile",
    "f03_timed_moving_average",
    "f04_alert_intervals",
    "b04_attach_envelope",
    "b07_reassemble",
    "a05_write_points",
    "j01_discretize",
    "j05_rule_metrics",
    "j10_profile_numeric",
    "j13_corr_spearman",
    "j14_corr_kendall",
    "k06_calibration",
    "h05_stream_window",
    "h07_stream_silence",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
                        spark__driver__memory="16g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()  # start the executors

    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        catalog.run(name, spark, sf_dir).write.mode("overwrite").format("noop").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    drop_scratch(spark)
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
