"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shardline.gallery import QUERIES  # noqa: E402
from shardline.session import build_session  # noqa: E402

HEADLINE = (
    "r1_rollup_builder_hourly",
    "r2_top_n_child_classes",
    "r3_top_n_sites",
    "r4_top_n_sites_timeseries",
    "r5_top_n_flow_details_talker",
    "r6_sales_and_returns",
    "r16_shop_report",
    "r18_banned_items_of_sellers",
    "r19_item_publish_report",
    "r20_item_create_report",
    "r24_table_profile",
    "e7_delta_upsert",
    "e8_append_ignoring_known_keys",
    "e9_compact_log",
    "e13_column_actions",
    "h1_nested_set",
    "u5_symmetric_difference",
    "f15_numbered_lines",
)


def seconds(run) -> float:
    started = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    runs: dict[str, list[float]] = {name: [] for name in HEADLINE}
    for turn in range(repeat + 1):  # the first turn warms up
        for name in HEADLINE:
            took = seconds(lambda q=QUERIES[name]: q(spark, folder))
            if turn:
                runs[name].append(took)
    times = {name: round(statistics.median(values), 3) for name, values in runs.items()}
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries (median of runs)",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
                "spark": spark.version,
            }
        )
    )


if __name__ == "__main__":
    main()
