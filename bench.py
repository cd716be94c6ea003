"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line, seconds warm, best of two."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "4")
HEADLINE = ("ssh_parse", "brute_force", "port_scan", "all_incidents_severity_mitre", "tumbling_event_count", "allowlist_filter", "eval_rows", "ip_features", "burst_score", "cosine_topk", "customer_order_bursts")


def main() -> None:
    base = tempfile.mkdtemp(prefix="bench-")
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.local.dir", f"{base}/local").config("spark.sql.warehouse.dir", f"{base}/warehouse").config("spark.checkpoint.dir", f"file://{base}/shared").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from vigil.plans.queries import QUERIES

    seconds: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):
            began = time.perf_counter()
            QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        seconds[name] = round(min(runs[1:]), 3)
    print(json.dumps({"metric": "total_warm_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": SF}))


if __name__ == "__main__":
    main()
