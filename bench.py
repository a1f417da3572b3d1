"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints ONE JSON line.

Each query is run to completion with the ``noop`` sink (no collection on the driver). Index builds are
timed separately (they are the one-off indexing step of the reference's workflow).
"""
from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "count_literal", "count_overlapping", "count_by_shard", "count_batch", "docs_containing",
    "find_intervals", "match_positions", "context_windows", "highlight_spans",
    "count_indexed", "find_indexed", "find_batch",
    "ranked_hits", "search", "get_doc_by_rank",
]


def main() -> None:
    from pyspark.sql import SparkSession

    spark = (SparkSession.builder.master(f"local[{CPUS}]").appName("bytegram-bench")
             .config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", str(int(CPUS) * 2))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.adaptive.skewJoin.enabled", "true")
             .config("spark.driver.memory", os.environ.get("BYTEGRAM_DRIVER_MEMORY", "16g"))
             .config("spark.sql.session.timeZone", "UTC")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.sparkContext.getCheckpointDir() and not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="bench-ckpt-", dir="/tmp"))

    from bytegram.plans import registry as R

    times: dict[str, float] = {}

    def timed(name, fn):
        t0 = time.time()
        fn()
        times[name] = round(time.time() - t0, 3)

    timed("layout", lambda: R.documents(spark, SF_DIR).layout)
    timed("build_index", lambda: R.ordered_index(spark, SF_DIR))
    for name in HEADLINE:
        timed(name, lambda n=name: R.QUERIES[n](spark, SF_DIR).write.format("noop").mode("overwrite").save())
    q = {k: v for k, v in times.items() if k in HEADLINE}
    m = re.search(r"sf([0-9.]+)", SF_DIR)
    print(json.dumps({"metric": "headline_query_seconds_total", "value": round(sum(q.values()), 3), "unit": "sec",
                      "with_builds": round(sum(times.values()), 3), "queries": times, "sf": float(m.group(1)) if m else None, "cpus": int(CPUS)}))
    spark.stop()


if __name__ == "__main__":
    main()
