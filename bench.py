"""Times every query of the engine at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and twice in full (every row and column computed); the median counts.  Rows and bytes
written to shuffles are those of the last run.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
RUNS = int(os.environ.get("BENCH_RUNS", "2"))


def main() -> None:
    from pyspark.sql import Observation, SparkSession
    from pyspark.sql import functions as F

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", CPUS).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from verisift import registry

    def shuffled() -> int:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(found.apply(k).totalShuffleWrite() for k in range(found.size()))

    queries, seconds, rows, moved = registry.queries(), {}, {}, {}
    for name in sorted(queries):
        took = []
        for run in range(1 + RUNS):
            before, began, seen = shuffled(), time.perf_counter(), Observation()
            queries[name](spark, SF_DIR).observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
            if run:
                took.append(time.perf_counter() - began)
        seconds[name], rows[name], moved[name] = round(statistics.median(took), 4), seen.get["n"], shuffled() - before
        spark.catalog.clearCache()
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 4), "unit": "sec", "queries": seconds, "rows": rows, "shuffle_bytes": moved, "sf": SF_DIR, "cpus": int(CPUS), "runs": RUNS}))


if __name__ == "__main__":
    main()
