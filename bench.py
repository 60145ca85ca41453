"""Times the queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

``segment_tables`` is the build that most queries start from (forest, chainage, assignment, features),
timed cold; the other queries are timed once each after it, writing to the noop sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        # tasks in Python start sooner
        .config("spark.python.unix.domain.socket.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from workload import queries as q, tables

    only = set(sys.argv[1:])
    times: dict[str, float] = {}

    def timed(name, run):
        start = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - start, 3)

    timed("segment_tables", lambda: tables.placed(spark, sf))
    for name, run in q.all_queries().items():
        if not only or name in only:
            timed(name, lambda: run(spark, sf).write.format("noop").mode("overwrite").save())
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
