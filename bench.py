"""Time every registered query and the bulk load; print one line of JSON.

``BENCH_SF_DIR`` is the folder of the tables, ``BENCH_CPUS`` the number of local cores. Every query runs once
untimed at the smallest scale, which starts the Python workers and compiles the plan, and is then timed
``BENCH_RUNS`` times; the best time counts. Arguments restrict the run to the queries they name.
"""

from __future__ import annotations

import json
import os
import sys
import time

import pyspark

from tablework.functions.columns import quoted_table
from tablework.queries import QUERIES, table
from tablework.session import fresh_path, local_session
from tablework.sources.bulkcsv import load_bulk

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
RUNS = int(os.environ.get("BENCH_RUNS", "2"))
WARM_DIR = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")


def timed(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def bulk_rate(spark) -> float:
    """Rows per second of the text CSV load, from files to a table."""
    path = fresh_path(spark, "bench_bulk")
    lines = table(spark, SF_DIR, "lineitem")
    lines.write.option("header", True).csv(path)
    rates = []
    for run in range(RUNS):
        target = fresh_path(spark, f"bench_table{run}")
        name = target.rsplit("/", 1)[1].replace("-", "_")
        start = time.perf_counter()
        rows = load_bulk(spark, path, name, location=target)
        rates.append(rows / (time.perf_counter() - start))
        spark.sql(f"DROP TABLE {quoted_table(name)}")
    return max(rates)


def main(names: list[str]) -> None:
    spark = local_session(CPUS, CPUS)
    times = {}
    for name in names:
        if os.path.isdir(WARM_DIR):
            timed(spark, name, WARM_DIR)
        times[name] = round(min(timed(spark, name, SF_DIR) for _ in range(RUNS)), 3)
        print(f"{name} {times[name]}", file=sys.stderr)
    result = {
        "metric": "total time of all queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
        "bulk_load_rows_per_sec": round(bulk_rate(spark)),
        "cores": CPUS,
        "spark": pyspark.__version__,
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:] or list(QUERIES))
