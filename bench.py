"""Benchmark the headline queries; prints one JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
     BENCH_QUERIES=a,b to pick.
Each query runs to completion into Spark's ``noop`` sink (full execution,
nothing collected to the driver).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from kpispark.plans import ORACLE, QUERIES  # noqa: E402
from kpispark.session import get_session  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_session(f"local[{cpus}]", max(cpus, 8), app_name="kpispark-bench",
                        **{"spark.driver.memory": "16g"})
    picked = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    names = picked or list(QUERIES)
    # warm-up: JVM, Parquet footers and codegen for the shared fact plan
    QUERIES["period_totals"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
        "n_queries": len(times),
        "n_with_oracle": sum(1 for q in times if q in ORACLE),
    }
    spark.stop()
    print(json.dumps(out))


if __name__ == "__main__":
    main()
