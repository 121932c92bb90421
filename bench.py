"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores. Every query runs once to warm up and then
three times; the median counts. Results are written to the ``noop`` sink, so all rows and columns are computed.
The audit log that ``verify_chain`` reads is written by its warm-up run; ``build_chain`` times the writing side.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from govspark.plans import QUERIES  # noqa: E402
from govspark.session import get_session  # noqa: E402

HEADLINE = (
    "quality_report",
    "dimension_scores",
    "profile_table",
    "verify_chain",
    "build_chain",
    "ks_drift",
    "decision_outcomes",
    "valid_votes",
    "mask_table",
    "pii_detect",
    "contract_validation",
    "compliance_all",
    "request_rate",
    "lineage_edges",
    "silver_dedup",
)
RUNS = 3


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    spark = get_session(
        "bench", f"local[{cpus}]", max(int(cpus), 4) if cpus.isdigit() else 8,
        **{"spark.driver.memory": os.environ.get("BENCH_MEMORY", "6g"), "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        spent = []
        for _ in range(RUNS + 1):
            started = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            spent.append(time.perf_counter() - started)
        times[name] = round(statistics.median(spent[1:]), 3)
    report = {
        "metric": "sum of median query times",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(report))
    spark.stop()


if __name__ == "__main__":
    main()
