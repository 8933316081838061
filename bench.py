"""Benchmark of the headline queries.

Runs each query on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]`` and forces full execution with the no-op sink (no
collect).  Prints one JSON line:
{"metric": "total_query_time", "value": N, "unit": "sec", "queries": {...}, "sf": ...}
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from levelling.plans import catalog  # noqa: E402
from levelling.session import local_session  # noqa: E402

HEADLINE = [
    "compare_file",      # mode 1: nearest pair + differences + flag + sort
    "compare_heights",   # mode 2: roles, projection, height join
    "compare_both",      # mode 3
    "enrich_xy",         # mode 4
    "grid_heights",      # mode 5: grid + service path
    "thin_accurate",     # thinning of accurate points
    "nearest_pair",
    "nearest_unlimited",
    "nearest_mutual",
    "project_2180",
    "hex_thin",
    "scan_delimited",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2 if cpus.isdigit() else 16)
    qs = catalog.queries()
    # warm-up (untimed): JIT, code generation and Python workers on the smallest input
    small = "/root/testdata/sf0.001"
    if os.path.isdir(small):
        for name in names:
            try:
                qs[name](spark, small).write.format("noop").mode("overwrite").save()
            except Exception:  # noqa: BLE001 - the timed run reports it
                pass
    times, failed = {}, {}
    for name in names:
        t0 = time.perf_counter()
        try:
            qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t0, 3)
        except Exception as e:  # noqa: BLE001 - report and keep measuring the others
            failed[name] = f"{type(e).__name__}: {str(e)[:200]}"
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else sf_dir}
    if failed:
        out["failed"] = failed
    print(json.dumps(out))


if __name__ == "__main__":
    main()
