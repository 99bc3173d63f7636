"""Headline timings: runs the main jobs at $BENCH_SF_DIR on local[$BENCH_CPUS]
and prints one JSON line.

Each query is forced with the ``noop`` sink (full computation, nothing
collected to the driver). Pages/s is reported for the per-page jobs.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "flagship_token_savings",   # N2 + C1-C3 token level, K1/K2, group by host
    "c10_clean_sizes",          # N1 + N3 + C1-C10 + N4
    "m14_literal_markdown",     # N3 fragment + M1-M14
    "p9_apply_text",            # P1-P9 on raw html
    "r5_reader_markdown",       # R1-R5
    "i2_proposals",             # I1 + I2 mining per host
    "p8_feedback",              # P3-P8
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from pagemill.plans.queries import queries
    from pagemill.session import get_spark

    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    qs = queries()
    n_pages = spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    times = {}
    for name in HEADLINE:
        spark.catalog.clearCache()  # every query pays for its own parse
        t0 = time.time()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": sf,
        "pages": n_pages, "pages_per_sec": {k: round(n_pages / v, 1) for k, v in times.items() if v > 0},
        "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
