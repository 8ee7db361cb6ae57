"""Benchmark the headline queries.

Runs each query to completion with the ``noop`` sink (every row computed, nothing collected to the
driver) on ``local[$BENCH_CPUS]`` over ``$BENCH_SF_DIR``: one untimed warm-up pass over the same
queries (JVM start, JIT compilation, file-system caches), then one timed pass. Prints one JSON line:
``{"metric": ..., "value": total seconds, "unit": "sec", "queries": {...}, "sf": ...}``.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from mercato.plans.registry import QUERIES  # noqa: E402
from mercato.session import build_session  # noqa: E402

HEADLINE = [
    "r2_top_products_by_category",
    "r3_employee_ranking",
    "r4_customer_segments",
    "r4_customer_segments_all",
    "r5_sales_detail_view",
    "r6_employee_product_summary",
    "r10_sales_by_category_product_all",
    "q17_duplicate_keys",
    "q21_orphan_counts",
    "r1_spec_sales_by_category",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", shuffle_partitions=2 * cpus, app="mercato-bench")
    # untimed warm-up pass (JVM start, JIT compilation, file-system caches)
    for name in names:
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    spark.stop()
    m = re.search(r"sf([0-9.]+)$", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(m.group(1)) if m else sf_dir,
            }
        )
    )


if __name__ == "__main__":
    main()
