"""Headline queries at BENCH_SF_DIR on local[BENCH_CPUS]; prints one line of JSON."""

from __future__ import annotations

import json
import os
import statistics
import time

from quillon.plans.registry import QUERIES
from quillon.session import build_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

#: One or two of each family of operators; the first runs also warm the JVM up and aren't counted.
HEADLINES = (
    "q_revenue_by_nation", "q_pricing_summary", "q_forecast_revenue", "q_large_orders", "q_supplier_revenue",
    "q_join_tree", "q_lateral", "q_range_join", "q_asof_join", "q_rollup", "q_grouping_sets", "q_percentiles", "q_hypothetical_ranks",
    "q_window_neighbours", "q_rows_frame", "q_groups_frame", "q_exclude_ties", "q_top_k_per_group", "q_fetch_with_ties",
    "q_except", "q_cte", "q_transitive_closure", "q_regexps", "q_date_parts", "q_json_navigation",
    "q_compare_rows", "q_merge", "q_content_hash", "q_graph_closure", "q_sessions",
)


def seconds(spark, name: str) -> float:
    began = time.perf_counter()
    QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    cores = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = build_session("bench", cores=cores)
    took = {}
    for name in HEADLINES:
        seconds(spark, name)
        took[name] = round(statistics.median(seconds(spark, name) for _ in range(RUNS)), 3)
    total = round(sum(took.values()), 3)
    sf = float(os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf") or 0)
    print(json.dumps({"metric": "headline_queries_total_seconds", "value": total, "unit": "sec", "queries": took, "sf": sf, "cores": cores, "runs": RUNS}))
    spark.stop()


if __name__ == "__main__":
    main()
