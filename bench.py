"""Headline queries, timed.  Prints one JSON line.

``BENCH_SF_DIR`` (default sf0.1) and ``BENCH_CPUS`` choose data and cores;
``BENCH_QUERIES`` a comma-separated list of queries, or ``all``.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    # serve
    "urgent_topk", "search_page", "search_facets", "search_keyword", "listing_detail", "available_list", "listing_stats",
    "stats_by_region", "region_facets", "facility_facets", "listing_statistics",
    # monitor
    "anomalies", "anomaly_report", "ledger_rollup", "last_n_runs", "count_carry_forward", "fleet_summary", "run_kpis", "daily_runs",
    "latest_run_status",
    # extract and normalise
    "page_tokens", "heading_sections", "link_records", "clean_text", "count_fallback", "text_sections", "parse_dates",
    "labelled_fields", "ocr_text_records", "reading_order", "section_state",
    "layout_extract", "contains_join", "zip_lists", "image_of_record",
    # quality and load
    "crosscheck_warnings", "review_gate", "envelope_explode", "latest_snapshot", "batch_last_wins", "upsert_merge", "mark_removed",
    "unique_names", "unique_names_contested", "first_seen", "snapshot_diff", "reconcile_counts", "ingest_pages",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")

    from foundling.plans import all_queries
    from foundling.session import build

    spark = build(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    asked = os.environ.get("BENCH_QUERIES", "")
    names = list(queries) if asked == "all" else [q for q in asked.split(",") if q] or HEADLINE
    # one small run so that start-up is not counted
    queries["urgent_topk"](spark, sf_dir).collect()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
