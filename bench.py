"""Time the headline queries: prints one JSON line.

``BENCH_SF_DIR`` names the test data, ``BENCH_CPUS`` the local cores.  Each query
runs once to warm up (class loading and code generation) and is then timed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pricing_engine import catalogue  # noqa: E402
from pricing_engine.session import local_session  # noqa: E402

HEADLINE = [
    "src_1_price_history",
    "win_1_latest_price",
    "win_4_dedupe_history",
    "win_5_upsert_registry",
    "agg_3_incremental_metrics",
    "agg_5_group_metrics",
    "agg_7_quality_report",
    "win_2_best_offer",
    "top_2_discounted",
    "out_1_analysis",
    "out_2_groups",
    "flt_8_search",
    "joi_9_unmatched_products",
    "flt_1_term_filter",
    "sca_5_attributes",
    "mat_5_group_names",
    "joi_7_gated_name_pairs",
    "mat_1_candidates",
    "mat_2_review_queue",
    "mat_3_assign",
    "mat_4_auto_assign",
    "nrm_1_json_records",
    "nrm_12_visible_text",
    "nrm_22_merge_sources",
    "str_1_incremental_metrics",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    wanted = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in wanted:
        for _ in range(2):
            start = time.perf_counter()
            catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
