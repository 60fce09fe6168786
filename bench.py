"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS
(default 3 timed runs of each query, of which the median counts, after one untimed warm-up of the session).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.queries import QUERIES  # noqa: E402
from series_rank.session import LOCAL_SETTINGS, get_session  # noqa: E402

HEADLINE = [
    "scan_series",
    "series_features",
    "series_features_split",
    "series_features_parts",
    "series_features_arrays",
    "wide_features",
    "all_rejects",
    "filter_attributes",
    "column_stats",
    "correlation_matrix",
    "rank_cv",
    "rank_factor",
    "rank_cv_factor",
    "rank_zscore_weighted",
    "custom_ranker",
    "final_summary",
    "global_rank",
    "parse_series_text",
    "malformed_lines",
    "page_links",
    "marker_rows",
    "incremental_append",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = get_session("bench", f"local[{cpus}]", cpus, LOCAL_SETTINGS)
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["scan_series"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        taken = []
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(sorted(taken)[len(taken) // 2], 3)
    out = {
        "metric": "total seconds of the headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir).removeprefix("sf"),
        "cpus": cpus,
    }
    spark.stop()
    print(json.dumps(out))


if __name__ == "__main__":
    main()
