"""Headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from gridspark.registry import QUERIES  # noqa: E402
from gridspark.session import local_session  # noqa: E402

HEADLINE = (
    "e14_outages_near_sites",
    "d3_radius_pairs",
    "d4_cell_district",
    "d4_outage_site_name",
    "d9_region_tags",
    "b1_derived_fields",
    "c4_duration_outliers",
    "e3_risk_scores",
    "e10_site_timelines",
    "e11_month_over_month",
    "e15_seasonal_forecast",
    "e26_duration_profile",
    "e27_value_counts",
    "e29_causes_of_long_outages",
    "f4_grid_features",
    "f9_training_samples",
    "h5_investment_ranking",
    "h6_combined_report",
    "i2_upsert",
    "i4_incident_context",
    "j1_document_search",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "gridspark-bench")
    names = [n for n in HEADLINE if not sys.argv[1:] or any(n.startswith(a) for a in sys.argv[1:])]
    QUERIES["e9_count_by_category"](spark, sf_dir).collect()  # start the JVM's engine
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr)
    found = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(found.group(1)) if found else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
