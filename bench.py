"""Time the headline queries and print one JSON line: {"metric", "value", "unit", "queries", "sf"}."""

from __future__ import annotations

import json
import os
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
HEADLINE = (
    "public_list", "tag_facets", "day_order", "load_summary", "showings", "coverage", "host_counters", "usage_rollup", "domains_merge", "learned_rules",
    "day_runs", "failure_streaks", "moving_averages", "joined_runs", "host_caps", "country_evidence", "region_at", "keyword_tags", "url_templates",
    "template_counters", "seen_page", "title_pairs", "title_clusters", "near_town", "town_counts", "parsed_dates", "frontier_pick", "upsert_latest", "table_counts",
)


def main() -> None:
    from harvestry import catalog
    from harvestry.session import local_session

    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["table_counts"](spark, SF_DIR).collect()  # starts the executors
    took: dict[str, float] = {}
    for name in HEADLINE:
        began = time.perf_counter()
        catalog.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    sf = os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
