"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from packlake.plans.queries import QUERIES  # noqa: E402
from packlake.session import local_session  # noqa: E402

HEADLINES = [
    "part_details",
    "dangling_relationships",
    "relationship_target_for_id",
    "tree_nodes",
    "search_content",
    "clean_text",
    "resolve_shared",
    "bounded_lines",
    "hex_dump",
    "json_pretty",
    "xml_pretty",
    "build_previews",
    "parse_relationships",
    "heading_outline",
    "slide_title",
    "worksheet_cells",
    "explode_packages",
    "search_packages",
    "read_part",
    "excel_summary",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    # Start the JVM paths and the Python workers before anything is timed.
    QUERIES["worksheet_cells"](spark, folder).limit(1).count()
    seconds = {}
    for name in HEADLINES:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
