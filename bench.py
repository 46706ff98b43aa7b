"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` choose data and cores.
Each query runs twice, from building its plan to producing every row; the faster run
counts, so that class loading is not measured. ``BENCH_QUERIES`` limits the run to
some names, ``all`` takes every registered query.
"""

from __future__ import annotations

import json
import os
import re
import time

from sitegrain.catalog.queries import QUERIES
from sitegrain.session import build_session

HEADLINE = [
    "page_links",
    "links_anchor",
    "links_scope_1",
    "text_urls",
    "url_parts",
    "url_key",
    "pages_by_host",
    "pages_by_site_domain",
    "ip_links",
    "content_fingerprint",
    "decode_pages",
    "pattern_hits",
    "redirect_targets",
    "redirect_follow",
    "fetch_outcomes",
    "crawl_depth2",
    "crawl_pages",
    "upsert_latest",
    "latest_per_url",
    "update_optimistic",
    "update_partitioned",
    "delete_contents",
    "export_pages",
    "page_rows",
    "task_defaults",
    "stream_upsert",
    "stream_links",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "").split()
    names = list(QUERIES) if chosen == ["all"] else chosen or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs), 3)
    spark.stop()
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale[1]) if scale else sf_dir,
            }
        )
    )


if __name__ == "__main__":
    main()
