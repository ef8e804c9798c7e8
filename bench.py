"""Times the headline queries: one warm-up and the median of five runs each, fully materialised.

What is written once before they run (notes as they are read in, links between them, the search index, parsed
texts) is timed by itself, under `built`, and isn't part of the total.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import SparkSession

HEADLINE = ["filter_only_search", "bm25_topk", "search_tiered", "links_resolve", "co_citation", "moc_overlap", "unfiled", "orphans", "status_totals", "lint_all", "links_extract", "term_df", "scan_delta"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from marginalia.plans.registry import QUERIES

    from marginalia.plans.adapters import Views

    built: dict[str, float] = {}
    for name, make in (("notes", lambda v: v.notes), ("note_links", lambda v: v["v_note_links"]), ("note_sources", lambda v: v["v_note_sources"]), ("index", lambda v: v.index), ("parsed", lambda v: v.parsed)):
        start = time.perf_counter()
        make(Views(spark, sf_dir))
        built[name] = round(time.perf_counter() - start, 4)
    took: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(6):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        took[name] = round(statistics.median(runs[1:]), 4)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "built": built, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
