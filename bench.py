"""Headline queries at BENCH_SF_DIR on local[BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from listingscope.plans import catalog
from listingscope.session import local_session

HEADLINE = (
    "top_sellers", "seller_metrics", "community_metrics", "panel", "rule_scores", "listing_features", "executive_summary", "price_boxes",
    "suggested_prices", "title_attributes", "keyword_hits", "result_links", "image_reuse_bands", "upsert",
    "catalog_layer", "image_layer", "similarity_counts", "seller_neighbourhood", "connected_components", "pagerank", "ridge_scores",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    catalog.QUERIES["panel"](spark, sf_dir).count()  # starts the executors' code paths once
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"), "cpus": cpus,
        "driver_memory": spark.conf.get("spark.driver.memory", ""),
    }))


if __name__ == "__main__":
    main()
