"""Headline queries at $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from nearmesh.plans.catalogue import QUERIES
from nearmesh.session import local_session

HEADLINE = ["exact_knn", "nearest_centroid", "bucketed_knn", "reverse_merge", "detour_prune", "two_hop_refine", "local_join_reverse", "graph_compare", "build_graph"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["norms"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the session and its workers
    times = {}
    for name in HEADLINE:
        begin = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - begin, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    sys.stdout.flush()


if __name__ == "__main__":
    main()
