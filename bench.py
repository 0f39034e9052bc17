"""Headline queries on one data folder; prints one JSON line.

BENCH_SF_DIR names the folder, BENCH_CPUS the local cores, BENCH_RUNS how often each
query runs (the median counts), BENCH_QUERIES a comma-separated selection.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "vector_topk", "anchor_pages", "cross_page_candidates", "hashed_text_search", "same_as_components",
    "near_duplicate_collapse", "hub_filtered_edges", "retrieval_graph_edges", "expanded_pages", "pagerank_pages",
    "merged_components", "compacted_documents", "trace_rollup",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    chosen = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE

    from quire.plans.catalog import QUERIES
    from quire.session import get_session

    spark = get_session(
        "quire-bench", master=f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "20g", "spark.sql.files.openCostInBytes": "1m"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    # One untimed query starts the JVM's compiler and the Python workers.
    QUERIES["compacted_documents"](spark, folder).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in chosen:
        taken = []
        for _ in range(runs):
            start = time.time()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.time() - start)
        times[name] = round(statistics.median(taken), 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
