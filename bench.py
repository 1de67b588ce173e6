"""Time the headline queries; prints one JSON line.

Each query is built and written to the ``noop`` sink, so the whole result is
computed and nothing is collected. The session is warmed by one small query.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

HEADLINE = os.environ.get("BENCH_QUERIES", "").split() or [
    "pair_edit_distance", "pair_lcs", "pair_overlap", "alignment_ops", "scored_rows",
    "summary_grouping_sets", "confusion_by_size", "category_mix",
    "graph_adjacency", "case_neighbourhood_2", "node_owner", "render_subgraph",
    "hybrid_topk", "chained_guard_topk",
    "case_timeline", "prompt_table", "response_normalise", "graph_json_scan",
]


def main() -> None:
    from caseweave.checks.queries import QUERIES
    from caseweave.runtime import local_session, work_area

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(
        cores, shuffle_partitions=int(cores) if cores.isdigit() else 8,
        folder=tempfile.mkdtemp(prefix="caseweave-"),
    )
    QUERIES["pair_edit_distance"](spark, "/root/testdata/sf0.001").write.format("noop").mode(
        "overwrite"
    ).save()

    seconds = {}
    for name in HEADLINE:
        with work_area(spark):
            start = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.time() - start, 2)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 2),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
