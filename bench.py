"""Time the registered queries; prints one JSON line.

Tables that several queries read (`workload.inputs`) are built first and timed on their own as ``table_*``,
so a query's figure is the time of the query. Every result is computed in full.
"""

from __future__ import annotations

import json
import os
import sys
import time

from changelens.session import local_session
from workload.inputs import Inputs
from workload.queries import QUERIES

TABLES = {
    "source_files": lambda t: t.source_files,
    "code_facts": lambda t: t.parsed,
    "import_edges": lambda t: t.graphs.edges,
    "folded_graph": lambda t: t.graphs.folded,
    "module_reach": lambda t: t.graphs.reach,
    "layered_edges": lambda t: t.layered_edges,
    "layered_folded_graph": lambda t: t.layered,
    "layered_reach": lambda t: t.layered_reach,
    "priority_scores": lambda t: t.scores,
    "review_queue": lambda t: t.queue,
    "responses": lambda t: t.responses,
    "answers": lambda t: t.ingested,
    "issues": lambda t: t.issues,
    "cache": lambda t: t.modified_cache,
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("changelens-bench", os.environ.get("BENCH_CPUS") or os.cpu_count())
    spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count().collect()  # session start is no query
    seconds = {}

    def timed(name, run):
        begin = time.perf_counter()
        run()
        seconds[name] = round(time.perf_counter() - begin, 3)
        print(f"{name:28s} {seconds[name]:8.2f}", file=sys.stderr, flush=True)

    inputs = Inputs.of(spark, sf_dir)
    for name, build in TABLES.items():
        timed(f"table_{name}", lambda: build(inputs))
    for name in sys.argv[1:] or QUERIES:
        timed(name, lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
