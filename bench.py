"""Time the headline queries on one machine and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corvane.session import local_session  # noqa: E402
from workload import load  # noqa: E402

HEADLINE = [
    "chunk_documents", "dedupe_while_chunking", "structural_edges", "tokenize",
    "vector_topk", "retrieve", "cooccurrence_edges", "entity_graph", "link_entities",
    "graph_hop1", "graph_hop2", "graph_retrieve", "retrieval_metrics", "merge_mentions",
    "document_entities", "community_text", "stream_ingest", "fuzzy_match", "retrieve_all",
    "shortest_paths", "louvain",
]
#: No query is begun after so many seconds; those left are named in the output.
BUDGET_S = float(os.environ.get("BENCH_BUDGET_S", "1200"))


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = local_session(cores, "bench")
    queries = load()[0]
    times, failed, left, started = {}, [], [], time.perf_counter()
    for name in HEADLINE:
        begin = time.perf_counter()
        if begin - started > BUDGET_S:
            left.append(name)
            continue
        try:
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        except Exception as error:  # noqa: BLE001
            print(f"{name} failed: {str(error)[:200]}", file=sys.stderr)
            failed.append(name)
            continue
        times[name] = round(time.perf_counter() - begin, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_wall_time", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(folder),
                      "failed": failed, "not_begun": left}))
    spark.stop()
    if failed:
        sys.exit(1)


if __name__ == "__main__":
    main()
