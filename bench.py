"""Wall time of the headline queries: one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query runs once to warm up and twice for the median (``BENCH_RUNS``); results go to the no-op
sink, so every row is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.queries import catalog  # noqa: E402
from tidemark.session import build_session  # noqa: E402

HEADLINE = [
    "weekly_sources", "clean_text", "normalize_text", "tokens_bm25", "simhash64", "route_relevant", "signal_flags", "enrich_posts", "light_enrich", "query_enrich",
    "workstream_of", "dedup_prefix", "dedup_text_or_url", "near_dup_simhash", "source_distribution", "run_snapshot", "top_n_per_group", "keep_best_by_key",
    "percent_of_total", "temporal_edges", "top_words", "bm25_topk", "dense_topk", "hybrid_search_lexical", "dbscan_cosine", "mean_pairwise_jaccard",
    "overlap_penalty", "detect_trends", "run_deltas", "per_class_prf", "citation_faithfulness", "stream_trend_log",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", cpus)
    times: dict[str, float] = {}
    for name in names:
        taken = []
        for _ in range(1 + runs):
            t = time.perf_counter()
            catalog.SPARK[name](spark, sf).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - t)
        times[name] = round(statistics.median(taken[1:] or taken), 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf.rstrip("/")), "cpus": int(cpus), "runs": runs}))


if __name__ == "__main__":
    main()
