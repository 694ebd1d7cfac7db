"""Times the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR and prints one JSON line.

One warm-up run, then the median of three, each run writing the whole result to Spark's no-op sink.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from repoquarry.session import local_session
from repoquarry.workload import load

HEADLINES = [
    "attach_files", "language_lines", "sample_files", "change_frequency", "commit_rollup", "file_history", "recent_authors",
    "commit_digest", "diff_snapshots", "incremental_profile", "classify_basic", "match_patterns", "explain_pattern", "detect_frameworks",
    "head_per_directory", "read_contents", "prompt_sections", "parse_important_files", "repo_profile", "analyze_overview",
    "chunk_text", "top_k_similar", "search_docs", "term_index", "mask_sensitive", "import_edges", "debt_rollup", "health_trend",
    "stream_change_counts", "change_impact", "docs_to_refresh", "commit_files", "directory_index", "sensitive_findings",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cores=cores, partitions=int(cores))
    spark.sparkContext.setLogLevel("ERROR")
    queries = load()[0]
    seconds: dict[str, float] = {}
    for name in HEADLINES:
        times = []
        for run in range(runs + 1):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            if run:
                times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
    print(
        json.dumps(
            {
                "metric": "total of median query times",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
