"""Time the headline queries on one data folder and print one JSON line.

Environment: ``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS`` (default 8),
``BENCH_RUNS`` (default 2; the best run counts), ``BENCH_QUERIES`` (comma-separated names).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "dominant_token_works", "processable_refs", "clean_reference", "token_counts",
    "dominant_tokens", "term_counts", "strip_html", "reference_profile", "prepared_frame",
    "journal_articles", "flagged_articles", "unflagged_people", "duplicate_titles",
    "other_duplicate_titles", "book_chapters", "journal_report", "tfidf_weights", "tfidf_pairs",
    "top_repeated_titles", "jaccard_pairs", "edit_pairs", "swap_edit_pairs", "embedding_pairs",
    "similar_title_report", "read_snapshot",
]


def main() -> None:
    from refsieve.session import local_session
    from workload.queries import QUERIES, prepared
    from workload.views import SCAN_PARTITIONS

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    cores = int(cpus) if cpus.isdigit() else 8
    spark = local_session(cpus, partitions=cores)
    # Intermediates go when the session ends.
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="bench-"))
    spark.conf.set(SCAN_PARTITIONS, str(cores))

    start = time.time()
    prepared(spark, folder)
    stored_results = time.time() - start

    seconds = {}
    for name in names:
        best = None
        for _ in range(runs):
            start = time.time()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            took = time.time() - start
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                # Reports read the result table and the prepared frame; the time to write them counts.
                "value": round(sum(seconds.values()) + stored_results, 3),
                "unit": "sec",
                "queries": seconds,
                "stored_results_sec": round(stored_results, 3),
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
