"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the cores, BENCH_QUERIES a
comma-separated choice.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from markbook.plans import catalog  # noqa: E402
from markbook.session import local_session  # noqa: E402

HEADLINE = (
    "score_totals", "score_points", "grade_answers", "stem_strip", "leak_pairs_lcs", "leak_scan", "align_spans",
    "char_f1", "norm_stem", "sentence_split", "majority_vote", "quality_report", "inspection_sample", "question_summary",
    "point_hit_rate", "admin_stats", "negative_downsample", "label_pairs", "span_tuples", "item_pairs", "hard_negatives",
    "threshold_search", "auc_midrank", "gold_totals", "systematic_sample", "cosine_fallback", "span_decode",
    "output_parse", "ocr_assemble", "latency_ranks", "upsert_latest", "stream_stats",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    chosen = os.environ.get("BENCH_QUERIES")
    spark = local_session(cores, shuffle_partitions=max(8, int(cores) if cores.isdigit() else 8))
    queries = catalog.queries()
    # start the Python workers and load the common classes before anything is timed
    queries["question_summary"](spark, folder).count()
    queries["span_decode"](spark, folder).count()
    times: dict[str, float] = {}
    for name in chosen.split(",") if chosen else HEADLINE:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")),
                "cores": cores,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
