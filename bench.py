"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then $BENCH_RUNS times (default 3); the
median is reported.  Results are computed in full and thrown away by the noop
sink, so reading them on the driver is not part of the time.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lumentab.plans import REGISTRY
from lumentab.session import local_session

HEADLINE = [
    "flagship", "group_stats", "describe_by", "value_counts", "pivot_mean", "corr_matrix", "histogram", "boxplot",
    "kde", "join_inner", "join_lookup", "join_ratio", "set_symdiff", "enumerate", "top_k", "sma_multi", "periodogram",
    "regex_findall", "str_title", "array_hof", "crossmatch", "cone_search", "shell_rotation", "shell_tangential_signed",
    "tokenize", "tfidf", "naive_bayes", "html_links", "html_select", "item_ratings", "similar_items", "cosine_pairs",
    "cf_predict", "knn_predict", "confusion_matrix", "sales_by_state",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = local_session(cpus)
    seconds = {}
    for name in names:
        took = []
        for run in range(runs + 1):
            start = time.perf_counter()
            REGISTRY[name](spark, folder).write.format("noop").mode("overwrite").save()
            if run:
                took.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(took), 4)
    spark.stop()
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 4), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": cpus, "runs": runs,
    }))


if __name__ == "__main__":
    main()
