"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores. Each query is planned, run in
full and written to a no-op sink once, without a warm-up of its own.
"""

from __future__ import annotations

import json
import os
import sys
import time

from tallyrank.plans.catalog import QUERIES
from tallyrank.plans.fixtures import executions
from tallyrank.session import local_session

HEADLINE = (
    "apfd_per_build", "failure_rates", "decayed_failure_rate", "max_streaks", "features_v2_temporal",
    "features_v3_temporal", "features_v2_snapshot", "cumulative_features", "priority_score",
    "rank_greedy_historical", "evaluate_strategies", "variant_deltas", "fold_summary",
    "apfd_summary_by_project", "ndcg_recall_pct", "auprc", "best_threshold_f1_macro", "wilcoxon_greater",
    "co_failure_edges", "co_success_edges", "commit_edges", "temporal_edges", "combine_edges",
    "knn_cosine", "score_orphans", "clean_text", "commits_text", "length_profile_documents",
    "hash_embedding", "history_scorer_logistic", "stream_history",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name, run):
        start = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)

    timed("prepare_events", lambda: executions(spark, sf, "ev"))
    timed("prepare_lineitem", lambda: executions(spark, sf, "li"))
    for name in HEADLINE:
        timed(name, lambda: QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save())
    print(json.dumps({"metric": "total_headline_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
