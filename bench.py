"""Time the headline queries: one JSON line on stdout."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from winnow.session import local_session
from workload import all_queries

HEADLINE = [
    "src_record_keys", "src_partition_leaks", "src_feedback_log_to_records", "hist_strict_history", "hist_next_item_task",
    "hist_category_task", "smp_root_reservoir", "smp_weighted_draws", "met_ranking_summary", "met_paired_bootstrap",
    "obs_group_advantages", "obs_corrected_estimate", "obs_minimax_allocation", "acq_rank_acquisition", "grf_restricted_logprob",
    "vec_count_sketch", "vec_fit_dictionary", "sel_refill", "sel_budgeted_full_code", "fro_frontier_weights", "fro_best_pair",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    wanted = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "winnow-bench", cpus)
    queries = all_queries()
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()  # start the session before the clock
    times: dict[str, float] = {}
    for name in wanted:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    sf = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf)}))


if __name__ == "__main__":
    main()
