"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 2: the first run warms the JIT,
the best is reported), BENCH_ALL=1 for every registered query.
"""

from __future__ import annotations

import json
import os
import time

from tidemark.plans import QUERIES
from tidemark.session import get_session

HEADLINE = [
    "asof_backward_quote", "asof_forward_quote", "asof_prior_move", "point_in_time_streams", "interval_overlap_hours", "intent_to_book_match",
    "hourly_bars", "bars_rollup_audit", "spot_features", "trailing_imbalance", "covered_hours_union", "running_max_observed",
    "fee_and_cost", "qualify_signal", "max_slippage", "product_interval_prob",
    "accepted_samples", "bracket_partition_check", "expanding_folds", "split_fraction_days",
    "binary_metrics", "day_mean_score", "event_date_weighted_ece", "segment_scores", "residual_summary", "exact_group_quantiles",
    "ledger_summary", "equity_drawdown", "exposure_curve", "liquidation_value", "trade_attribution", "fixed_cohort_reprice",
    "bootstrap_day_cluster", "bootstrap_circular_block", "offset_logistic_fit", "offset_logistic_many", "select_weight_grid",
    "latest_per_key", "topn_per_group", "record_validation", "stream_tumbling_bars", "stream_match_intents",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = list(QUERIES) if os.environ.get("BENCH_ALL") else HEADLINE
    spark = get_session("bench", f"local[{cpus}]", shuffle_partitions=cpus)
    times, failed = {}, {}
    for name in names:
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            try:
                QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            except Exception as exc:  # keep the other figures; the failure is part of the report
                failed[name] = str(exc).splitlines()[0][:200]
                break
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        if name not in failed:
            times[name] = round(best, 3)
    out = {"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus, "runs": runs}
    if failed:
        out["failed"] = failed
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
