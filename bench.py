"""Time the registered queries: one JSON line on stdout.

    BENCH_SF_DIR   folder with the tables (default /root/testdata/sf0.1)
    BENCH_CPUS     local cores (default 8)
    BENCH_QUERIES  comma-separated names (default: the headline set below; "all" for every query)
    BENCH_RUNS     timed runs per query after one warm-up (default 1); the median is reported
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from barflow import catalog  # noqa: E402
from barflow.session import local_session  # noqa: E402

HEADLINE = [
    "bars_15m", "bars_1h", "ema_bounded", "rsi_bounded", "atr_bounded", "adx_bounded",
    "volume_ratio", "price_structure", "price_moves", "mtf_asof", "regime_state", "context_asof",
    "signals", "live_signals", "universe_top10", "decision_cascade", "signal_cycle", "throttle", "barrier_labels",
    "label_report", "legs_to_positions", "trade_pnl", "vwap", "imbalance", "reconcile",
    "mark_to_market", "cumulative_profit", "running_top", "pnl_rollup", "stop_streak", "exclusions",
    "exit_monitor", "auc", "chrono_split", "coerce_clean", "ragged_repair", "stream_bars",
    "stream_throttle",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    queries = catalog.queries()
    names = list(queries) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = local_session(cpus, "barflow-bench")
    times = {}
    for name in names:
        spent = []
        for _ in range(runs + 1):
            started = time.time()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            spent.append(time.time() - started)
        times[name] = round(statistics.median(spent[1:]), 3)
    print(json.dumps({
        "metric": f"total seconds of {len(times)} queries, warm", "value": round(
            sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
