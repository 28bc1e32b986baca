"""Headline queries, each timed from the raw tables to the last row.

Prints one JSON line. Reads BENCH_SF_DIR (default the sf0.1 tables) and BENCH_CPUS.
"""

from __future__ import annotations

import json
import os
import time

HEADLINE = [
    "panel_monthly", "panel_daily", "daily_features_sparse", "ttm_yoy", "asof_events", "flow_changepoints",
    "signal_report", "ic_by_horizon", "quantile_returns", "strategy_backtest", "elastic_net_oos", "rebalance_plan",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    from factorloom.catalog import registry, views
    from factorloom.session import local_session

    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8, app="bench")
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        views.forget_stored()  # every query pays for all it derives
        start = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    registry.QUERIES["ic_by_date"](spark, sf_dir).count()  # JVM and file cache warm-up
    seconds = {name: round(run(name), 3) for name in HEADLINE}
    views.forget_stored()
    rows = {name: registry.QUERIES[name](spark, sf_dir).count() for name in ("panel_monthly", "daily_features_sparse")}
    spark.stop()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")),
        "rows_per_sec": {n: round(k / seconds[n]) for n, k in rows.items()},
    }))


if __name__ == "__main__":
    main()
