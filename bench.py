"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "B1_tick_bars", "B2_volume_bars", "B10_multi_timeframe", "C5_drop_outliers", "C10_return_profile",
    "A3_exact_percentiles", "F2_rolling_zscore", "F5_tick_intensity", "F18_vpin", "F36_pivot_supertrend",
    "G3_fvg_state_features", "J1_asof_join", "N1_kalman", "L1_triple_barrier", "L12_sequences",
    "P10_confidence_gate", "V3_purged_kfold", "V7_ranking_metrics", "R7_loss_streaks", "R13_mark_positions",
]


def main() -> None:
    from catalog.all import REGISTRY
    from tickspark.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus=cpus, shuffle_partitions=cpus)

    def run(name: str) -> float:
        start = time.perf_counter()
        REGISTRY[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("B1_tick_bars")  # start the JVM paths and the Python workers
    run("F5_tick_intensity")
    seconds = {name: round(run(name), 3) for name in names}
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
