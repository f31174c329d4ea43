"""Headline queries, warm session, best-of-N wall seconds; prints one JSON line.

``BENCH_SF_DIR`` (default sf0.1), ``BENCH_CPUS`` (default all), ``BENCH_REPEAT`` (default 3, the median is kept).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "fri_class_shares",
    "d1_fri",
    "d2_fri_forest_weighted",
    "d5_risk_class",
    "d7_attributed_loss",
    "a5_season_dec_shift",
    "a8_coarsen_pad",
    "a15_weighted_quantiles",
    "a24_percentiles",
    "f13_polygon_mask",
    "f17_scene_dedup",
    "j2_reindex_nearest",
    "j5_cells_near_points",
    "t1_theil_sen_cells",
    "t2_spearman",
    "t3_ols",
    "t6_fdr_bh",
    "t7_chow_test",
    "w1_moving_mean",
    "w7_trailing_mean",
    "d11_disturbance_series",
    "d13_score_events",
    "l1_feature_table",
    "l8_trend_scenario",
    "e2_season_trends",
)


def main() -> None:
    from firegrid.plans import catalog
    from firegrid.session import get_spark

    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "*")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    parts = cpus if cpus.isdigit() else str(os.cpu_count() or 8)
    spark = get_spark(
        "bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": parts, "spark.ui.enabled": "false", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["fri_class_shares"](spark, d).collect()  # start-up and code generation
    times: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(repeat):
            t0 = time.perf_counter()
            catalog.QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(runs), 4)
    sf = os.path.basename(d).removeprefix("sf")
    print(
        json.dumps(
            {"metric": "headline_total", "value": round(sum(times.values()), 4), "unit": "sec", "queries": times, "sf": sf}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
