"""Time the headline queries: one JSON line. BENCH_SF_DIR, BENCH_CPUS and BENCH_QUERIES choose data, threads and keys."""

import json
import os
import time

from pyspark.sql import SparkSession

from workbook import QUERIES

HEADLINE = [
    "reconciled_turnover", "end_to_end", "allocation_chain", "enforce_minimum", "industry_cost_control", "eav_pivot", "collect_periods",
    "group_total", "concentration_curve", "multi_level_totals", "linear_trend", "growth_features", "productivity_features",
    "training_sets", "history_series", "hot_deck", "hot_deck_bootstrap", "knn_regress", "knn_impute", "rolling_backtest",
    "regression_metrics", "text_term_counts", "points_in_polygons", "od_costs", "gbt_regress",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    if names == ["all"]:
        names = list(QUERIES)
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g")).config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["join_inner"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start-up is not timed
    secs = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        secs[name] = round(time.time() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(secs.values()), 3), "unit": "sec", "queries": secs,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
