"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = (
    "c1_exact_duplicates", "p14_prepared_history", "w2_w3_by_sensor", "a6_peak_summary", "a7_dataset_statistics",
    "a12_volume_heatmap", "a16_weather_box", "a26_median_lags_by_hour", "m1_stratified_split", "m11_class_report",
    "m14_permutation_importance", "m4_random_forest", "g1_risk_by_hour", "g8_corridor_state", "g9_corridor_summary",
    "g17_live_report", "i9_congestion_report", "i10_predict_explain_plan", "m13_train_and_compare",
    "g12_segment_history", "l1_alert_stream",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("roadpulse-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from roadpulse.catalog import all_queries

    registered = all_queries()

    def run(name: str) -> float:
        start = time.perf_counter()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    run("a1_mean_by_hour")  # JVM and code-generation warm-up
    seconds = {name: run(name) for name in names}
    print(json.dumps({
        "metric": "total_wall_time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
