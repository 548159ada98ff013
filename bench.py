"""Seconds per headline query at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The dataset (all 52 features, stored once) is timed as a query of its own; the evaluation and monitoring queries that
follow read it, as they do in a real run. ``md4_train_and_select`` fits all models with the production settings.
"""

from __future__ import annotations

import json
import os
import time

from ledgerlens.plans import catalog
from ledgerlens.session import local_session, tune

QUERIES = [
    "q01_transaction_frequency", "q02_daily_volume", "q02_daily_volume_sales", "q03_spending_patterns_sales",
    "q04_customer_segmentation", "q05_unusual_behaviour", "q06_unusual_behaviour_summary", "q07_merchant_risk_sales",
    "q08_category_risk_sales", "q09_hourly_lift", "q10_daily_anomalies", "q11_velocity_peaks", "f24_all_features",
    "dataset", "scores", "ru2_noisy_or", "ev1_ranking_metrics", "ev3_business_cost", "ev4_threshold_by_cost",
    "ev9_method_comparison", "br1_false_positive_rates", "br4_slice_report", "mn1_psi", "mn3_feature_drift",
    "mn4_windowed_drift", "ev8_at_budget", "ev10_bootstrap_interval", "ev12_calibration_table", "dq2_referential_integrity",
    "dq5_row_validation", "jn10_relevant_history", "st2_replay", "an3_isolation_forest", "md4_train_and_select", "ex3_merged_reasons",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, memory="16g", app="bench")
    tune(spark).sparkContext.setLogLevel("ERROR")
    steps = {**catalog.QUERIES, "dataset": catalog.feature_table, "scores": catalog.scored}
    spark.range(1000).selectExpr("sum(id)").collect()  # starts the executor
    seconds = {}
    for name in QUERIES:
        start = time.perf_counter()
        steps[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(sf.rstrip("/")), "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
