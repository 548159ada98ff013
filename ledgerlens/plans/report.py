"""End-to-end run: dataset, training, evaluation, reasons, monitoring and all written artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.config import Settings
from ledgerlens.operators import breakdown, drift, evaluation
from ledgerlens.operators.dataset import make_dataset
from ledgerlens.operators.explain import with_reasons
from ledgerlens.operators.provenance import manifest
from ledgerlens.plans.training import SCORES, Trained, drift_reference, train_all
from ledgerlens.session import materialize
from ledgerlens.sources.views import Star
from ledgerlens.sources.writers import write_csv, write_json, write_scored


def run(star: Star, settings: Settings, out: str, truth: DataFrame | None = None) -> Trained:
    """Trains on the star and writes model, metrics, scored rows, monitoring and manifest below ``out``."""
    data = make_dataset(star, settings)
    trained = train_all(data, settings)
    model = trained.model
    model.save(f"{out}/model")
    scored = trained.scored
    test, valid = trained.scored.where(F.col("split") == "test"), trained.scored.where(F.col("split") == "valid")
    alert = F.col("p_model") >= model.review

    explained = with_reasons(model, test, alert)
    sink = valid.withColumns({"reasons": F.lit(""), "top_reason": F.lit("")}).unionByName(explained)
    # the truth is joined for the sink and the diagnostics alone
    write_scored(sink if truth is None else sink.join(truth, "txn_id", "left"), f"{out}/scored")

    budget = evaluation.workload_report(test, alert).first()["n_alerts"]
    methods = {**{n: c for n, c in SCORES.items() if c in scored.columns}, "selected_calibrated": "p_model"}
    metrics = {
        "splits": evaluation.split_summary(scored),
        "methods_test": evaluation.method_comparison(test, methods, int(budget)),
        "methods_valid": evaluation.method_comparison(valid, methods),
        "operating_point": evaluation.confusion(test, alert),
        "operating_point_interval": evaluation.bootstrap_interval(test, "p_model"),
        "block_band": evaluation.confusion(test, F.col("p_model") >= model.block),
        "band_counts": evaluation.band_counts(test),
        "cost": evaluation.cost_comparison(test, alert, settings.cost),
        "workload": evaluation.workload_report(test, alert, settings.cost),
        "by_block": evaluation.block_performance(test, "p_model", model.review),
        "calibration": evaluation.calibration_table(test, "p_model"),
        "calibration_summary": evaluation.calibration_summary(test, "p_model"),
        "false_positives": breakdown.false_positive_rates(test, alert),
        "false_positive_concentration": breakdown.false_positive_concentration(test, alert),
        "top_false_positive_customers": breakdown.top_false_positive_customers(test, alert),
        "top_false_positive_rules": breakdown.top_false_positive_rules(test, alert),
        "slices": breakdown.slice_report(test, alert),
    }
    if truth is not None:
        metrics["recall_by_pattern"] = evaluation.recall_by_pattern(
            test, truth, "p_model", model.review)
        metrics["undiscovered_share"] = evaluation.undiscovered_share(
            test, truth, "p_model", model.review)
    for name, df in metrics.items():
        write_json(df, f"{out}/metrics/{name}")

    reference = model.predict(drift_reference(data.where(F.col("split") == "train"), settings.training))
    reference = materialize(reference.select(*model.features, "p_model"), "drift-reference")
    days = settings.monitor_window_days
    moves = materialize(drift.windowed_drift(scored, reference, model.features, "p_model", days, model.review), "drift")
    perf = materialize(drift.delayed_performance(scored, "p_model", days, model.review, settings.split.label_delay_days), "perf")
    base = evaluation.ranking_metrics(valid, "p_model").first()["pr_auc"]
    recall = evaluation.confusion(valid, alert).first()["recall"]
    write_csv(moves, f"{out}/monitoring/drift_windows")
    write_csv(perf, f"{out}/monitoring/performance_windows")
    summary = drift.summarize(moves, perf, base, recall).withColumns({
        "baseline_valid_pr_auc": F.lit(base), "baseline_valid_recall": F.lit(recall)})
    write_json(summary, f"{out}/monitoring/summary")
    blocks = drift.with_windows(scored, days)
    last = blocks.agg(F.max("window").alias("window"))
    latest = blocks.join(F.broadcast(last), "window", "left_semi")
    write_csv(drift.feature_drift(reference, latest, drift.drift_features(model.features)), f"{out}/monitoring/feature_psi_latest")

    columns = ["txn_id", "customer_id", "merchant_id", "account_id", "ts_epoch", "channel", "amount", "is_fraud"]
    write_json(manifest(star.transactions.select(*columns), settings, {"algorithm": model.name, "valid_pr_auc": base}),
               f"{out}/run_manifest")
    return trained
