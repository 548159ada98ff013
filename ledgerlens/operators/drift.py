"""Population stability of features and scores, delayed-label performance and the status summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.operators.evaluation import LABEL, ranking_metrics
from ledgerlens.operators.ordering import wide_quantiles
from ledgerlens.schema import TREND_FEATURES
from ledgerlens.session import materialize

# Conventional limits.
PSI_WARN, PSI_ALERT = 0.10, 0.25
DROP_WARN, DROP_ALERT = 0.15, 0.30
PSI_FLOOR = 1e-4


def status(v: Column) -> Column:
    return F.when(v >= PSI_ALERT, "alert").when(v >= PSI_WARN, "warn").otherwise("ok")


def _long(df: DataFrame, features: Sequence[str], by: Sequence[str]) -> DataFrame:
    parts = [F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features]
    return df.select(*by, F.explode(F.array(*parts)).alias("_f")).select(*by, "_f.feature", "_f.x")


def bin_edges(reference: DataFrame, features: Sequence[str], bins: int = 10) -> DataFrame:
    """Per feature the distinct inner quantiles of the reference, ascending."""
    probs = [i / bins for i in range(1, bins)]
    q = wide_quantiles(reference, {f: F.col(f) for f in features}, probs)
    return q.groupBy("feature").agg(F.sort_array(F.collect_set("q")).alias("edges"))  # at most bins - 1 values


def bin_counts(df: DataFrame, features: Sequence[str], edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts per (by, feature, bin); bin -1 holds missing values. Partial counts are tiny before the shuffle."""
    joined = _long(df, features, by).join(F.broadcast(edges), "feature", "left")  # one small array per feature
    joined = joined.withColumn("edges", F.coalesce("edges", F.array().cast("array<double>")))
    bin_ = F.when(F.col("x").isNull(), -1).otherwise(F.size(F.filter("edges", lambda e: e <= F.col("x"))))
    return joined.groupBy(*by, "feature", bin_.alias("bin")).agg(F.count("*").alias("n"))


def _profile(binned: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Bin counts of each group as one map (at most bins + 1 entries) with its total."""
    entries = F.map_from_entries(F.collect_list(F.struct("bin", "n")))
    return binned.groupBy(*keys).agg(entries.alias(f"{name}_bins"), F.sum("n").alias(f"{name}_all"))


def psi_table(reference: DataFrame, current: DataFrame, features: Sequence[str], by: Sequence[str] = (),
              bins: int = 10) -> DataFrame:
    """PSI per (by, feature); missing when the reference or the current side has no value at all."""
    edges = materialize(bin_edges(reference, features, bins), "edges")  # one row per feature, used by every step below
    return psi_of_counts(edges, bin_counts(reference, features, edges), bin_counts(current, features, edges, by), by)


def psi_of_counts(edges: DataFrame, reference: DataFrame, current: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """PSI per (by, feature) from counts per bin, however they came about."""
    ref, cur = _profile(reference, ["feature"], "ref"), _profile(current, [*by, "feature"], "cur")
    both = cur.join(ref, "feature").join(edges, "feature", "left")

    def count(side, b):
        return F.coalesce(F.try_element_at(F.col(f"{side}_bins"), b), F.lit(0))

    def share(side, b):
        return F.greatest(count(side, b) / F.col(f"{side}_all"), F.lit(PSI_FLOOR))

    def term(total, b):
        return total + (share("cur", b) - share("ref", b)) * F.log(share("cur", b) / share("ref", b))

    all_bins = F.sequence(F.lit(-1), F.coalesce(F.size("edges"), F.lit(0)))
    filled = ((F.col("cur_all") > count("cur", F.lit(-1))) & (F.col("ref_all") > count("ref", F.lit(-1))))
    return both.select(*by, "feature", F.when(filled, F.aggregate(all_bins, F.lit(0.0), term)).alias("psi"))


def feature_drift(reference: DataFrame, current: DataFrame, features: Sequence[str]) -> DataFrame:
    """PSI and status per feature, largest first."""
    out = psi_table(reference, current, features).withColumn("status", status(F.col("psi")))
    return out.orderBy(F.desc_nulls_last("psi"), "feature")


def drift_features(features: Sequence[str]) -> list[str]:
    return [f for f in features if f not in TREND_FEATURES]


def with_windows(scored: DataFrame, window_days: int, day: str = "day") -> DataFrame:
    """Adds the block number since the first day and keeps blocks with at least 70 % of their days."""
    first = scored.agg(F.min(day).alias("_d0"))
    d = scored.crossJoin(F.broadcast(first)).withColumn("window", F.floor((F.col(day) - F.col("_d0")) / window_days)
                                                        .cast("int"))
    full = (d.groupBy("window").agg(F.countDistinct(day).alias("_days"))
            .where(F.col("_days") >= 0.7 * window_days).select("window"))
    return d.join(F.broadcast(full), "window", "left_semi")  # one row per block


def windowed_drift(scored: DataFrame, reference: DataFrame, features: Sequence[str], score: str, window_days: int,
                   threshold: float) -> DataFrame:
    """Per block: score PSI, feature PSI counts, the three most shifted features, alert rate and mean score.

    ``reference`` carries the features and the score column.
    """
    features = drift_features(features)
    d = with_windows(scored, window_days)
    psi = psi_table(reference, d, [*features, score], ["window"])
    base = d.groupBy("window").agg(F.min("_d0").alias("_d0"), F.count("*").alias("n_txn"),
                                   F.avg(F.when(F.col(score) >= threshold, 1.0).otherwise(0.0)).alias("alert_rate"),
                                   F.avg(score).alias("mean_score"))
    return drift_report(psi, base, score, window_days)


def drift_report(psi: DataFrame, base: DataFrame, score: str, window_days: int) -> DataFrame:
    """The report from PSI per (window, feature) and ``base``: ``_d0``, ``n_txn``, ``alert_rate`` and ``mean_score`` per window."""
    score_psi = psi.where(F.col("feature") == score).select("window", F.col("psi").alias("score_psi"))
    ranked = psi.where(F.col("feature") != score).withColumn("rank", F.row_number().over(
        Window.partitionBy("window").orderBy(F.desc_nulls_last("psi"), "feature")))  # one row per feature
    name = F.concat(F.col("feature"), F.lit(" ("), F.format_number("psi", 2), F.lit(")"))
    per = ranked.groupBy("window").agg(
        F.max("psi").alias("max_feature_psi"),
        F.sum(F.when(F.col("psi") >= PSI_WARN, 1).otherwise(0)).alias("n_features_warn"),
        F.sum(F.when(F.col("psi") >= PSI_ALERT, 1).otherwise(0)).alias("n_features_alert"),
        F.sort_array(F.collect_list(F.when(F.col("rank") <= 3, F.struct("rank", name.alias("name"))))).alias("_top"))
    start = F.col("_d0") + F.col("window") * window_days
    return (base.join(per, "window").join(score_psi, "window")
            .select("window", start.alias("start_day"), (start + window_days - 1).alias("end_day"), "n_txn", "score_psi",
                    status(F.col("score_psi")).alias("score_status"), "max_feature_psi", "n_features_warn",
                    "n_features_alert", F.array_join(F.col("_top.name"), ", ").alias("top_drifting_features"),
                    "alert_rate", "mean_score"))


def delayed_performance(scored: DataFrame, score: str, window_days: int, threshold: float, label_delay_days: int,
                        as_of_day: int | None = None, min_fraud: int = 5) -> DataFrame:
    """Per block: fraud rate and, once its labels are mature and it has enough fraud, PR-AUC, precision, recall."""
    d = with_windows(scored, window_days)
    as_of = (scored.agg(F.max("day").alias("_as_of")) if as_of_day is None
             else scored.sparkSession.range(1).select(F.lit(as_of_day).alias("_as_of")))
    alert = F.col(score) >= threshold
    base = d.groupBy("window").agg(
        F.min("_d0").alias("_d0"), F.avg(LABEL).alias("fraud_rate"), F.sum(LABEL).alias("_y"),
        F.sum(F.when(alert, 1).otherwise(0)).alias("_a"),
        F.sum(F.when(alert & (F.col(LABEL) == 1), 1).otherwise(0)).alias("_tp"))
    ranks = ranking_metrics(d, score, ["window"]).select("window", "pr_auc")
    out = base.join(ranks, "window").crossJoin(F.broadcast(as_of))
    start = F.col("_d0") + F.col("window") * window_days
    end = start + window_days - 1
    mature = end + label_delay_days <= F.col("_as_of")
    shown = mature & (F.col("_y") >= min_fraud)
    return out.select(
        "window", start.alias("start_day"), end.alias("end_day"), mature.alias("labels_mature"), "fraud_rate",
        F.when(shown, F.col("pr_auc")).alias("pr_auc"),
        F.when(shown, F.col("_tp") / F.greatest(F.col("_a"), F.lit(1))).alias("precision"),
        F.when(shown, F.col("_tp") / F.greatest(F.col("_y"), F.lit(1))).alias("recall"))


def summarize(drift: DataFrame, performance: DataFrame, baseline_pr_auc: float, baseline_recall: float) -> DataFrame:
    """One row: overall status, findings and the latest block. Inputs hold one row per block."""
    last = drift.agg(F.max_by(F.struct("*"), "window").alias("d"))
    seen = (performance.where("labels_mature and pr_auc is not null")
            .agg(F.max_by(F.struct("pr_auc", "recall"), "window").alias("p")))
    one = last.crossJoin(F.broadcast(seen))

    def drop(name, baseline):
        return F.lit(0.0) if not baseline else 1 - F.col(f"p.{name}") / baseline

    worst = F.when(F.col("p").isNotNull(), F.greatest(drop("pr_auc", baseline_pr_auc), drop("recall", baseline_recall)))
    levels = {"ok": 0, "warn": 1, "alert": 2}
    features = F.when(F.col("d.n_features_alert") > 0, 2).when(F.col("d.n_features_warn") > 0, 1).otherwise(0)
    scores = F.when(F.col("d.score_status") == "alert", 2).when(F.col("d.score_status") == "warn", 1).otherwise(0)
    perf = F.coalesce(F.when(worst >= DROP_ALERT, 2).when(worst >= DROP_WARN, 1).otherwise(0), F.lit(0))
    level = F.greatest(features, scores, perf)

    # fixed values: the wording of the findings
    def drifted(count, limit):
        return F.format_string(f"%d feature(s) with PSI >= {limit} in latest window: %s", F.col(count).cast("int"),
                               F.col("d.top_drifting_features"))

    pr_auc = F.format_string("PR-AUC %.2f vs %.2f", F.col("p.pr_auc"), F.lit(float(baseline_pr_auc or 0)))
    recall = F.format_string("recall %.2f vs %.2f", F.col("p.recall"), F.lit(float(baseline_recall or 0)))
    findings = F.array_compact(F.array(
        F.when(features == 2, drifted("d.n_features_alert", PSI_ALERT))
        .when(features == 1, drifted("d.n_features_warn", PSI_WARN)),
        F.when(scores > 0, F.format_string("model-score distribution shifted (PSI %.2f)", F.col("d.score_psi"))),
        F.when(perf == 2, F.concat(F.lit("performance down vs validation baseline ("), pr_auc, F.lit("; "), recall,
                                   F.lit(")")))
        .when(perf == 1, F.concat(F.lit("performance slipping vs validation baseline ("), pr_auc, F.lit(")")))))
    quiet = F.array(F.lit("no material drift or performance degradation detected"))
    names = F.array(*[F.lit(k) for k in levels])
    return one.select(F.element_at(names, level + 1).alias("status"),
                      F.when(F.size(findings) > 0, findings).otherwise(quiet).alias("findings"),
                      F.col("d.window").alias("latest_window"))
