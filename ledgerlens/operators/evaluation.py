"""Ranking, operating-point, cost and calibration metrics as grouped aggregations.

Ranking metrics work on a *score table*: one row per distinct score with its row and positive counts, so ties are
exact and frequent scores cost nothing. Running totals over it give every threshold at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.config import Cost
from ledgerlens.functions.columns import ratio
from ledgerlens.operators.ordering import global_row_number, join_null_safe, quantiles_of_table, range_partitioned, running_totals
from ledgerlens.session import materialize

LABEL = "is_fraud"


def _count(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


# ------------------------------------------------------------------------------------------ ranking
def score_table(df: DataFrame, score: str, by: Sequence[str] = (), label: str = LABEL, amount: str | None = None,
                weight: str | None = None) -> DataFrame:
    """Per (by, score): rows ``n``, positives ``pos`` and, if asked, the amount of positives ``pos_amount``."""
    w = F.col(weight) if weight else F.lit(1)
    aggs = [F.sum(w).cast("bigint").alias("n"), F.sum(w * F.col(label)).cast("bigint").alias("pos")]
    if amount:
        aggs.append(F.sum(F.when(F.col(label) == 1, F.col(amount)).otherwise(0.0)).alias("pos_amount"))
    return df.groupBy(*by, F.col(score).alias("score")).agg(*aggs)


def threshold_table(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Score table plus, per score used as threshold, the alerts ``alerts`` and caught positives ``tp``."""
    totals = {"alerts": "n", "tp": "pos"}
    if "pos_amount" in scores.columns:
        totals["tp_amount"] = "pos_amount"
    return running_totals(scores, "score", totals, by)


def ranking_from_thresholds(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    positives, rows = F.max("tp"), F.max("alerts")
    negatives = rows - positives
    pos = F.col("pos").cast("double")  # a product of two counts can leave the range of a long
    ap = F.sum(pos * F.col("tp") / F.col("alerts"))
    pairs = F.sum((F.col("n") - pos) * (F.col("tp") - pos / 2))
    both = (positives > 0) & (negatives > 0)
    return table.groupBy(*by).agg(
        rows.alias("n"), positives.alias("n_fraud"),
        F.when(both, ap / positives).alias("pr_auc"),
        F.when(both, pairs / positives / negatives).alias("roc_auc"),
        (positives / rows).alias("base_rate"))


def ranking_metrics(df: DataFrame, score: str, by: Sequence[str] = (), label: str = LABEL,
                    weight: str | None = None) -> DataFrame:
    """Step-wise average precision, ROC-AUC with tied scores averaged, base rate; missing with one class only."""
    return ranking_from_thresholds(threshold_table(score_table(df, score, by, label, weight=weight), by), by)


def precision_recall_points(df: DataFrame, score: str, label: str = LABEL) -> DataFrame:
    """One point per distinct score used as threshold."""
    table = threshold_table(score_table(df, score, label=label))
    total = table.agg(F.sum("pos").alias("_p"))
    return table.crossJoin(F.broadcast(total)).select(
        F.col("score").alias("threshold"), (F.col("tp") / F.col("alerts")).alias("precision"),
        ratio(F.col("tp"), F.col("_p")).alias("recall"), "alerts")


def unpivot_scores(df: DataFrame, scores: dict[str, str], keep: Sequence[str]) -> DataFrame:
    """Long form (method, score) of several score columns."""
    parts = [F.struct(F.lit(name).alias("method"), F.col(c).cast("double").alias("score")) for name, c in scores.items()]
    return df.select(*keep, F.explode(F.array(*parts)).alias("_m")).select(*keep, "_m.method", "_m.score")


def at_budget(df: DataFrame, score: str, k: Column | int, by: Sequence[str] = (), label: str = LABEL,
              row_id: str = "txn_id") -> DataFrame:
    """Precision and recall when only the k best-scored rows are reviewed; ties are taken in id order.

    The threshold table names the score at which the budget ends; only the rows tied there are put in id order. ``k`` is a number
    or a column that is constant within ``by``.
    """
    k = F.lit(k) if isinstance(k, int) else k
    slim = df.select(*by, F.col(row_id).alias("_id"), F.col(score).alias("score"), F.col(label).alias("_y"), k.alias("_k"))
    table = threshold_table(score_table(slim, "score", by, "_y"), by)
    budget = slim.groupBy(*by).agg(F.greatest(F.max("_k"), F.lit(1)).alias("_k"), F.count("*").alias("_all"), F.sum("_y").alias("_pos"))
    budget = budget.withColumn("_k", F.least("_k", "_all").cast("bigint"))
    reached = F.when(F.col("alerts") >= F.col("_k"), F.struct("alerts", "score", "n", "pos", "tp"))
    cut = join_null_safe(table, budget, by).groupBy(*by, "_k", "_pos").agg(F.min(reached).alias("c")).select(
        *by, "_k", "_pos", F.col("c.score").alias("_cut"), (F.col("c.tp") - F.col("c.pos")).alias("_sure"),
        (F.col("_k") - F.col("c.alerts") + F.col("c.n")).alias("_more"))
    cut = materialize(cut, "cuts")  # one row per group
    tied = join_null_safe(slim, cut, by).where(F.col("score").eqNullSafe(F.col("_cut")))
    ranked = global_row_number(tied.select(*by, "_id", "_y", "_more"), ["_id"], by)
    chosen = ranked.groupBy(*by).agg(F.sum(F.when(F.col("rn") <= F.col("_more"), F.col("_y")).otherwise(0)).alias("_tied"))
    caught = F.col("_sure") + F.col("_tied")
    return join_null_safe(cut, chosen, by).select(
        *by, F.col("_k").alias("k"), (caught / F.col("_k")).alias("precision"),
        (caught / F.greatest(F.col("_pos"), F.lit(1))).alias("recall"))


def method_comparison(df: DataFrame, scores: dict[str, str], budget: int | None = None, by: Sequence[str] = (),
                      label: str = LABEL) -> DataFrame:
    """Ranking metrics of every score column on the same rows, with precision/recall at a shared alert budget."""
    long = unpivot_scores(df, scores, ["txn_id", label, *by])
    keys = [*by, "method"]
    out = ranking_metrics(long, "score", keys, label)
    if budget is None:
        return out
    top = at_budget(long, "score", budget, keys, label).select(
        *keys, F.col("k").alias("budget_alerts"), F.col("precision").alias("precision_at_budget"),
        F.col("recall").alias("recall_at_budget"))
    return out.join(top, keys)


# ---------------------------------------------------------------------------------- operating points
def confusion(df: DataFrame, alert: Column, by: Sequence[str] = (), label: str = LABEL) -> DataFrame:
    y, a = F.col(label) == 1, F.coalesce(alert, F.lit(False))
    counts = df.groupBy(*by).agg(_count(y & a).alias("tp"), _count(~y & a).alias("fp"), _count(y & ~a).alias("fn"),
                                 _count(~y & ~a).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return counts.withColumns({
        "precision": precision, "recall": recall,
        "f1": ratio(2 * precision * recall, precision + recall),
        "false_positive_rate": ratio(fp, fp + tn), "alert_rate": (tp + fp) / (tp + fp + fn + tn),
        "false_discovery_rate": ratio(fp, tp + fp)})


def business_cost(df: DataFrame, alert: Column, cost: Cost = Cost(), by: Sequence[str] = (), label: str = LABEL,
                  amount: str = "amount") -> DataFrame:
    """Review, friction, missed-fraud and total cost of an alerting policy, and the fraud amount it prevents."""
    y, a, amt = F.col(label) == 1, F.coalesce(alert, F.lit(False)), F.col(amount)
    out = df.groupBy(*by).agg(
        (_count(a) * cost.review_cost).alias("review_cost"),
        (_count(a & ~y) * cost.friction_cost).alias("friction_cost"),
        (F.sum(F.when(y & ~a, amt * cost.loss_given_missed + cost.fraud_fixed_cost).otherwise(0.0)))
        .alias("missed_fraud_cost"),
        (F.sum(F.when(y & a, amt).otherwise(0.0)) * cost.loss_given_missed).alias("fraud_prevented"))
    total = F.col("review_cost") + F.col("friction_cost") + F.col("missed_fraud_cost")
    return out.withColumn("total_cost", total)


def cost_comparison(df: DataFrame, alert: Column, cost: Cost = Cost()) -> DataFrame:
    """Total cost of the alerting policy, of no alerts and of alerting on everything, from one scan."""
    policies = {"model": F.coalesce(alert, F.lit(False)), "no_model": F.lit(False), "alert_everything": F.lit(True)}
    parts = [F.struct(F.lit(n).alias("policy"), a.alias("_alert")) for n, a in policies.items()]
    long = df.select(LABEL, "amount", F.explode(F.array(*parts)).alias("_p")).select(LABEL, "amount", "_p.policy",
                                                                                     "_p._alert")
    out = business_cost(long, F.col("_alert"), cost, ["policy"])
    none = F.max(F.when(F.col("policy") == "no_model", F.col("total_cost"))).over(Window.partitionBy())
    return out.withColumn("saving_vs_no_model", none - F.col("total_cost")).withColumn(
        "saving_pct", F.when(none != 0, 100 * (1 - F.col("total_cost") / none)))


def daily_review(alerts: Column, days: Column, cost: Cost = Cost()) -> Column:
    """Struct of alerts, review hours and analysts of an average day; zero without days."""
    hours = cost.review_minutes_per_alert / 60
    daily = ratio(alerts.cast("double"), days)
    return F.struct(daily.alias("alerts_per_day"), (daily * hours).alias("review_hours_per_day"),
                    (daily * (hours / cost.analyst_hours_per_day)).alias("analysts_needed"))


def workload_report(df: DataFrame, alert: Column, cost: Cost = Cost(), day: str = "day") -> DataFrame:
    """Alerts, days with transactions, and the review work of an average day."""
    counted = df.agg(_count(alert).alias("n_alerts"), F.countDistinct(day).alias("n_days"))
    return counted.withColumn("_w", daily_review(F.col("n_alerts"), F.col("n_days"), cost)).select("n_alerts", "n_days", "_w.*")


# ------------------------------------------------------------------------------------ threshold choice
def quantile_grid(low: float, high: float, points: int) -> list[float]:
    return [float(p) for p in np.linspace(low, high, points)]


def _cost_table(df: DataFrame, score: str, label: str) -> DataFrame:
    """Threshold table with amounts, stored once: quantiles, costs and precision limits all come from it."""
    return materialize(threshold_table(score_table(df, score, label=label, amount="amount")), "thresholds")


def _quantiles(table: DataFrame, probs: Sequence[float], carry: Sequence[str] = ()) -> DataFrame:
    total = table.agg(F.sum("n").alias("_all"))
    ascending = table.crossJoin(F.broadcast(total)).select(
        F.col("score").alias("_v"), F.col("n").alias("_n"), (F.col("_all") - F.col("alerts") + F.col("n")).alias("_upto"), *carry)
    return quantiles_of_table(ascending, probs, carry=carry)


def _curve(table: DataFrame, cost: Cost, points: int, high: float, low: float) -> DataFrame:
    found = ["alerts", "tp", "tp_amount"]
    grid = _quantiles(table, quantile_grid(low, high, points), found)
    grid = grid.groupBy(F.col("q").alias("threshold")).agg(*[F.max(c).alias(c) for c in found])  # equal quantiles, equal counts
    totals = table.agg(F.sum("pos").alias("_p"), F.sum("pos_amount").alias("_amount"))
    missed = ((F.col("_amount") - F.col("tp_amount")) * cost.loss_given_missed
              + (F.col("_p") - F.col("tp")) * cost.fraud_fixed_cost)
    total = F.col("alerts") * cost.review_cost + (F.col("alerts") - F.col("tp")) * cost.friction_cost + missed
    return grid.crossJoin(F.broadcast(totals)).select(
        "threshold", "alerts", "tp", ratio(F.col("tp"), F.col("_p")).alias("recall"), total.alias("total_cost"),
        (F.col("_amount") * cost.loss_given_missed + F.col("_p") * cost.fraud_fixed_cost).alias("no_alert_cost"))


def cost_curve(df: DataFrame, score: str, cost: Cost = Cost(), points: int = 400, high: float = 0.9999,
               low: float = 0.5, label: str = LABEL) -> DataFrame:
    """Cost and catch of alerting at each distinct quantile of the score, from one running total."""
    return _curve(_cost_table(df, score, label), cost, points, high, low)


def _cheapest(curve: DataFrame) -> DataFrame:
    best = curve.agg(F.min(F.struct(F.round("total_cost", 6).alias("c"), "threshold")).alias("b"),
                     F.max("no_alert_cost").alias("none"))
    wins = F.col("b.c") < F.round("none", 6)
    return best.select(F.when(wins, F.col("b.threshold")).otherwise(F.lit(float("inf"))).alias("threshold"),
                       F.when(wins, F.col("b.c")).otherwise(F.col("none")).alias("cost"))


def threshold_by_cost(df: DataFrame, score: str, cost: Cost = Cost(), points: int = 400, label: str = LABEL) -> DataFrame:
    """Cheapest grid threshold (the lowest on ties); infinite when alerting never beats not alerting."""
    return _cheapest(cost_curve(df, score, cost, points, label=label))


def _precise(table: DataFrame, min_precision: float, min_alerts: int) -> DataFrame:
    good = (F.col("tp") / F.col("alerts") >= min_precision) & (F.col("alerts") >= min_alerts)
    return table.agg(F.coalesce(F.min(F.when(good, F.col("score"))), F.lit(float("inf"))).alias("threshold"))


def threshold_by_precision(df: DataFrame, score: str, min_precision: float = 0.9, min_alerts: int = 20,
                           label: str = LABEL) -> DataFrame:
    """Lowest threshold that keeps the precision with enough alerts; infinite if there is none."""
    return _precise(threshold_table(score_table(df, score, label=label)), min_precision, min_alerts)


def operating_thresholds(df: DataFrame, score: str, cost: Cost = Cost(), label: str = LABEL) -> DataFrame:
    """Review and block thresholds with their fallbacks: the 99 % quantile, and a block level nothing reaches."""
    table = _cost_table(df, score, label)
    review = _cheapest(_curve(table, cost, 400, 0.9999, 0.5)).select(F.col("threshold").alias("_r"), "cost")
    block = _precise(table, 0.9, 20).select(F.col("threshold").alias("_b"))
    q99 = _quantiles(table, [0.99]).select(F.col("q").alias("_q"))
    one = review.crossJoin(F.broadcast(block)).crossJoin(F.broadcast(q99))
    infinite = F.lit(float("inf"))
    chosen = F.when(F.col("_r") == infinite, F.col("_q")).otherwise(F.col("_r"))
    return one.select(chosen.alias("review"),
                      F.when(F.col("_b") == infinite, F.lit(1.01)).otherwise(F.greatest("_b", chosen)).alias("block"),
                      F.col("cost").alias("valid_cost"))


# ------------------------------------------------------------------------------------------ over time
def block_performance(df: DataFrame, score: str, threshold: float, block_days: int = 30, day: str = "day") -> DataFrame:
    """Ranking metrics, precision and recall per block of days since the first day."""
    first = df.agg(F.min(day).alias("_d0"))
    d = df.crossJoin(F.broadcast(first)).withColumn("block", F.floor((F.col(day) - F.col("_d0")) / block_days).cast("int"))
    ranks = ranking_metrics(d, score, ["block"])
    points = confusion(d, F.col(score) >= threshold, ["block"]).select("block", "precision", "recall")
    days = d.groupBy("block").agg(F.min(day).alias("first_day"))
    return (ranks.join(points, "block").join(days, "block")
            .select("block", "first_day", F.col("n").alias("n_txn"), F.col("base_rate").alias("fraud_rate"), "pr_auc",
                    "precision", "recall"))


def random_draws(boots: int, days: int, seed: int) -> np.ndarray:
    """For each resample the places of its days, by a generator."""
    return np.random.default_rng(seed).integers(0, days, (boots, days))


def hashed_draws(boots: int, days: int, seed: int) -> np.ndarray:
    """The same from a hash, so that any engine can repeat them."""
    return np.array([[int(hashlib.md5(f"{seed}|{b}|{j}".encode()).hexdigest()[:8], 16) % days for j in range(days)] for b in range(boots)]).reshape(boots, days)


def bootstrap_ranking(df: DataFrame, score: str, boots: int = 150, seed: int = 0, day: str = "day",
                      label: str = LABEL, drawn: Callable[[int, int, int], np.ndarray] = random_draws) -> DataFrame:
    """Average precision of each day-block resample.

    A resample is a multiplicity per day, so no row is copied: the (score, day) counts are sorted once, and the running totals of all
    resamples are arrays that go along.
    """
    days = sorted(r[0] for r in df.select(day).distinct().collect())  # one number per day
    draws = drawn(boots, len(days), seed) if days else np.zeros((boots, 0), int)
    times = {d: row for d, row in zip(days, np.array([np.bincount(x, minlength=len(days)) for x in draws]).T)}
    shared = df.sparkSession.sparkContext.broadcast(times)
    counts = df.groupBy(F.col(score).cast("double").alias("s"), F.col(day).cast("long").alias("d")).agg(
        F.count("*").alias("n"), F.sum(label).cast("bigint").alias("pos"))
    ranged = range_partitioned(counts, [F.col("s").desc()])  # sorted ranges, best scores first; a score's rows are in one range

    def weighted(pdf: pd.DataFrame, scores: int = 10_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows and positives of each score, best first, in every resample; ``scores`` of them at a time."""
        pdf = pdf.sort_values("s", ascending=False, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(pdf["s"].to_numpy()) != 0])
        for k in range(0, len(first), scores):
            a, b = first[k], first[k + scores] if k + scores < len(first) else len(pdf)
            w = np.stack([shared.value[d] for d in pdf["d"].iloc[a:b]]).astype(float)
            at = first[k:k + scores] - a
            yield tuple(np.add.reduceat(w * pdf[c].to_numpy()[a:b, None], at) for c in ("n", "pos"))

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        n, pos = (sum(x) for x in zip(*[(n.sum(0), pos.sum(0)) for n, pos in weighted(pdf)]))
        return pd.DataFrame({"part": [int(pdf["_part"].iloc[0])], "n": [n], "pos": [pos]})

    sums = ranged.groupBy("_part").applyInPandas(total, "part int, n array<double>, pos array<double>").toPandas().sort_values("part")
    n, pos = (np.array(sums[c].tolist()).reshape(len(sums), boots) for c in ("n", "pos"))  # ranges x resamples
    start = {p: (x, y) for p, x, y in zip(sums["part"], np.cumsum(n, 0) - n, np.cumsum(pos, 0) - pos)}
    before = df.sparkSession.sparkContext.broadcast(start)

    def gains(pdf: pd.DataFrame) -> pd.DataFrame:
        alerts, tp = (x.copy() for x in before.value[int(pdf["_part"].iloc[0])])
        gain, caught = np.zeros(len(tp)), np.zeros(len(tp))
        for n, pos in weighted(pdf):
            upto = tp + np.cumsum(pos, 0)
            gain += (pos * upto / np.maximum(alerts + np.cumsum(n, 0), 1)).sum(0)
            alerts, tp, caught = alerts + n.sum(0), upto[-1], caught + pos.sum(0)
        return pd.DataFrame({"boot": np.arange(len(tp)), "gain": gain, "caught": caught})

    parts = ranged.groupBy("_part").applyInPandas(gains, "boot int, gain double, caught double")
    return parts.groupBy("boot").agg((F.sum("gain") / F.sum("caught")).alias("pr_auc"), F.sum("caught").alias("_p")).where("_p > 0").drop("_p")


def bootstrap_interval(df: DataFrame, score: str, boots: int = 150, seed: int = 0) -> DataFrame:
    """95 % interval of average precision; at most ``boots`` values reach the last step."""
    return bootstrap_ranking(df, score, boots, seed, drawn=hashed_draws).agg(
        F.percentile("pr_auc", F.lit(0.025)).alias("ci_low"), F.percentile("pr_auc", F.lit(0.975)).alias("ci_high"),
        F.count("*").alias("n_boot"))


# ----------------------------------------------------------------------------------------- calibration
def _rank_bins(df: DataFrame, p: str, bins: int, row_id: str) -> DataFrame:
    """Equal-size bins of the rank, ties in id order: ``bin``, ``p``, ``n`` rows and ``pos`` positives per value and bin.

    A value whose rows all fall into one bin is counted as a whole; only the rows of values that reach over a limit are ranked.
    """
    slim = df.select(F.col(row_id).alias("_id"), F.col(p).alias("score"), F.col(LABEL).alias("_y"))
    total = df.agg(F.count("*").alias("_total"))

    def bin_of(rank: Column) -> Column:
        cut = F.ceil((rank - 1) * F.lit(bins) / F.greatest(F.col("_total") - 1, F.lit(1))) - 1
        return F.greatest(cut, F.lit(0)).cast("int")

    table = running_totals(score_table(slim, "score", label="_y"), "score", {"_upto": "n"}, descending=False)
    table = table.crossJoin(F.broadcast(total))
    table = table.withColumns({"bin": bin_of(F.col("_upto") - F.col("n") + 1), "_last": bin_of(F.col("_upto"))})
    whole = table.where("bin = _last").select("bin", F.col("score").alias("p"), "n", "pos")
    over = materialize(table.where("bin < _last").select(F.col("score").alias("_s"), (F.col("_upto") - F.col("n")).alias("_before"), "_total"),
                       "split-values")  # at most one value per limit
    rows = slim.join(F.broadcast(over), F.col("score").eqNullSafe(F.col("_s"))).select("_id", "score", "_y", "_before", "_total")
    ranked = global_row_number(rows, ["_id"], ["score"]).withColumn("bin", bin_of(F.col("_before") + F.col("rn")))
    parts = ranked.groupBy("bin", F.col("score").alias("p")).agg(F.count("*").alias("n"), F.sum("_y").cast("bigint").alias("pos"))
    return whole.unionByName(parts)


def calibration_table(df: DataFrame, p: str, bins: int = 8, row_id: str = "txn_id") -> DataFrame:
    return _rank_bins(df, p, bins, row_id).groupBy("bin").agg(
        (F.sum(F.col("p") * F.col("n")) / F.sum("n")).alias("mean_pred"), (F.sum("pos") / F.sum("n")).alias("observed"),
        F.sum("n").alias("n"))


def calibration_summary(df: DataFrame, p: str, bins: int = 10, row_id: str = "txn_id") -> DataFrame:
    """Brier score, that of the constant base rate, expected calibration error, mean prediction and observed rate."""
    value, ones = F.col("p"), F.col("pos")
    per_bin = _rank_bins(df, p, bins, row_id).groupBy("bin").agg(
        F.sum(F.pow(value - 1, 2) * ones + F.pow(value, 2) * (F.col("n") - ones)).alias("sq"),
        F.sum(value * F.col("n")).alias("sp"), F.sum(ones).cast("double").alias("sy"), F.sum("n").alias("n"))
    n, rate = F.sum("n"), F.sum("sy") / F.sum("n")
    return per_bin.agg((F.sum("sq") / n).alias("brier"), (rate * (1 - rate)).alias("brier_baseline_constant"),
                       (F.sum(F.abs(F.col("sy") - F.col("sp"))) / n).alias("ece"),
                       (F.sum("sp") / n).alias("mean_predicted"), rate.alias("observed_rate"))


# --------------------------------------------------------------------------------------------- counts
def band_counts(df: DataFrame, band: str = "band") -> DataFrame:
    return df.groupBy(band).agg(F.count("*").alias("n"))


def split_summary(df: DataFrame, split: str = "split", day: str = "day") -> DataFrame:
    return df.groupBy(split).agg(F.count("*").alias("n_rows"), F.avg(LABEL).alias("fraud_rate"),
                                 F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def recall_by_pattern(scored: DataFrame, truth: DataFrame, score: str, threshold: float) -> DataFrame:
    """Diagnostics only: recall and mean score per true fraud pattern (joined after scoring)."""
    joined = scored.join(truth, "txn_id", "left").where("is_fraud_true = 1")
    return joined.groupBy("true_pattern").agg(
        F.count("*").alias("n"), F.avg(F.when(F.col(score) >= threshold, 1.0).otherwise(0.0)).alias("recall"),
        F.avg(score).alias("mean_score"))


def undiscovered_share(scored: DataFrame, truth: DataFrame, score: str, threshold: float) -> DataFrame:
    """Share of false alerts that are fraud the label process never found."""
    fps = scored.where((F.col(score) >= threshold) & (F.col(LABEL) == 0)).join(truth, "txn_id", "left")
    return fps.agg(F.coalesce(F.avg(F.when(F.col("is_fraud_true") == 1, 1.0).otherwise(0.0)), F.lit(0.0))
                   .alias("undiscovered_share"))
