"""Where alerts go wrong: breakdowns over several dimensions in one pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.columns import amount_bucket, flag, history_bucket, ratio
from ledgerlens.operators.evaluation import LABEL


MISSING = "missing"


def default_dimensions() -> dict[str, Column]:
    return {"segment": F.col("segment"), "channel": F.col("channel"), "category": F.col("category"),
            "amount_bucket": amount_bucket(F.col("amount")), "history": history_bucket(F.col("cust_prior_n"))}


def by_dimension(df: DataFrame, dims: Mapping[str, Column], aggs: Sequence[Column], keep: Sequence[str],
                 missing: str | None = None) -> DataFrame:
    """Grouping sets ((d1), (d2), ..): one scan and one shuffle of partial sums; columns dim, value, aggs.

    Rows without a value for a dimension count under ``missing``, or are left out of it.
    """
    names = list(dims)
    base = df.select(*keep, *[F.coalesce(dims[d].cast("string"), F.lit(missing)).alias(f"_d_{d}") for d in names])
    cols = [F.col(f"_d_{d}") for d in names]
    out = base.groupingSets([[c] for c in cols], *cols).agg(*aggs, F.grouping_id().alias("_gid"))
    n = len(names)
    dim = F.coalesce(*[F.when(F.col("_gid") == (2 ** n - 1) - 2 ** (n - 1 - i), F.lit(d)) for i, d in enumerate(names)])
    return (out.withColumn("dim", dim).withColumn("value", F.coalesce(*cols)).where(F.col("value").isNotNull())
            .drop("_gid", *[f"_d_{d}" for d in names]))


def false_positive_rates(df: DataFrame, alert: Column, dims: Mapping[str, Column] | None = None) -> DataFrame:
    """False-positive rate and share per dimension value; values without false positives show 0."""
    legit = df.withColumn("_fp", flag(alert)).where(F.col(LABEL) == 0)
    dims = dims or default_dimensions()
    total = legit.agg(F.greatest(F.sum("_fp"), F.lit(1)).alias("_all"))
    out = by_dimension(legit, dims, [F.count("*").alias("legit_txns"), F.sum("_fp").alias("false_positives")], ["_fp"])
    return out.crossJoin(F.broadcast(total)).select(
        "dim", "value", "legit_txns", "false_positives",
        (100 * F.col("false_positives") / F.col("legit_txns")).alias("fp_rate_pct"),
        (100 * F.col("false_positives") / F.col("_all")).alias("share_of_fps_pct"))


def _false_positives(df: DataFrame, alert: Column) -> DataFrame:
    return df.where((F.col(LABEL) == 0) & alert)


def false_positive_concentration(df: DataFrame, alert: Column) -> DataFrame:
    """How many customers receive false alerts and what share goes to those with three or more."""
    per_customer = _false_positives(df, alert).groupBy("customer_id").agg(F.count("*").alias("n"))
    heavy = F.coalesce(F.sum(F.when(F.col("n") >= 3, F.col("n")).otherwise(0)), F.lit(0))
    all_ = F.coalesce(F.sum("n"), F.lit(0))
    return per_customer.agg(all_.alias("n_false_positives"), F.count("*").alias("customers_with_fp"),
                            (100 * heavy / F.greatest(all_, F.lit(1))).alias("pct_fps_from_customers_with_3plus"))


def top_false_positive_customers(df: DataFrame, alert: Column, limit: int = 5) -> DataFrame:
    return (_false_positives(df, alert).groupBy("customer_id").agg(F.count("*").alias("false_positives"))
            .orderBy(F.desc("false_positives"), "customer_id").limit(limit))


def top_false_positive_rules(df: DataFrame, alert: Column, limit: int = 8) -> DataFrame:
    return (_false_positives(df, alert).select(F.explode("rule_hits").alias("rule")).groupBy("rule")
            .agg(F.count("*").alias("false_positives")).orderBy(F.desc("false_positives"), "rule").limit(limit))


def slice_report(df: DataFrame, alert: Column, dims: Mapping[str, Column] | None = None, min_fraud: int = 30,
                 min_legit: int = 500, recall_ratio: float = 0.7, fpr_ratio: float = 1.5) -> DataFrame:
    """Volume, recall, false-positive and alert rate per slice; flags slices far worse than overall.

    Rows outside all buckets of a dimension, or without its value, are a slice of their own. Slices with little support are reported but never flagged.
    """
    y, a = F.col(LABEL) == 1, F.coalesce(alert, F.lit(False))
    d = df.withColumns({"_y": flag(y), "_a": flag(a), "_tp": flag(y & a)})
    aggs = [F.count("*").alias("n"), F.sum("_y").alias("n_fraud"), F.sum("_a").alias("n_alerts"), F.sum("_tp").alias("_tp")]
    overall = d.agg(F.sum("_y").alias("_oy"), F.count("*").alias("_on"), F.sum("_a").alias("_oa"),
                    F.sum("_tp").alias("_otp")).select(
        (F.col("_otp") / F.greatest(F.col("_oy"), F.lit(1))).alias("_recall"),
        ((F.col("_oa") - F.col("_otp")) / F.greatest(F.col("_on") - F.col("_oy"), F.lit(1))).alias("_fpr"))
    out = by_dimension(d, dims or default_dimensions(), aggs, ["_y", "_a", "_tp"], MISSING).crossJoin(F.broadcast(overall))
    legit = F.col("n") - F.col("n_fraud")
    recall = F.when(F.col("n_fraud") > 0, F.col("_tp") / F.col("n_fraud"))
    fpr = F.when(legit > 0, (F.col("n_alerts") - F.col("_tp")) / legit)
    low = (F.col("n_fraud") >= min_fraud) & (F.col("_recall") > 0) & (recall < recall_ratio * F.col("_recall"))
    high = (legit >= min_legit) & (F.col("_fpr") > 0) & (fpr > fpr_ratio * F.col("_fpr"))
    flags = F.array_compact(F.array(F.when(low, F.lit("low_recall")), F.when(high, F.lit("high_false_positive_rate"))))
    return out.select("dim", "value", "n", "n_fraud", (F.col("n_fraud") / F.col("n")).alias("fraud_rate"),
                      recall.alias("recall"), fpr.alias("fpr"), (F.col("n_alerts") / F.col("n")).alias("alert_rate"),
                      flags.alias("flags"))


# ------------------------------------------------------------------------------------------ trend views
def daily_trend(df: DataFrame, alert: Column, day: str = "day", rows: int = 7) -> DataFrame:
    """Per day: rows, fraud, alerts and the fraud rate over the last seven days (missing before the seventh)."""
    daily = df.groupBy(day).agg(F.count("*").alias("n"), F.sum(LABEL).alias("fraud"), F.sum(flag(alert)).alias("alerts"))
    last = Window.orderBy(day).rowsBetween(-(rows - 1), 0)  # one row per day
    full = F.count("*").over(last) == rows
    return daily.withColumn("fraud_rate_7d", F.when(full, F.sum("fraud").over(last) / F.sum("n").over(last)))


def category_rates(df: DataFrame) -> DataFrame:
    return df.groupBy("category").agg(F.count("*").alias("n"), F.avg(LABEL).alias("fraud_rate")).orderBy(
        F.desc("fraud_rate"), "category")


def score_histogram(df: DataFrame, score: str, bins: int = 60) -> DataFrame:
    """Counts per score bin and label; 1.0 falls into the last bin."""
    bin_ = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(bin_.alias("bin"), LABEL).agg(F.count("*").alias("n"))


def pattern_distribution(scored: DataFrame, truth: DataFrame) -> DataFrame:
    """Diagnostics only: true pattern of fraud-labelled rows."""
    return (scored.where(F.col(LABEL) == 1).join(truth, "txn_id", "left").groupBy("true_pattern")
            .agg(F.count("*").alias("n")))


def suspicious_list(scored: DataFrame, alert: Column, score: str, channels: Sequence[str] | None = None,
                    categories: Sequence[str] | None = None, limit: int = 100) -> DataFrame:
    """The best-scored alerts of the chosen channels and categories."""
    out = scored.where(alert)
    if channels:
        out = out.where(F.col("channel").isin(*channels))
    if categories:
        out = out.where(F.col("category").isin(*categories))
    return out.orderBy(F.desc(score), "txn_id").limit(limit)
