"""The analytical query library over the transaction star, one function per query, and its runner."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.config import DAY, AnalyticsParams, Skew
from ledgerlens.functions.columns import flag, ieee_div
from ledgerlens.operators.features import customer_series
from ledgerlens.operators.ordering import global_row_number
from ledgerlens.operators.skew import before, running
from ledgerlens.session import materialize
from ledgerlens.sources.views import Star

HOUR = 3600


def _pct(part, whole, digits):
    return F.round(100.0 * part / whole, digits)


def transaction_frequency(s: Star, p: AnalyticsParams = AnalyticsParams()) -> DataFrame:
    """Customer-months by number of transactions in the month, with their share."""
    per_month = s.transactions.groupBy("customer_id", F.substring("txn_date", 1, 7).alias("month")).agg(
        F.count("*").alias("n_txn"))
    lows = [1, *[b + 1 for b in p.month_buckets]]
    names = [f"{lo}-{hi}" for lo, hi in zip(lows, p.month_buckets)] + [f"{lows[-1]}+"]
    bucket = F.lit(names[-1])
    for name, high in reversed(list(zip(names, p.month_buckets))):
        bucket = F.when(F.col("n_txn") <= high, name).otherwise(bucket)
    grouped = per_month.groupBy(bucket.alias("txns_per_month_bucket")).agg(
        F.count("*").alias("customer_months"), F.min("n_txn").alias("_low"))
    everyone = Window.partitionBy()  # five rows at most
    return (grouped.withColumn("pct_of_customer_months",
                               _pct(F.col("customer_months"), F.sum("customer_months").over(everyone), 2))
            .orderBy("_low").drop("_low"))


def daily_volume(transactions: DataFrame, trailing: int = 7) -> DataFrame:
    daily = transactions.groupBy("txn_date").agg(
        F.count("*").alias("n_txn"), F.sum("amount").alias("total_amount"), F.sum("is_fraud").alias("n_fraud"))
    last = Window.orderBy("txn_date").rowsBetween(-(trailing - 1), 0)  # one row per day
    return daily.select("txn_date", "n_txn", "total_amount", "n_fraud",
                        (F.col("n_fraud") / F.col("n_txn")).alias("fraud_rate"),
                        F.avg("n_txn").over(last).alias("n_txn_7d_avg")).orderBy("txn_date")


def spending_patterns(transactions: DataFrame, merchants: DataFrame) -> DataFrame:
    """By category and channel. Totals per merchant come first, so a hot merchant never reaches the join as rows."""
    per_merchant = transactions.groupBy("merchant_id", "channel").agg(
        F.count("*").alias("n"), F.sum("amount").alias("total"), F.sum("is_fraud").alias("fraud"))
    joined = per_merchant.join(merchants.select("merchant_id", "category"), "merchant_id")
    g = joined.groupBy("category", "channel").agg(F.sum("n").alias("n_txn"), F.sum("total").alias("_total"),
                                                  F.sum("fraud").alias("_fraud"))
    return g.select("category", "channel", "n_txn", F.round(F.col("_total") / F.col("n_txn"), 2).alias("avg_amount"),
                    F.round("_total", 0).alias("total_amount"),
                    _pct(F.col("_total"), F.sum("_total").over(Window.partitionBy()), 2).alias("pct_of_spend"),
                    _pct(F.col("_fraud"), F.col("n_txn"), 3).alias("fraud_rate_pct")).orderBy(
        F.desc("total_amount"), "category", "channel")


def _quartile(df: DataFrame, order: list, out: str) -> DataFrame:
    """NTILE(4) along a global order, from distributed row numbers."""
    ranked = global_row_number(df, order, out="_rn")
    size = df.agg(F.count("*").alias("_size"))
    base, extra = F.floor(F.col("_size") / 4), F.col("_size") % 4
    longer = extra * (base + 1)  # rows held by the first tiles, which are one row longer
    tile = F.when(F.col("_rn") <= longer, F.floor((F.col("_rn") - 1) / (base + 1))).otherwise(
        extra + F.floor((F.col("_rn") - 1 - longer) / F.greatest(base, F.lit(1))))
    return ranked.crossJoin(F.broadcast(size)).withColumn(out, (tile + 1).cast("int")).drop("_rn", "_size")


def customer_segmentation(s: Star) -> DataFrame:
    """Recency, frequency and monetary quartiles, combined into segments."""
    per_customer = s.transactions.groupBy("customer_id").agg(
        F.count("*").alias("frequency"), F.sum("amount").alias("monetary"), F.max("ts_epoch").alias("_last"),
        F.sum("is_fraud").alias("n_fraud"))
    as_of = s.transactions.agg(F.max("ts_epoch").alias("_as_of"))
    c = per_customer.crossJoin(F.broadcast(as_of)).select(
        "customer_id", "frequency", F.round("monetary", 4).alias("monetary"),
        ((F.col("_as_of") - F.col("_last")) / DAY).alias("recency_days"), "n_fraud")
    c = materialize(c, "customers")  # three orders follow; the fact is aggregated once
    c = _quartile(c, ["frequency", "customer_id"], "f_q")
    c = _quartile(c, ["monetary", "customer_id"], "m_q")
    c = _quartile(c, [F.col("recency_days").desc(), F.col("customer_id")], "r_q")
    total = F.col("f_q") + F.col("m_q") + F.col("r_q")
    segment = (F.when(total >= 11, "champions").when(total >= 8, "loyal").when(F.col("r_q") <= 1, "dormant")
               .otherwise("occasional"))
    return c.groupBy(segment.alias("rfm_segment")).agg(
        F.count("*").alias("customers"), F.round(F.avg("frequency"), 1).alias("avg_txns"),
        F.round(F.avg("monetary"), 0).alias("avg_spend"), F.round(F.avg("recency_days"), 1).alias("avg_recency_days"),
        _pct(F.sum("n_fraud"), F.sum("frequency"), 3).alias("fraud_txn_rate_pct"),
        F.round(100.0 * F.avg(F.when(F.col("n_fraud") > 0, 1.0).otherwise(0.0)), 2).alias("pct_customers_with_fraud")
    ).orderBy(F.desc("customers"), "rfm_segment")


def _recent_behaviour(s: Star, p: AnalyticsParams, skew: Skew) -> DataFrame:
    """Each transaction with its customer's earlier count and mean (ties in id order) and its prior-hour count."""
    columns = ["txn_id", "customer_id", "ts", "ts_epoch", "amount", "channel", "is_fraud"]
    rows, keys = customer_series(s.transactions, columns, HOUR, skew, {"_amt": F.col("amount")})
    earlier = Window.partitionBy(*keys).orderBy("ts_epoch", "txn_id").rowsBetween(Window.unboundedPreceding, -1)
    w = rows.withColumns({"prior_n": running(F.col("_n"), earlier), "_prior_amt": running(F.col("_amt"), earlier),
                          "_past": running(F.col("_n"), before(keys)),
                          "_older": running(F.col("_n"), before(keys, HOUR + 1))}).where("_own")
    w = w.withColumns({"prior_mean": F.when(F.col("prior_n") > 0, F.col("_prior_amt") / F.col("prior_n")),
                       "prior_1h": F.col("_past") - F.col("_older")})
    spike = F.coalesce(F.col("amount") > p.spike_ratio * F.col("prior_mean"), F.lit(False))
    return w.withColumns({"_spike": spike, "_burst": F.col("prior_1h") >= p.burst_count})


def unusual_behaviour(s: Star, p: AnalyticsParams = AnalyticsParams(), skew: Skew = Skew()) -> DataFrame:
    w = _recent_behaviour(s, p, skew)
    ratio = ieee_div(F.col("amount"), F.col("prior_mean"))  # the first amounts of a customer may all be zero
    kind = (F.when(F.col("_spike") & F.col("_burst"), "spike+burst").when(F.col("_spike"), "amount_spike")
            .otherwise("velocity_burst"))
    return (w.where((F.col("_spike") & (F.col("prior_n") >= p.spike_min_history)) | F.col("_burst"))
            .orderBy(F.desc_nulls_last(F.round(ratio, 9)), "txn_id").limit(p.limit)
            .select("txn_id", "customer_id", "ts", F.round("amount", 2).alias("amount"), "channel",
                    F.round("prior_mean", 2).alias("prior_mean"), F.round(ratio, 1).alias("amount_vs_mean"), "prior_1h",
                    kind.alias("flag"), "is_fraud"))


def unusual_behaviour_summary(s: Star, p: AnalyticsParams = AnalyticsParams(), skew: Skew = Skew()) -> DataFrame:
    w = _recent_behaviour(s, p, skew)
    return (w.groupBy(flag(F.col("_spike") & (F.col("prior_n") >= p.spike_min_history)).alias("amount_spike"),
                      flag(F.col("_burst")).alias("velocity_burst"))
            .agg(F.count("*").alias("n_txn"), F.sum("is_fraud").alias("n_fraud"),
                 F.round(100.0 * F.avg("is_fraud"), 2).alias("fraud_rate_pct"))
            .orderBy("amount_spike", "velocity_burst"))


def merchant_risk(transactions: DataFrame, merchants: DataFrame, p: AnalyticsParams = AnalyticsParams()) -> DataFrame:
    """Fraud rate per merchant, shrunk towards the portfolio rate so that small merchants do not lead the ranking."""
    fraud_amount = F.sum(F.when(F.col("is_fraud") == 1, F.col("amount")).otherwise(0.0))
    per = transactions.groupBy("merchant_id").agg(F.count("*").alias("n_txn"), F.sum("is_fraud").alias("n_fraud"),
                                                  fraud_amount.alias("fraud_amount"))
    prior = transactions.agg((F.sum("is_fraud") / F.count("*")).alias("_prior"))
    smoothed = (F.col("n_fraud") + p.k * F.col("_prior")) / (F.col("n_txn") + p.k)
    scored = (per.where(F.col("n_txn") >= p.min_txn).join(merchants, "merchant_id").crossJoin(F.broadcast(prior))
              .withColumn("_rate", F.round(smoothed, 12)))
    # The list ends at the limit, so ranking its rows alone gives the same RANK as ranking every merchant.
    top = scored.orderBy(F.desc("_rate"), "merchant_id").limit(p.limit)
    return top.select(
        "merchant_id", "name", "category", "is_online", "n_txn", "n_fraud",
        _pct(F.col("n_fraud"), F.col("n_txn"), 2).alias("raw_fraud_rate_pct"),
        F.round(100.0 * F.col("_rate"), 2).alias("smoothed_fraud_rate_pct"),
        F.round("fraud_amount", 0).alias("fraud_amount"),
        F.rank().over(Window.orderBy(F.desc("_rate"))).alias("risk_rank")).orderBy("risk_rank", "merchant_id")


def category_risk(transactions: DataFrame, merchants: DataFrame, p: AnalyticsParams = AnalyticsParams()) -> DataFrame:
    per = transactions.groupBy("merchant_id").agg(
        F.count("*").alias("n"), F.sum("is_fraud").alias("f"),
        F.sum(F.when(F.col("is_fraud") == 1, F.col("amount")).otherwise(0.0)).alias("a"))
    g = per.join(merchants.select("merchant_id", "category", "is_online"), "merchant_id").groupBy("category", "is_online")
    return (g.agg(F.sum("n").alias("n_txn"), F.sum("f").alias("n_fraud"), F.round(F.sum("a"), 0).alias("fraud_amount"))
            .where(F.col("n_txn") >= p.category_min_txn)
            .select("category", "is_online", "n_txn", "n_fraud",
                    _pct(F.col("n_fraud"), F.col("n_txn"), 3).alias("fraud_rate_pct"), "fraud_amount")
            .orderBy(F.desc("fraud_rate_pct"), "category", "is_online"))


def hourly_lift(s: Star) -> DataFrame:
    per_hour = s.transactions.groupBy("hour_local").agg(F.count("*").alias("n_txn"), F.sum("is_fraud").alias("n_fraud"))
    everything = Window.partitionBy()  # 24 rows
    base = F.sum("n_fraud").over(everything) / F.sum("n_txn").over(everything)
    rate = F.col("n_fraud") / F.col("n_txn")
    return per_hour.select("hour_local", "n_txn", "n_fraud", F.round(100.0 * rate, 3).alias("fraud_rate_pct"),
                           F.round(F.when(base > 0, rate / base), 2).alias("lift_vs_portfolio")).orderBy("hour_local")


def daily_anomalies(transactions: DataFrame, p: AnalyticsParams = AnalyticsParams()) -> DataFrame:
    """Days whose volume is far from the mean of the preceding days."""
    daily = transactions.groupBy("txn_date").agg(F.count("*").alias("n_txn"), F.sum("is_fraud").alias("n_fraud"))
    base = Window.orderBy("txn_date").rowsBetween(-p.baseline_days, -1)  # one row per day
    d = daily.withColumns({"_m": F.count("*").over(base), "_mu": F.avg("n_txn").over(base), "_sd": F.stddev_pop("n_txn").over(base)})
    z = F.when(F.col("_sd") > 0, (F.col("n_txn") - F.col("_mu")) / F.col("_sd"))
    return (d.withColumn("_z", z).where((F.col("_m") >= p.baseline_min_days) & (F.abs("_z") > p.z_limit))
            .orderBy(F.desc(F.abs("_z")), "txn_date")
            .select("txn_date", "n_txn", "n_fraud", F.round("_mu", 1).alias("baseline_mean"),
                    F.round("_z", 2).alias("z_score")))


def velocity_peaks(s: Star, p: AnalyticsParams = AnalyticsParams(), skew: Skew = Skew()) -> DataFrame:
    """Customers with the most transactions inside one hour (the row itself and its ties included)."""
    rows, keys = customer_series(s.transactions, ["customer_id", "ts_epoch", "is_fraud"], HOUR, skew)
    upto = Window.partitionBy(*keys).orderBy("ts_epoch").rangeBetween(Window.unboundedPreceding, 0)
    v = rows.withColumns({"_upto": running(F.col("_n"), upto), "_older": running(F.col("_n"), before(keys, HOUR + 1))})
    return (v.where("_own").groupBy("customer_id")
            .agg(F.max(F.col("_upto") - F.col("_older")).alias("peak_txns_1h"), F.sum("is_fraud").alias("fraud_txns"),
                 F.count("*").alias("txns"))
            .orderBy(F.desc("peak_txns_1h"), "customer_id").limit(p.limit))


LIBRARY: dict[str, Callable[[Star, AnalyticsParams], DataFrame]] = {
    "01_transaction_frequency": transaction_frequency,
    "02_daily_volume": lambda s, p: daily_volume(s.transactions),
    "03_spending_patterns": lambda s, p: spending_patterns(s.transactions, s.merchants),
    "04_customer_segmentation": lambda s, p: customer_segmentation(s),
    "05_unusual_behaviour": unusual_behaviour,
    "06_unusual_behaviour_summary": unusual_behaviour_summary,
    "07_merchant_risk": lambda s, p: merchant_risk(s.transactions, s.merchants, p),
    "08_category_risk": lambda s, p: category_risk(s.transactions, s.merchants, p),
    "09_hourly_lift": lambda s, p: hourly_lift(s),
    "10_daily_anomalies": lambda s, p: daily_anomalies(s.transactions, p),
    "11_velocity_peaks": velocity_peaks,
}


def run_library(s: Star, p: AnalyticsParams = AnalyticsParams(), out_dir: str | None = None) -> dict[str, DataFrame]:
    """Every query in name order; with ``out_dir`` each result is also written as CSV with a header."""
    from ledgerlens.sources.writers import write_csv

    results = {name: LIBRARY[name](s, p) for name in sorted(LIBRARY)}
    if out_dir:
        for name, df in results.items():
            write_csv(df, f"{out_dir}/{name}")
    return results


# ------------------------------------------------------------------------------- parameterised SQL text
def register_views(s: Star) -> None:
    for name, df in {"transactions": s.transactions, "customers": s.customers, "accounts": s.accounts,
                     "merchants": s.merchants, "locations": s.locations}.items():
        df.createOrReplaceTempView(name)


def run_sql(spark: SparkSession, text: str, params: dict | None = None) -> DataFrame:
    """Runs SQL text with ``:name`` parameters; only the parameters the text mentions (outside comments) are bound."""
    code = re.sub(r"('(?:[^']|'')*')|--[^\n]*", lambda m: m[1] or "", text)  # a literal may hold two dashes
    used = {k: v for k, v in (params or {}).items() if re.search(rf":{k}\b", code)}
    return spark.sql(code, args=used)


def run_sql_file(spark: SparkSession, path: str, params: dict | None = None) -> DataFrame:
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())  # one statement file
    return run_sql(spark, text, params)


def default_bindings(p: AnalyticsParams = AnalyticsParams()) -> dict:
    return {k: v for k, v in asdict(p).items() if k in ("limit", "k", "min_txn")}
