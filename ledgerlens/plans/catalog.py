"""Registered queries: name -> Spark plan, with the DuckDB statement that must agree where one exists."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import asdict
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens import __version__
from ledgerlens.config import DAY, THIRTY_DAYS, Skew
from ledgerlens.functions import columns as col
from ledgerlens.operators import anomaly, breakdown, dataset, drift, evaluation, features, quality, rules
from ledgerlens.operators.skew import before, find_hot_keys, with_history, attach_slab, partition_keys
from ledgerlens.plans import analytics, oracle
from ledgerlens.schema import FEATURES
from ledgerlens.session import materialize, tune, workspace
from ledgerlens.sources import readers, views, writers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SETTINGS = THIRTY_DAYS
_CONFIG = json.dumps(asdict(SETTINGS), sort_keys=True).replace("'", "''")
DELAY = SETTINGS.split.label_delay_days
REVIEW, BLOCK = oracle.REVIEW, oracle.BLOCK


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: fn(tune(spark), sf_dir)
        if sql:
            ORACLES[name] = sql
        return fn
    return register


def alert():
    return F.col("score_rules") >= REVIEW


_tables: dict[tuple[str, str, str], DataFrame] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """One stored copy per application of the tables many queries start from (the feature table above all)."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _tables:
        _tables[key] = build()
    return _tables[key]


def star(spark: SparkSession, sf_dir: str) -> views.Star:
    return views.star(spark, sf_dir)


def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "dataset", lambda: dataset.make_dataset(star(spark, sf_dir), SETTINGS))


def train_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_table(spark, sf_dir).where(F.col("split") == "train")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation and test rows with rule and robust-z scores."""
    def build():
        params = anomaly.robust_z_params(anomaly.fit_robust_z(train_rows(spark, sf_dir)))
        out = dataset.rule_scored(feature_table(spark, sf_dir), REVIEW, BLOCK)
        return materialize(out.withColumn("score_z", F.round(anomaly.robust_z_score(params), 9)), "scored")
    return _once(spark, sf_dir, "scored", build)


def test_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).where(F.col("split") == "test")


def valid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).where(F.col("split") == "valid")


def rounded(df: DataFrame, columns: Sequence[str], digits: int | None = None) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits or oracle.digits_of(c)) for c in columns})


# ================================================================================== sources and sinks
@query("src1_read_transactions", oracle.tables("SELECT * EXCLUDE (ts) FROM txn"))
def _(spark, sf):
    return star(spark, sf).transactions.drop("ts")


@query("src2_load_reference", oracle.tables("""
SELECT 'customers' AS table_name, count(*) AS n_rows, CAST(sum(customer_id) AS BIGINT) AS key_sum FROM cust
UNION ALL SELECT 'accounts', count(*), CAST(sum(account_id) AS BIGINT) FROM acct
UNION ALL SELECT 'merchants', count(*), CAST(sum(merchant_id) AS BIGINT) FROM merch
UNION ALL SELECT 'locations', count(*), CAST(sum(location_id) AS BIGINT) FROM loc"""))
def _(spark, sf):
    s = star(spark, sf)
    keys = {"customers": "customer_id", "accounts": "account_id", "merchants": "merchant_id", "locations": "location_id"}
    return reduce(DataFrame.unionByName, [
        getattr(s, t).agg(F.count("*").alias("n_rows"), F.sum(k).alias("key_sum"))
        .select(F.lit(t).alias("table_name"), "n_rows", "key_sum") for t, k in keys.items()])


@query("src3_truth_scan", oracle.tables("SELECT txn_id, true_pattern, is_fraud_true FROM truth"))
def _(spark, sf):
    return views.truth(spark, sf)


_SCORED_SQL = """SELECT txn_id, split, day, channel, category, amount, is_fraud, round(score_rules, 6) AS score_rules,
round(score_z, 5) AS score_robust_z, array_to_string(rule_hits, '|') AS rule_hits, true AS complete FROM sc"""


@query("snk4_scored_parquet", oracle.scored(_SCORED_SQL))
def _(spark, sf):
    """Writes the scored table with all model columns, partitioned by split, and reads it back."""
    path = f"{workspace(spark)}/scored-sink"
    t = _trained(spark, sf)
    valid = t.scored.where(F.col("split") == "valid").withColumns({"reasons": F.lit(""), "top_reason": F.lit("")})
    writers.write_scored(valid.unionByName(_explained(spark, sf)), path)
    share = [F.col(c).between(0, 1) for c in ("p_model", "score_iforest", "score_logreg")]
    band = col.band(F.col("p_model"), t.model.review, t.model.block)
    reasons = (F.col("reasons") != "") == ((F.col("split") == "test") & (F.col("band") != "allow"))
    return readers.read_scored(spark, path).select(
        "txn_id", "split", "day", "channel", "category", "amount", "is_fraud", F.round("score_rules", 6).alias("score_rules"),
        F.round("score_robust_z", 5).alias("score_robust_z"), "rule_hits",
        (reduce(lambda a, b: a & b, share) & (F.col("band") == band) & reasons).alias("complete"))


@query("src5_csv_report", oracle.tables("""SELECT txn_date, count(*) AS n_txn, CAST(sum(is_fraud) AS BIGINT) AS n_fraud
FROM txn GROUP BY txn_date"""))
def _(spark, sf):
    """Writes the daily report as CSV with a header and reads it with its declared schema."""
    path = f"{workspace(spark)}/daily-csv"
    writers.write_csv(analytics.daily_volume(star(spark, sf).transactions).select("txn_date", "n_txn", "n_fraud"), path)
    return readers.read_csv(spark, path, "txn_date STRING, n_txn BIGINT, n_fraud BIGINT")


@query("snk5_json_metrics", oracle.scored("SELECT band, count(*) AS n FROM te GROUP BY band"))
def _(spark, sf):
    path = f"{workspace(spark)}/bands-json"
    writers.write_json(evaluation.band_counts(test_rows(spark, sf)), path)
    return readers.read_json(spark, path, "band STRING, n BIGINT")


@query("snk1_partitioned_fact", oracle.tables("""SELECT txn_date, count(*) AS n_txn, round(sum(amount), 4) AS amount FROM txn
WHERE txn_date >= '2024-01-10' GROUP BY txn_date"""))
def _(spark, sf):
    """Writes the fact by day; the read touches only the partitions of the requested dates."""
    path = f"{workspace(spark)}/fact"
    writers.write_transactions(star(spark, sf).transactions, path)
    t = spark.read.parquet(path).withColumn("txn_date", F.col("txn_date").cast("string"))
    return t.where(F.col("txn_date") >= "2024-01-10").groupBy("txn_date").agg(
        F.count("*").alias("n_txn"), F.round(F.sum("amount"), 4).alias("amount"))


# ================================================================================== analytical queries
_P = SETTINGS.analytics


@query("q01_transaction_frequency", oracle.tables("""
, m AS (SELECT customer_id, substr(txn_date, 1, 7) AS month, count(*) AS n FROM txn GROUP BY ALL)
SELECT CASE WHEN n <= 55 THEN '1-55' WHEN n <= 65 THEN '56-65' WHEN n <= 75 THEN '66-75' WHEN n <= 85 THEN '76-85' ELSE '86+' END
 AS txns_per_month_bucket, count(*) AS customer_months,
 round(100.0 * count(*) / (SELECT count(*) FROM m), 2) AS pct_of_customer_months FROM m GROUP BY 1"""))
def _(spark, sf):
    return analytics.transaction_frequency(star(spark, sf), _P)


def _daily_sql(source: str) -> str:
    return oracle.tables(f"""
, dv AS (SELECT txn_date, count(*) AS n_txn, round(sum(amount), 2) AS total_amount, CAST(sum(is_fraud) AS BIGINT) AS n_fraud
  FROM {source} GROUP BY txn_date)
SELECT txn_date, n_txn, total_amount, n_fraud, round(n_fraud / n_txn, 6) AS fraud_rate,
 round(avg(n_txn) OVER (ORDER BY txn_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS n_txn_7d_avg FROM dv""")


def _daily(df: DataFrame) -> DataFrame:
    return rounded(rounded(analytics.daily_volume(df), ["total_amount"], 2), ["fraud_rate", "n_txn_7d_avg"], 6)


@query("q02_daily_volume", _daily_sql("txn"))
def _(spark, sf):
    return _daily(star(spark, sf).transactions)


@query("q02_daily_volume_sales", _daily_sql("sales"))
def _(spark, sf):
    return _daily(views.sales_transactions(spark, sf))


def _spend_sql(source: str) -> str:
    return oracle.tables(f"""
SELECT category, channel, count(*) AS n_txn, round(avg(amount), 2) AS avg_amount, round(sum(amount), 0) AS total_amount,
 round(100.0 * sum(amount) / sum(sum(amount)) OVER (), 2) AS pct_of_spend, round(100.0 * sum(is_fraud) / count(*), 3) AS fraud_rate_pct
FROM {source} t JOIN merch m ON t.merchant_id = m.merchant_id GROUP BY category, channel""")


@query("q03_spending_patterns", _spend_sql("txn"))
def _(spark, sf):
    s = star(spark, sf)
    return analytics.spending_patterns(s.transactions, s.merchants)


@query("q03_spending_patterns_sales", _spend_sql("sales"))
def _(spark, sf):
    return analytics.spending_patterns(views.sales_transactions(spark, sf), views.merchants(spark, sf))


@query("q04_customer_segmentation", oracle.tables("""
, c AS (SELECT customer_id, count(*) AS frequency, round(sum(amount), 4) AS monetary, CAST(sum(is_fraud) AS BIGINT) AS n_fraud,
  ((SELECT max(ts_epoch) FROM txn) - max(ts_epoch)) / 86400.0 AS recency_days FROM txn GROUP BY customer_id),
q AS (SELECT *, ntile(4) OVER (ORDER BY frequency, customer_id) AS f_q, ntile(4) OVER (ORDER BY monetary, customer_id) AS m_q,
  ntile(4) OVER (ORDER BY recency_days DESC, customer_id) AS r_q FROM c)
SELECT CASE WHEN f_q+m_q+r_q >= 11 THEN 'champions' WHEN f_q+m_q+r_q >= 8 THEN 'loyal' WHEN r_q <= 1 THEN 'dormant' ELSE 'occasional' END
 AS rfm_segment, count(*) AS customers, round(avg(frequency), 1) AS avg_txns, round(avg(monetary), 0) AS avg_spend,
 round(avg(recency_days), 1) AS avg_recency_days, round(100.0 * sum(n_fraud) / sum(frequency), 3) AS fraud_txn_rate_pct,
 round(100.0 * avg(CAST(n_fraud > 0 AS INT)), 2) AS pct_customers_with_fraud FROM q GROUP BY 1"""))
def _(spark, sf):
    return analytics.customer_segmentation(star(spark, sf))


_RECENT = """
, w AS (SELECT *, count(*) OVER r AS prior_n, avg(amount) OVER r AS prior_mean,
  count(*) OVER (PARTITION BY customer_id ORDER BY ts_epoch RANGE BETWEEN 3600 PRECEDING AND 1 PRECEDING) AS prior_1h FROM txn
  WINDOW r AS (PARTITION BY customer_id ORDER BY ts_epoch, txn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query("q05_unusual_behaviour", oracle.tables(_RECENT + """
SELECT txn_id, customer_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(amount, 2) AS amount, channel, round(prior_mean, 2) AS prior_mean,
 round(amount / prior_mean, 1) AS amount_vs_mean, prior_1h, CASE WHEN amount > 5*prior_mean AND prior_1h >= 1 THEN 'spike+burst'
 WHEN amount > 5*prior_mean THEN 'amount_spike' ELSE 'velocity_burst' END AS flag, is_fraud FROM w
WHERE (prior_n >= 10 AND amount > 5*prior_mean) OR prior_1h >= 1
ORDER BY round(amount / prior_mean, 9) DESC NULLS LAST, txn_id LIMIT 25"""))
def _(spark, sf):
    return analytics.unusual_behaviour(star(spark, sf), _P).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


_Q06 = oracle.tables(_RECENT + """
SELECT CASE WHEN prior_n >= 10 AND amount > 5*prior_mean THEN 1 ELSE 0 END AS amount_spike, CASE WHEN prior_1h >= 1 THEN 1 ELSE 0 END
 AS velocity_burst, count(*) AS n_txn, CAST(sum(is_fraud) AS BIGINT) AS n_fraud, round(100.0 * sum(is_fraud) / count(*), 2) AS fraud_rate_pct
FROM w GROUP BY 1, 2""")


@query("q06_unusual_behaviour_summary", _Q06)
def _(spark, sf):
    return analytics.unusual_behaviour_summary(star(spark, sf), _P)


@query("q06_unusual_behaviour_hot_customers", _Q06)
def _(spark, sf):
    """The same query with a row limit that cuts the busier customers into time slabs."""
    return analytics.unusual_behaviour_summary(star(spark, sf), _P, Skew(rows_per_task=60))


def _merchant_sql(source: str) -> str:
    return oracle.tables(f"""
, per AS (SELECT merchant_id, count(*) AS n_txn, CAST(sum(is_fraud) AS BIGINT) AS n_fraud,
  sum(CASE WHEN is_fraud = 1 THEN amount ELSE 0 END) AS fraud_amount FROM {source} GROUP BY merchant_id),
r AS (SELECT m.merchant_id, name, category, is_online, n_txn, n_fraud, fraud_amount,
  round((n_fraud + 200 * p) / (n_txn + 200), 12) AS rate
  FROM per JOIN merch m ON per.merchant_id = m.merchant_id, (SELECT sum(is_fraud) / count(*) AS p FROM {source}) WHERE n_txn >= 50)
SELECT merchant_id, name, category, is_online, n_txn, n_fraud, round(100.0 * n_fraud / n_txn, 2) AS raw_fraud_rate_pct,
 round(100.0 * rate, 2) AS smoothed_fraud_rate_pct, round(fraud_amount, 0) AS fraud_amount,
 CAST(rank() OVER (ORDER BY rate DESC) AS INT) AS risk_rank FROM r ORDER BY rate DESC, merchant_id LIMIT 25""")


@query("q07_merchant_risk", _merchant_sql("txn"))
def _(spark, sf):
    s = star(spark, sf)
    return analytics.merchant_risk(s.transactions, s.merchants, _P)


@query("q07_merchant_risk_sales", _merchant_sql("sales"))
def _(spark, sf):
    return analytics.merchant_risk(views.sales_transactions(spark, sf), views.merchants(spark, sf), _P)


def _category_sql(source: str) -> str:
    return oracle.tables(f"""
SELECT category, is_online, count(*) AS n_txn, CAST(sum(is_fraud) AS BIGINT) AS n_fraud,
 round(100.0 * sum(is_fraud) / count(*), 3) AS fraud_rate_pct, round(sum(CASE WHEN is_fraud = 1 THEN amount ELSE 0 END), 0) AS fraud_amount
FROM {source} t JOIN merch m ON t.merchant_id = m.merchant_id GROUP BY category, is_online HAVING count(*) >= 200""")


@query("q08_category_risk", _category_sql("txn"))
def _(spark, sf):
    s = star(spark, sf)
    return analytics.category_risk(s.transactions, s.merchants, _P)


@query("q08_category_risk_sales", _category_sql("sales"))
def _(spark, sf):
    return analytics.category_risk(views.sales_transactions(spark, sf), views.merchants(spark, sf), _P)


@query("q09_hourly_lift", oracle.tables("""
SELECT hour_local, count(*) AS n_txn, CAST(sum(is_fraud) AS BIGINT) AS n_fraud, round(100.0 * sum(is_fraud) / count(*), 3) AS fraud_rate_pct,
 round((sum(is_fraud) / count(*)) / (SELECT sum(is_fraud) / count(*) FROM txn), 2) AS lift_vs_portfolio FROM txn GROUP BY hour_local"""))
def _(spark, sf):
    return analytics.hourly_lift(star(spark, sf))


@query("q10_daily_anomalies", oracle.tables("""
, dd AS (SELECT txn_date, count(*) AS n_txn, CAST(sum(is_fraud) AS BIGINT) AS n_fraud FROM txn GROUP BY txn_date),
b AS (SELECT *, count(*) OVER w AS m, avg(n_txn) OVER w AS mu, avg(n_txn*n_txn) OVER w AS mu2 FROM dd
  WINDOW w AS (ORDER BY txn_date ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING))
SELECT txn_date, n_txn, n_fraud, round(mu, 1) AS baseline_mean, round((n_txn - mu) / sqrt(mu2 - mu*mu), 2) AS z_score FROM b
WHERE m >= 7 AND mu2 - mu*mu > 0 AND abs((n_txn - mu) / sqrt(greatest(mu2 - mu*mu, 1e-12))) > 1.5"""))
def _(spark, sf):
    return analytics.daily_anomalies(star(spark, sf).transactions, _P)


_Q11 = oracle.tables("""
, v AS (SELECT customer_id, is_fraud, count(*) OVER (PARTITION BY customer_id ORDER BY ts_epoch RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS n FROM txn)
SELECT customer_id, max(n) AS peak_txns_1h, CAST(sum(is_fraud) AS BIGINT) AS fraud_txns, count(*) AS txns FROM v GROUP BY customer_id
ORDER BY peak_txns_1h DESC, customer_id LIMIT 25""")


@query("q11_velocity_peaks", _Q11)
def _(spark, sf):
    return analytics.velocity_peaks(star(spark, sf), _P)


@query("q11_velocity_peaks_hot_customers", _Q11)
def _(spark, sf):
    return analytics.velocity_peaks(star(spark, sf), _P, Skew(rows_per_task=60))


@query("sqlr1_parameterised_sql", oracle.tables("""
SELECT m.category, count(*) AS n_txn, round((sum(is_fraud) + 200 * 0.05) / (count(*) + 200), 6) AS smoothed
FROM txn t JOIN merch m ON t.merchant_id = m.merchant_id GROUP BY m.category HAVING count(*) >= 50 ORDER BY n_txn DESC, m.category LIMIT 5"""))
def _(spark, sf):
    analytics.register_views(star(spark, sf))
    return analytics.run_sql(spark, """
        -- busiest categories; :unused in a comment is no parameter
        SELECT m.category, COUNT(*) AS n_txn, ROUND((SUM(t.is_fraud) + :k * CAST(0.05 AS DOUBLE)) / (COUNT(*) + :k), 6) AS smoothed
        FROM transactions t JOIN merchants m ON m.merchant_id = t.merchant_id
        GROUP BY m.category HAVING COUNT(*) >= :min_txn ORDER BY n_txn DESC, m.category LIMIT :limit""",
        {"limit": 5, "k": 200, "min_txn": 50, "spare": 1})


@query("sqlr2_run_library", " UNION ALL ".join(
    f"SELECT '{n}' AS query_name, count(*) AS n_rows FROM ({ORACLES['q' + n]})" for n in sorted(analytics.LIBRARY)))
def _(spark, sf):
    """Rows of each of the eleven results."""
    results = analytics.run_library(star(spark, sf), _P)
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("query_name"), "n_rows")
                                          for n, df in results.items()])


# ============================================================================ projections and filters
@query("prj1_time_enrichment", oracle.tables("SELECT txn_id, txn_date, ts_epoch, hour_local, dow_local FROM txn"))
def _(spark, sf):
    return star(spark, sf).transactions.select("txn_id", "txn_date", "ts_epoch", "hour_local", "dow_local")


@query("prj2_day_index", oracle.tables("""SELECT txn_id, CAST((ts_epoch - (SELECT min(ts_epoch)//86400*86400 FROM txn))//86400 AS INT)
 AS day FROM txn"""))
def _(spark, sf):
    return dataset.with_day(star(spark, sf).transactions.select("txn_id", "ts_epoch")).select("txn_id", "day")


@query("prj3_transaction_flags", oracle.tables("""SELECT txn_id, round(ln(1+amount), 6) AS log_amount,
 CASE WHEN channel='online' THEN 1 ELSE 0 END AS is_online, CASE WHEN channel='atm' THEN 1 ELSE 0 END AS is_atm,
 CASE WHEN hour_local<=5 THEN 1 ELSE 0 END AS is_night, CASE WHEN dow_local>=5 THEN 1 ELSE 0 END AS is_weekend,
 CAST(hour_local//4 AS BIGINT) AS hour_band FROM txn"""))
def _(spark, sf):
    t = star(spark, sf).transactions
    return t.select("txn_id", F.round(F.log1p("amount"), 6).alias("log_amount"),
                    col.flag(F.col("channel") == "online").alias("is_online"),
                    col.flag(F.col("channel") == "atm").alias("is_atm"),
                    col.flag(F.col("hour_local") <= 5).alias("is_night"),
                    col.flag(F.col("dow_local") >= 5).alias("is_weekend"),
                    F.floor(F.col("hour_local") / 4).alias("hour_band"))


@query("prj4_category_code", oracle.tables("""SELECT merchant_id, category, CAST(CASE WHEN merchant_id%14 < 13 THEN merchant_id%14 END AS DOUBLE)
 AS category_code FROM merch"""))
def _(spark, sf):
    return star(spark, sf).merchants.select("merchant_id", "category", col.category_code(F.col("category")).alias("category_code"))


@query("prj5_safe_division", """SELECT l_returnflag, count(*) AS n, count(CASE WHEN l_discount > 0 THEN 1 END) AS defined,
 round(sum(CASE WHEN l_discount > 0 THEN l_tax / l_discount END), 4) AS total FROM lineitem GROUP BY l_returnflag""")
def _(spark, sf):
    li = views._table(spark, sf, "lineitem")
    q = col.safe_div(F.col("l_tax"), F.col("l_discount"))
    return li.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count(q).alias("defined"),
                                          F.round(F.sum(q), 4).alias("total"))


@query("prj6_signed_log", "SELECT c_custkey, round(sign(c_acctbal) * ln(1 + abs(c_acctbal)), 6) AS signed_log FROM customer")
def _(spark, sf):
    return views._table(spark, sf, "customer").select(
        "c_custkey", F.round(col.signed_log(F.col("c_acctbal")), 6).alias("signed_log"))


@query("prj7_right_closed_buckets", oracle.tables(f"""SELECT amount_bucket, count(*) AS n FROM
 (SELECT {oracle.AMOUNT_BUCKET} AS amount_bucket FROM txn) GROUP BY 1"""))
def _(spark, sf):
    return star(spark, sf).transactions.groupBy(col.amount_bucket(F.col("amount")).alias("amount_bucket")).agg(
        F.count("*").alias("n"))


@query("prj8_decision_band", oracle.scored("SELECT txn_id, band FROM sc"))
def _(spark, sf):
    return scored(spark, sf).select("txn_id", "band")


@query("prj9_logit", """SELECT l_tax, l_discount, count(*) AS n, round(ln(p / (1 - p)), 6) AS logit FROM
 (SELECT l_tax, l_discount, greatest(1e-6, least(l_discount * 10, 1 - 1e-6)) AS p FROM lineitem) GROUP BY l_tax, l_discount, p""")
def _(spark, sf):
    li = views._table(spark, sf, "lineitem").groupBy("l_tax", "l_discount").agg(F.count("*").alias("n"))
    return li.withColumn("logit", F.round(col.logit(F.col("l_discount") * 10), 6))


@query("flt1_time_split", oracle.scored("SELECT split, count(*) AS n, min(day) AS first_day, max(day) AS last_day FROM ds WHERE split IS NOT NULL GROUP BY split"))
def _(spark, sf):
    d = dataset.with_day(star(spark, sf).transactions.select("ts_epoch"))
    d = d.withColumn("split", dataset.split_of(F.col("day"), SETTINGS.split)).where(F.col("split").isNotNull())
    return d.groupBy("split").agg(F.count("*").alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


@query("flt2_suspicious_list", oracle.scored("""SELECT txn_id, customer_id, category, channel, amount, round(score_rules, 6) AS score_rules
 FROM te WHERE alert AND channel IN ('online', 'atm') AND category IN ('travel', 'fuel', 'grocery') ORDER BY te.score_rules DESC, txn_id LIMIT 50"""))
def _(spark, sf):
    out = breakdown.suspicious_list(test_rows(spark, sf), alert(), "score_rules", ["online", "atm"],
                                    ["travel", "fuel", "grocery"], 50)
    return out.select("txn_id", "customer_id", "category", "channel", "amount", F.round("score_rules", 6).alias("score_rules"))


# ================================================================================================ joins
@query("jn1_enrichment", oracle.features("SELECT txn_id, category, m_online, lat, lon, country, segment, account_type FROM e"))
def _(spark, sf):
    s = star(spark, sf)
    return features.enrich(s.transactions.select(*features.FACT_COLUMNS), s).select(
        "txn_id", "category", "m_online", "lat", "lon", "country", "segment", "account_type")


@query("jn2_home_location", oracle.features("SELECT txn_id, home_location_id, home_lat, home_lon, home_country FROM e"))
def _(spark, sf):
    s = star(spark, sf)
    return features.enrich(s.transactions.select(*features.FACT_COLUMNS), s).select(
        "txn_id", "home_location_id", "home_lat", "home_lon", "home_country")


@query("jn3_attribute_lookup", oracle.features("SELECT category, segment, count(*) AS n FROM e GROUP BY category, segment"))
def _(spark, sf):
    s = star(spark, sf)
    return features.enrich(s.transactions.select(*features.FACT_COLUMNS), s).groupBy("category", "segment").agg(
        F.count("*").alias("n"))


@query("jn4_features_with_metadata", oracle.scored("SELECT txn_id, customer_id, day, category, segment, is_fraud, CAST(cust_prior_n AS DOUBLE) AS cust_prior_n FROM ds"))
def _(spark, sf):
    return feature_table(spark, sf).select("txn_id", "customer_id", "day", "category", "segment", "is_fraud", "cust_prior_n")


@query("jn5_truth_after_scoring", oracle.scored("SELECT te.txn_id, band, true_pattern, is_fraud_true FROM te LEFT JOIN truth USING (txn_id)"))
def _(spark, sf):
    return test_rows(spark, sf).join(views.truth(spark, sf), "txn_id", "left").select(
        "txn_id", "band", "true_pattern", "is_fraud_true")


@query("jn8_previous_row", """
WITH t AS (SELECT o_orderkey AS txn_id, o_custkey AS customer_id, CAST(epoch(o_orderdate) AS BIGINT) AS ts_epoch, o_totalprice AS amount FROM orders),
p AS (SELECT txn_id, max({'t': ts_epoch, 'i': txn_id, 'a': amount}) OVER (PARTITION BY customer_id ORDER BY ts_epoch
  RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM t)
SELECT txn_id, prev.i AS prev_txn_id, prev.t AS prev_ts_epoch, prev.a AS prev_amount FROM p""")
def _(spark, sf):
    """Orders have many same-day ties: the previous row is the largest id of the latest earlier day."""
    t = views.order_transactions(spark, sf)
    hot = find_hot_keys(t, "customer_id", SETTINGS.skew.rows_per_task, DAY)
    rows = attach_slab(t.withColumns({"_n": F.lit(1), "_prev": F.struct("ts_epoch", "txn_id", "amount")}), hot)
    keys = partition_keys("customer_id", hot)
    out = with_history(rows, hot, DAY, ["_n"], ["_prev"]).withColumn("_p", F.max("_prev").over(before(keys))).where("_own")
    return out.select("txn_id", F.col("_p.txn_id").alias("prev_txn_id"), F.col("_p.ts_epoch").alias("prev_ts_epoch"),
                      F.col("_p.amount").alias("prev_amount"))


_MATURED = """SELECT txn_id, CAST(count(is_fraud) OVER m AS BIGINT) AS labels, CAST(coalesce(sum(is_fraud) OVER m, 0) AS BIGINT) AS frauds FROM {src}
 WINDOW m AS (PARTITION BY merchant_id ORDER BY ts_epoch RANGE BETWEEN UNBOUNDED PRECEDING AND 172800 PRECEDING)"""


@query("jn9_matured_labels", oracle.tables(_MATURED.format(src="txn")))
def _(spark, sf):
    t = star(spark, sf).transactions
    hot = find_hot_keys(t, "merchant_id", SETTINGS.skew.rows_per_task, DELAY * DAY)
    rows = attach_slab(t.select("txn_id", "merchant_id", "ts_epoch", col.flag(F.col("is_fraud").isNotNull()).alias("_l"),
                                F.coalesce("is_fraud", F.lit(0)).alias("_f")), hot)
    w = before(partition_keys("merchant_id", hot), DELAY * DAY)
    out = with_history(rows, hot, DELAY * DAY, ["_l", "_f"])
    return out.withColumns({"labels": F.coalesce(F.sum("_l").over(w), F.lit(0)),
                            "frauds": F.coalesce(F.sum("_f").over(w), F.lit(0))}).where("_own").select("txn_id", "labels", "frauds")


_BATCH = "ts_epoch >= (SELECT max(ts_epoch) - 3600 FROM txn)"


@query("jn10_relevant_history", oracle.tables(f"""
SELECT txn_id FROM txn WHERE ts_epoch < (SELECT max(ts_epoch) FROM txn WHERE {_BATCH}) AND NOT ({_BATCH}) AND
 (customer_id IN (SELECT customer_id FROM txn WHERE {_BATCH}) OR merchant_id IN (SELECT merchant_id FROM txn WHERE {_BATCH}))"""))
def _(spark, sf):
    """History of the customers and merchants of the last hour's transactions."""
    from ledgerlens.streaming.scoring import relevant_history

    t = star(spark, sf).transactions
    last = t.agg((F.max("ts_epoch") - 3600).alias("_cut"))
    marked = t.crossJoin(F.broadcast(last))
    batch = marked.where(F.col("ts_epoch") >= F.col("_cut")).drop("_cut")
    stored = marked.where(F.col("ts_epoch") < F.col("_cut")).drop("_cut")
    return relevant_history(stored, batch).select("txn_id")


@query("jn11_foreign_id_membership", oracle.tables("""
SELECT count(*) AS n_txn, count(CASE WHEN merchant_id NOT IN (SELECT merchant_id FROM merch) THEN 1 END) AS unknown_merchant FROM txn"""))
def _(spark, sf):
    s = star(spark, sf)
    used = s.transactions.groupBy("merchant_id").agg(F.count("*").alias("n"))
    unknown = used.join(s.merchants.select("merchant_id"), "merchant_id", "left_anti").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("unknown_merchant"))
    return s.transactions.agg(F.count("*").alias("n_txn")).crossJoin(F.broadcast(unknown))


# ============================================================================================= features
_FEATURE_QUERIES = {
    "f01_velocity_counts": ["cnt_10m", "cnt_1h", "cnt_6h", "cnt_24h", "cnt_7d"],
    "f02_velocity_sums": ["sum_1h", "sum_24h", "sum_7d"],
    "f03_small_payments": ["small_cnt_30m"],
    "f04_online_count": ["online_cnt_1h"],
    "f05_distinct_merchants": ["distinct_merchants_24h"],
    "f06_customer_mean": ["cust_prior_n", "cust_prior_mean"],
    "f07_customer_max": ["cust_prior_max"],
    "f08_amount_ratios": ["amount_to_mean", "amount_to_max"],
    "f09_amount_above_max": ["amount_gt_prior_max"],
    "f10_amount_logz": ["amount_logz"],
    "f11_hours_since_last": ["hours_since_last"],
    "f12_distance_from_last": ["dist_from_last_km"],
    "f13_implied_speed": ["implied_speed_kmh"],
    "f14_distance_from_home": ["dist_from_home_km", "is_foreign"],
    "f15_unfamiliar": ["new_country", "new_merchant_for_cust", "new_category_for_cust"],
    "f16_shares": ["cust_channel_share", "cust_category_share", "cust_hourband_share"],
    "f17_night_share": ["cust_night_share"],
    "f18_device": ["device_prior_cnt", "new_device"],
    "f19_rate_change": ["cnt_24h_vs_daily_rate"],
    "f20_merchant_mean": ["merch_prior_n", "merch_prior_mean", "amount_to_merch_mean"],
    "f21_merchant_counts": ["merch_cnt_1h", "merch_cnt_24h"],
    "f22_ages": ["merch_age_days", "account_age_days", "merch_is_online", "is_credit"],
    "f23_matured_fraud_rate": ["merch_fraud_rate_matured"],
}


def _register_features():
    for name, cols in _FEATURE_QUERIES.items():
        def run(spark, sf, cols=cols):
            df = features.build_features(star(spark, sf), DELAY, SETTINGS.skew)
            return rounded(df.select("txn_id", *cols), cols)
        query(name, oracle.features(f"SELECT txn_id, {oracle.rounded(cols)} FROM f"))(run)


_register_features()
_ALL_FEATURES_SQL = oracle.features(f"SELECT txn_id, {oracle.rounded(FEATURES)} FROM f")


@query("f24_all_features", _ALL_FEATURES_SQL)
def _(spark, sf):
    return rounded(features.build_features(star(spark, sf), DELAY, SETTINGS.skew), FEATURES)


@query("f24_all_features_hot_keys", _ALL_FEATURES_SQL)
def _(spark, sf):
    """All features with a row limit low enough that busy customers and merchants are cut into time slabs."""
    return rounded(features.build_features(star(spark, sf), DELAY, Skew(rows_per_task=75)), FEATURES)


@query("f25_dataset", oracle.scored(f"SELECT txn_id, customer_id, merchant_id, day, category, segment, is_fraud, split, {oracle.rounded(['cnt_24h', 'cust_prior_mean', 'merch_fraud_rate_matured'])} FROM ds"))
def _(spark, sf):
    return rounded(feature_table(spark, sf).select(
        "txn_id", "customer_id", "merchant_id", "day", "category", "segment", "is_fraud", "split", "cnt_24h", "cust_prior_mean",
        "merch_fraud_rate_matured"), ["cnt_24h", "cust_prior_mean", "merch_fraud_rate_matured"])


_UNLABELLED = "ulab AS (SELECT * REPLACE (CASE WHEN ts_epoch <= (SELECT max(ts_epoch) - 432000 FROM txn) THEN is_fraud END AS is_fraud) FROM txn)"


@query("f23_unlabelled_rows", oracle.with_ctes(_UNLABELLED, """SELECT txn_id, round((coalesce(sum(is_fraud) OVER m, 0) + 2.0) / (count(is_fraud) OVER m + 200.0), 6)
 AS merch_fraud_rate_matured FROM ulab WINDOW m AS (PARTITION BY merchant_id ORDER BY ts_epoch RANGE BETWEEN UNBOUNDED PRECEDING AND 172800 PRECEDING)"""))
def _(spark, sf):
    """The last five days carry no labels yet; they are ignored, not counted as legitimate."""
    t = star(spark, sf).transactions
    as_of = t.agg((F.max("ts_epoch") - 5 * DAY).alias("_known"))
    t = t.crossJoin(F.broadcast(as_of)).withColumn("is_fraud", F.when(F.col("ts_epoch") <= F.col("_known"), F.col("is_fraud")))
    hot = find_hot_keys(t, "merchant_id", SETTINGS.skew.rows_per_task, features.merchant_reach(DELAY))
    return rounded(features.merchant_history(t.select(*features.FACT_COLUMNS), DELAY, hot).select(
        "txn_id", "merch_fraud_rate_matured"), ["merch_fraud_rate_matured"], 6)


# ================================================================================== rules and anomalies
def _register_rules():
    for rule in rules.RULES:
        name = rule.code.lower()
        sql = oracle.scored(f"SELECT txn_id, {oracle._hit(rule.code)} AS hit FROM ds")
        query(name, sql)(lambda spark, sf, rule=rule: feature_table(spark, sf).select("txn_id", rules.hit(rule).alias("hit")))


_register_rules()


@query("r10_rule_registry", oracle.scored("SELECT rule, count(*) AS hits, CAST(sum(is_fraud) AS BIGINT) AS frauds FROM (SELECT unnest(rule_hits) AS rule, is_fraud FROM sc) GROUP BY rule"))
def _(spark, sf):
    return (scored(spark, sf).select(F.explode("rule_hits").alias("rule"), "is_fraud").groupBy("rule")
            .agg(F.count("*").alias("hits"), F.sum("is_fraud").alias("frauds")))


@query("ru1_rule_hits", oracle.scored("SELECT txn_id, array_to_string(rule_hits, '|') AS rule_hits FROM sc"))
def _(spark, sf):
    return scored(spark, sf).select("txn_id", F.concat_ws("|", rules.rule_hits()).alias("rule_hits"))


@query("ru2_noisy_or", oracle.scored("SELECT txn_id, round(score_rules, 6) AS score_rules FROM sc"))
def _(spark, sf):
    return scored(spark, sf).select("txn_id", F.round(rules.rule_score(), 6).alias("score_rules"))


_REASON_TEXT = "CASE x " + " ".join("WHEN '{}' THEN '{}'".format(r.code, r.text.replace("'", "''")) for r in rules.RULES) + " END"


@query("ru3_rule_reasons", oracle.scored(f"""SELECT txn_id, array_to_string(list_transform(rule_hits, lambda x : x || ' (rule): ' || {_REASON_TEXT}), '; ') AS reasons
 FROM te WHERE alert"""))
def _(spark, sf):
    text = F.transform(rules.rule_reasons(F.col("rule_hits")), lambda r: F.format_string("%s (%s): %s", r["code"], r["source"], r["detail"]))
    return test_rows(spark, sf).where(alert()).select("txn_id", F.array_join(text, "; ").alias("reasons"))


@query("an1_robust_z_fit", oracle.scored("SELECT feature, round(center, 6) AS center, round(scale, 6) AS scale FROM zp"))
def _(spark, sf):
    return rounded(anomaly.fit_robust_z(train_rows(spark, sf)), ["center", "scale"], 6)


@query("an2_robust_z_score", oracle.scored("SELECT txn_id, round(score_z, 5) AS score_z FROM sc"))
def _(spark, sf):
    return scored(spark, sf).select("txn_id", F.round("score_z", 5).alias("score_z"))


@query("an3_isolation_forest")
def _(spark, sf):
    t = SETTINGS.training
    forest = anomaly.fit_forest(train_rows(spark, sf), t.seed, t.forest_trees, t.forest_sample)
    rows = test_rows(spark, sf)
    return rows.select("txn_id", F.round(anomaly.forest_score(forest, rows), 6).alias("score_iforest"))


# ============================================================================================ evaluation
_RK = "SELECT n, n_fraud, round(pr_auc, 6) AS pr_auc, round(roc_auc, 6) AS roc_auc, round(base_rate, 6) AS base_rate FROM rk"
_RKC = ["pr_auc", "roc_auc", "base_rate"]


@query("ev1_ranking_metrics", oracle.scored(_RK, oracle.ranking("te", "score_z")))
def _(spark, sf):
    return rounded(evaluation.ranking_metrics(test_rows(spark, sf), "score_z"), _RKC, 6)


@query("ev1_ranking_with_ties", oracle.scored(_RK, oracle.ranking("te", "score_rules")))
def _(spark, sf):
    return rounded(evaluation.ranking_metrics(test_rows(spark, sf), "score_rules"), _RKC, 6)


_CONF = """count(CASE WHEN is_fraud=1 AND {a} THEN 1 END) AS tp, count(CASE WHEN is_fraud=0 AND {a} THEN 1 END) AS fp,
 count(CASE WHEN is_fraud=1 AND NOT {a} THEN 1 END) AS fn, count(CASE WHEN is_fraud=0 AND NOT {a} THEN 1 END) AS tn"""
_CONF_RATES = """coalesce(tp / nullif(tp+fp, 0), 0) AS precision, coalesce(tp / nullif(tp+fn, 0), 0) AS recall,
 coalesce(2*tp / nullif(2*tp+fp+fn, 0), 0) AS f1, coalesce(fp / nullif(fp+tn, 0), 0) AS false_positive_rate,
 (tp+fp) / (tp+fp+fn+tn) AS alert_rate, coalesce(fp / nullif(tp+fp, 0), 0) AS false_discovery_rate"""
_RATES = ["precision", "recall", "f1", "false_positive_rate", "alert_rate", "false_discovery_rate"]


def _confusion_sql(cond: str, source: str = "te") -> str:
    return oracle.scored(f"""SELECT tp, fp, fn, tn, {oracle.rounded(_RATES, 6)} FROM (SELECT *, {_CONF_RATES} FROM
 (SELECT {_CONF.format(a=cond)} FROM {source}))""")


@query("ev2_confusion", _confusion_sql("alert"))
def _(spark, sf):
    return rounded(evaluation.confusion(test_rows(spark, sf), alert()), _RATES, 6)


_COST_COLS = ["review_cost", "friction_cost", "missed_fraud_cost", "fraud_prevented", "total_cost"]


def _cost_select(a: str) -> str:
    return f"""SELECT 6.0*count(CASE WHEN {a} THEN 1 END) AS review_cost, 3.0*count(CASE WHEN {a} AND is_fraud=0 THEN 1 END) AS friction_cost,
 sum(CASE WHEN is_fraud=1 AND NOT {a} THEN amount + 25.0 ELSE 0 END) AS missed_fraud_cost,
 sum(CASE WHEN is_fraud=1 AND {a} THEN amount ELSE 0 END) AS fraud_prevented FROM te"""


@query("ev3_business_cost", oracle.scored(f"SELECT {oracle.rounded(_COST_COLS, 4)} FROM (SELECT *, review_cost + friction_cost + missed_fraud_cost AS total_cost FROM ({_cost_select('alert')}))"))
def _(spark, sf):
    return rounded(evaluation.business_cost(test_rows(spark, sf), alert()), _COST_COLS, 4)


def _curve_ctes(source: str, score: str, points: int, high: float) -> str:
    return f"""
qs AS (SELECT DISTINCT unnest(quantile_cont({score}, {oracle.grid_sql(0.5, high, points)})) AS threshold FROM {source}),
tot AS (SELECT sum(is_fraud) AS p, sum(amount * is_fraud) AS amt, count(DISTINCT day) AS days FROM {source}),
cv AS (SELECT threshold, count(*) AS alerts, CAST(sum(is_fraud) AS BIGINT) AS tp, sum(amount*is_fraud) AS tp_amount
  FROM qs JOIN {source} ON {score} >= threshold GROUP BY threshold),
cc AS (SELECT threshold, alerts, tp, tp / p AS recall, alerts*6.0 + (alerts-tp)*3.0 + (amt - tp_amount) + (p - tp)*25.0 AS total_cost,
  amt + p*25.0 AS no_alert_cost, days FROM cv, tot)"""


@query("ev4_threshold_by_cost", oracle.scored("""SELECT round(CASE WHEN c < none THEN t ELSE CAST('inf' AS DOUBLE) END, 6) AS threshold, round(CASE WHEN c < none THEN c ELSE none END, 4) AS cost
 FROM (SELECT min(round(total_cost, 6)) AS c, arg_min(threshold, (round(total_cost, 6), threshold)) AS t, max(round(no_alert_cost, 6)) AS none FROM cc)""",
                                              _curve_ctes("va", "score_z", 400, 0.9999)))
def _(spark, sf):
    out = evaluation.threshold_by_cost(valid_rows(spark, sf), "score_z")
    return rounded(rounded(out, ["threshold"], 6), ["cost"], 4)


@query("ev5_threshold_by_precision", oracle.scored("""SELECT round(coalesce(min(CASE WHEN tp / alerts >= 0.2 AND alerts >= 20 THEN score END), CAST('inf' AS DOUBLE)), 6) AS threshold FROM c""",
                                                   oracle.ranking("va", "score_z")))
def _(spark, sf):
    return rounded(evaluation.threshold_by_precision(valid_rows(spark, sf), "score_z", 0.2, 20), ["threshold"], 6)


@query("ev6_threshold_fallbacks", oracle.scored("""SELECT round(review, 6) AS review, round(CASE WHEN b IS NULL THEN CAST(1.01 AS DOUBLE) ELSE greatest(b, review) END, 6) AS block, round(cost, 4) AS valid_cost FROM
 (SELECT CASE WHEN cst < none THEN t ELSE (SELECT quantile_cont(score_rules, 0.99) FROM va) END AS review, CASE WHEN cst < none THEN cst ELSE none END AS cost,
  (SELECT min(CASE WHEN tp / alerts >= 0.9 AND alerts >= 20 THEN score END) FROM c) AS b
  FROM (SELECT min(round(total_cost, 6)) AS cst, arg_min(threshold, (round(total_cost, 6), threshold)) AS t, max(round(no_alert_cost, 6)) AS none FROM cc))""",
                                               _curve_ctes("va", "score_rules", 400, 0.9999) + "," + oracle.ranking("va", "score_rules")))
def _(spark, sf):
    out = evaluation.operating_thresholds(valid_rows(spark, sf), "score_rules")
    return rounded(rounded(out, ["review", "block"], 6), ["valid_cost"], 4)


_LOAD = ["alerts_per_day", "review_hours_per_day", "analysts_needed"]


@query("ev7_workload", oracle.scored(f"""SELECT n_alerts, n_days, {oracle.rounded(_LOAD, 6)} FROM (SELECT *, alerts_per_day*6.0/60 AS review_hours_per_day, alerts_per_day*6.0/60/6.5 AS analysts_needed FROM
 (SELECT *, n_alerts / n_days AS alerts_per_day FROM (SELECT count(CASE WHEN alert THEN 1 END) AS n_alerts, count(DISTINCT day) AS n_days FROM te)))"""))
def _(spark, sf):
    return rounded(evaluation.workload_report(test_rows(spark, sf), alert()), _LOAD, 6)


_TOP = "top AS (SELECT *, row_number() OVER (ORDER BY {s} DESC, txn_id) AS rn FROM te)"


@query("ev8_at_budget", oracle.scored("""SELECT CAST(100 AS BIGINT) AS k, round(sum(is_fraud) / 100.0, 6) AS precision, round(sum(is_fraud) / (SELECT sum(is_fraud) FROM te), 6) AS recall
 FROM top WHERE rn <= 100""", _TOP.format(s="score_z")))
def _(spark, sf):
    return rounded(evaluation.at_budget(test_rows(spark, sf), "score_z", 100), ["precision", "recall"], 6)


_LONG = "lg AS (SELECT txn_id, split, is_fraud, 'rules' AS method, score_rules AS score FROM sc UNION ALL SELECT txn_id, split, is_fraud, 'robust_z', score_z FROM sc)"


@query("ev9_method_comparison", oracle.scored("""SELECT split, method, rk.n, n_fraud, round(pr_auc, 6) AS pr_auc, round(roc_auc, 6) AS roc_auc, round(base_rate, 6) AS base_rate, k AS budget_alerts,
 round(hits / k, 6) AS precision_at_budget, round(hits / n_fraud, 6) AS recall_at_budget FROM rk JOIN
 (SELECT split, method, count(*) AS k, sum(is_fraud) AS hits FROM (SELECT *, row_number() OVER (PARTITION BY split, method ORDER BY score DESC, txn_id) AS rn FROM lg) WHERE rn <= 200 GROUP BY split, method) USING (split, method)""",
                                              _LONG + "," + oracle.ranking("lg", "score", "split, method")))
def _(spark, sf):
    out = evaluation.method_comparison(scored(spark, sf), {"rules": "score_rules", "robust_z": "score_z"}, 200, ["split"])
    return rounded(out, [*_RKC, "precision_at_budget", "recall_at_budget"], 6)


@query("ev10_bootstrap_interval", oracle.scored("""SELECT round(quantile_cont(ap, 0.025), 6) AS ci_low, round(quantile_cont(ap, 0.975), 6) AS ci_high, count(*) AS n_boot FROM
 (SELECT boot, sum(pos * tp / a) / sum(pos) AS ap FROM (SELECT *, sum(n) OVER w AS a, sum(pos) OVER w AS tp FROM
  (SELECT boot, score_rules AS s, CAST(sum(m) AS DOUBLE) AS n, CAST(sum(m * is_fraud) AS DOUBLE) AS pos FROM te JOIN mult USING (day) GROUP BY boot, score_rules)
  WINDOW w AS (PARTITION BY boot ORDER BY s DESC)) GROUP BY boot HAVING sum(pos) > 0)""",
                                                "dd AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS k, count(*) OVER () AS nd FROM (SELECT DISTINCT day FROM te)),"
                                                "mult AS (SELECT boot, day, count(*) AS m FROM (SELECT b.boot, CAST('0x' || substr(md5('0|' || b.boot || '|' || j.k), 1, 8) AS BIGINT) % j.nd AS k"
                                                " FROM (SELECT unnest(range(150)) AS boot) b, dd j) JOIN dd USING (k) GROUP BY boot, day)"))
def _(spark, sf):
    return rounded(evaluation.bootstrap_interval(test_rows(spark, sf), "score_rules", 150), ["ci_low", "ci_high"], 6)


@query("ev11_block_performance", oracle.scored("""SELECT block, first_day, rk.n AS n_txn, round(base_rate, 6) AS fraud_rate, round(pr_auc, 6) AS pr_auc,
 round(coalesce(tp / nullif(a, 0), 0), 6) AS precision, round(coalesce(tp / nullif(n_fraud, 0), 0), 6) AS recall FROM rk JOIN
 (SELECT block, min(day) AS first_day, count(CASE WHEN score_z >= 2 THEN 1 END) AS a, count(CASE WHEN score_z >= 2 AND is_fraud=1 THEN 1 END) AS tp FROM bl GROUP BY block) USING (block)""",
                                               "bl AS (SELECT *, CAST((day - (SELECT min(day) FROM te))//3 AS INT) AS block FROM te)," + oracle.ranking("bl", "score_z", "block")))
def _(spark, sf):
    out = evaluation.block_performance(test_rows(spark, sf), "score_z", 2.0, 3)
    return rounded(out, ["fraud_rate", "pr_auc", "precision", "recall"], 6)


def _bins(n: int) -> str:
    return f"""bn AS (SELECT *, greatest(CAST(ceil((rn - 1) * {n}.0 / (total - 1)) AS INT) - 1, 0) AS bin FROM
 (SELECT *, row_number() OVER (ORDER BY score_rules, txn_id) AS rn, count(*) OVER () AS total FROM te))"""


@query("ev12_calibration_table", oracle.scored("""SELECT bin, round(avg(score_rules), 5) AS mean_pred, round(sum(is_fraud) / count(*), 5) AS observed, count(*) AS n FROM bn GROUP BY bin""", _bins(8)))
def _(spark, sf):
    return rounded(evaluation.calibration_table(test_rows(spark, sf), "score_rules"), ["mean_pred", "observed"], 5)


_CAL = ["brier", "brier_baseline_constant", "ece", "mean_predicted", "observed_rate"]


@query("ev13_calibration_summary", oracle.scored(f"""SELECT {oracle.rounded(_CAL, 6)} FROM (SELECT avg(pow(score_rules - is_fraud, 2)) AS brier, avg(is_fraud)*(1-avg(is_fraud)) AS brier_baseline_constant,
 (SELECT sum(d) / sum(n) FROM (SELECT abs(sum(is_fraud) - sum(score_rules)) AS d, count(*) AS n FROM bn GROUP BY bin)) AS ece,
 avg(score_rules) AS mean_predicted, avg(is_fraud) AS observed_rate FROM te)""", _bins(10)))
def _(spark, sf):
    return rounded(evaluation.calibration_summary(test_rows(spark, sf), "score_rules"), _CAL, 6)


@query("ev14_band_counts", oracle.scored("SELECT band, count(*) AS n FROM te GROUP BY band"))
def _(spark, sf):
    return evaluation.band_counts(test_rows(spark, sf))


@query("ev14_block_band_confusion", _confusion_sql(f"score_rules >= {BLOCK}"))
def _(spark, sf):
    return rounded(evaluation.confusion(test_rows(spark, sf), F.col("score_rules") >= BLOCK), _RATES, 6)


_POLICY = " UNION ALL ".join(f"SELECT '{n}' AS policy, *, review_cost + friction_cost + missed_fraud_cost AS total_cost FROM ({_cost_select(a)})"
                             for n, a in [("model", "alert"), ("no_model", "false"), ("alert_everything", "true")])


@query("ev15_cost_comparison", oracle.scored(f"""SELECT policy, {oracle.rounded(_COST_COLS, 4)}, round(none - total_cost, 4) AS saving_vs_no_model, round(100*(1 - total_cost/none), 4) AS saving_pct
 FROM pol, (SELECT total_cost AS none FROM pol WHERE policy = 'no_model')""", f"pol AS ({_POLICY})"))
def _(spark, sf):
    return rounded(evaluation.cost_comparison(test_rows(spark, sf), alert()), [*_COST_COLS, "saving_vs_no_model", "saving_pct"], 4)


@query("ev16_recall_by_pattern", oracle.scored("""SELECT true_pattern, count(*) AS n, round(count(CASE WHEN score_z >= 2 THEN 1 END) / count(*), 6) AS recall, round(avg(score_z), 5) AS mean_score
 FROM te JOIN truth USING (txn_id) WHERE is_fraud_true = 1 GROUP BY true_pattern"""))
def _(spark, sf):
    out = evaluation.recall_by_pattern(test_rows(spark, sf), views.truth(spark, sf), "score_z", 2.0)
    return rounded(rounded(out, ["recall"], 6), ["mean_score"], 5)


@query("ev16_undiscovered_share", oracle.scored("""SELECT round(coalesce(count(CASE WHEN is_fraud_true = 1 THEN 1 END) / nullif(count(*), 0), 0), 6) AS undiscovered_share
 FROM te JOIN truth USING (txn_id) WHERE score_z >= 2 AND is_fraud = 0"""))
def _(spark, sf):
    return rounded(evaluation.undiscovered_share(test_rows(spark, sf), views.truth(spark, sf), "score_z", 2.0), ["undiscovered_share"], 6)


@query("ev17_split_summary", oracle.scored("SELECT split, count(*) AS n_rows, round(sum(is_fraud)/count(*), 6) AS fraud_rate, min(day) AS first_day, max(day) AS last_day FROM sc GROUP BY split"))
def _(spark, sf):
    return rounded(evaluation.split_summary(scored(spark, sf)), ["fraud_rate"], 6)


@query("ev18_precision_recall_curve", oracle.scored("""SELECT round(score, 6) AS threshold, round(tp / alerts, 6) AS precision, round(tp / p, 6) AS recall, CAST(alerts AS BIGINT) AS alerts FROM c""",
                                                    oracle.ranking("te", "score_rules")))
def _(spark, sf):
    return rounded(evaluation.precision_recall_points(test_rows(spark, sf), "score_rules"), ["threshold", "precision", "recall"], 6)


@query("ev19_threshold_sweep", oracle.scored("""SELECT round(threshold, 6) AS threshold, round(total_cost, 4) AS total_cost, round(alerts / days * 6.0 / 60 / 6.5, 6) AS analysts, round(recall, 6) AS recall FROM cc""",
                                             _curve_ctes("te", "score_z", 120, 0.9995)))
def _(spark, sf):
    rows = test_rows(spark, sf)
    days = rows.agg(F.countDistinct("day").alias("_days"))
    curve = evaluation.cost_curve(rows, "score_z", points=120, high=0.9995).crossJoin(F.broadcast(days))
    load = evaluation.daily_review(F.col("alerts"), F.col("_days"))["analysts_needed"]
    return rounded(rounded(curve.withColumn("analysts", load), ["threshold", "analysts", "recall"], 6), ["total_cost"], 4).select(
        "threshold", "total_cost", "analysts", "recall")


# ============================================================================================ breakdowns
_DIMS = {"segment": "segment", "channel": "channel", "category": "category", "amount_bucket": "amount_bucket", "history": "history"}


@query("br1_false_positive_rates", oracle.scored(f"""SELECT dim, value, count(*) AS legit_txns, count(CASE WHEN alert THEN 1 END) AS false_positives,
 round(100.0*count(CASE WHEN alert THEN 1 END)/count(*), 4) AS fp_rate_pct,
 round(100.0*count(CASE WHEN alert THEN 1 END)/(SELECT greatest(count(*), 1) FROM te WHERE alert AND is_fraud=0), 4) AS share_of_fps_pct
 FROM ({" UNION ALL ".join(f"SELECT '{d}' AS dim, {c} AS value, alert FROM te WHERE is_fraud=0" for d, c in _DIMS.items())}) WHERE value IS NOT NULL GROUP BY dim, value"""))
def _(spark, sf):
    return rounded(breakdown.false_positive_rates(test_rows(spark, sf), alert()), ["fp_rate_pct", "share_of_fps_pct"], 4)


_FPC = "fpc AS (SELECT customer_id, count(*) AS n FROM te WHERE alert AND is_fraud=0 GROUP BY customer_id)"


@query("br2_fp_concentration", oracle.scored("""SELECT CAST(sum(n) AS BIGINT) AS n_false_positives, count(*) AS customers_with_fp,
 round(100.0*sum(CASE WHEN n >= 3 THEN n ELSE 0 END)/sum(n), 4) AS pct_fps_from_customers_with_3plus FROM fpc""", _FPC))
def _(spark, sf):
    return rounded(breakdown.false_positive_concentration(test_rows(spark, sf), alert()), ["pct_fps_from_customers_with_3plus"], 4)


@query("br2_top_fp_customers", oracle.scored("SELECT customer_id, n AS false_positives FROM fpc ORDER BY n DESC, customer_id LIMIT 5", _FPC))
def _(spark, sf):
    return breakdown.top_false_positive_customers(test_rows(spark, sf), alert())


@query("br3_top_fp_rules", oracle.scored("""SELECT rule, count(*) AS false_positives FROM (SELECT unnest(rule_hits) AS rule FROM te WHERE alert AND is_fraud=0)
 GROUP BY rule ORDER BY false_positives DESC, rule LIMIT 8"""))
def _(spark, sf):
    return breakdown.top_false_positive_rules(test_rows(spark, sf), alert())


@query("br4_slice_report", oracle.scored(f"""SELECT dim, value, n, n_fraud, round(n_fraud/n, 6) AS fraud_rate, round(recall, 6) AS recall, round(fpr, 6) AS fpr, round(alerts/n, 6) AS alert_rate,
 array_to_string(list_filter([CASE WHEN n_fraud >= 10 AND o_recall > 0 AND recall < 0.7*o_recall THEN 'low_recall' END,
  CASE WHEN n - n_fraud >= 100 AND o_fpr > 0 AND fpr > 1.5*o_fpr THEN 'high_false_positive_rate' END], lambda x : x IS NOT NULL), '|') AS flags FROM
 (SELECT dim, value, count(*) AS n, CAST(sum(is_fraud) AS BIGINT) AS n_fraud, count(CASE WHEN alert THEN 1 END) AS alerts,
  count(CASE WHEN alert AND is_fraud=1 THEN 1 END) / nullif(sum(is_fraud), 0) AS recall, count(CASE WHEN alert AND is_fraud=0 THEN 1 END) / nullif(count(*) - sum(is_fraud), 0) AS fpr
  FROM ({" UNION ALL ".join(f"SELECT '{d}' AS dim, coalesce({c}, 'missing') AS value, alert, is_fraud FROM te" for d, c in _DIMS.items())}) GROUP BY dim, value),
 (SELECT count(CASE WHEN alert AND is_fraud=1 THEN 1 END) / greatest(sum(is_fraud), 1) AS o_recall, count(CASE WHEN alert AND is_fraud=0 THEN 1 END) / greatest(count(*) - sum(is_fraud), 1) AS o_fpr FROM te)"""))
def _(spark, sf):
    out = breakdown.slice_report(test_rows(spark, sf), alert(), min_fraud=10, min_legit=100)
    return rounded(out.withColumn("flags", F.concat_ws("|", "flags")), ["fraud_rate", "recall", "fpr", "alert_rate"], 6)


@query("br5_daily_trend", oracle.scored("""SELECT day, n, fraud, alerts, round(CASE WHEN count(*) OVER w = 7 THEN sum(fraud) OVER w / sum(n) OVER w END, 6) AS fraud_rate_7d FROM
 (SELECT day, count(*) AS n, CAST(sum(is_fraud) AS BIGINT) AS fraud, count(CASE WHEN alert THEN 1 END) AS alerts FROM sc GROUP BY day) WINDOW w AS (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"""))
def _(spark, sf):
    return rounded(breakdown.daily_trend(scored(spark, sf), alert()), ["fraud_rate_7d"], 6)


@query("br6_category_rates", oracle.scored("SELECT category, count(*) AS n, round(sum(is_fraud)/count(*), 6) AS fraud_rate FROM sc GROUP BY category"))
def _(spark, sf):
    return rounded(breakdown.category_rates(scored(spark, sf)), ["fraud_rate"], 6)


@query("br7_score_histogram", oracle.scored("SELECT CAST(least(floor(score_rules*60), 59) AS INT) AS bin, is_fraud, count(*) AS n FROM te GROUP BY 1, 2"))
def _(spark, sf):
    return breakdown.score_histogram(test_rows(spark, sf), "score_rules")


@query("br8_pattern_distribution", oracle.scored("SELECT true_pattern, count(*) AS n FROM te JOIN truth USING (txn_id) WHERE is_fraud=1 GROUP BY true_pattern"))
def _(spark, sf):
    return breakdown.pattern_distribution(test_rows(spark, sf), views.truth(spark, sf))


# ===================================================================================== model statistics
@query("md6_model_metadata", oracle.scored("SELECT split, count(*) AS n_rows, round(sum(is_fraud)/count(*), 6) AS fraud_rate, min(day) AS first_day, max(day) AS last_day FROM ds WHERE split IS NOT NULL GROUP BY split"))
def _(spark, sf):
    return rounded(evaluation.split_summary(feature_table(spark, sf).where(F.col("split").isNotNull())), ["fraud_rate"], 6)


@query("md7_drift_reference", oracle.scored(f"SELECT txn_id, {oracle.rounded(['amount', 'cnt_24h', 'amount_logz'])} FROM tr WHERE day >= (SELECT max(day) FROM tr) - 60"))
def _(spark, sf):
    from ledgerlens.plans.training import drift_reference

    return rounded(drift_reference(train_rows(spark, sf), SETTINGS.training).select("txn_id", "amount", "cnt_24h", "amount_logz"),
                   ["amount", "cnt_24h", "amount_logz"])


@query("md8_baseline_values", oracle.scored(" UNION ALL ".join(
    f"SELECT '{f}' AS feature, round(coalesce(median(CAST({f} AS DOUBLE)), 0), 6) AS baseline FROM tr WHERE is_fraud = 0" for f in FEATURES)))
def _(spark, sf):
    from ledgerlens.plans.training import baseline_table

    return rounded(baseline_table(train_rows(spark, sf)), ["baseline"], 6)


# ============================================================================================ monitoring
_WIN = """ww AS (SELECT *, CAST((day - (SELECT min(day) FROM sc))//4 AS INT) AS win FROM sc),
full_ AS (SELECT win FROM ww GROUP BY win HAVING count(DISTINCT day) >= 0.7*4), wi AS (SELECT ww.* FROM ww JOIN full_ USING (win))"""
_REF = "rf AS (SELECT * FROM tr)"
_SOME = ["amount", "cnt_24h", "amount_logz", "hours_since_last", "new_device", "category_code", "cust_night_share"]


def _reference(spark, sf):
    return train_rows(spark, sf)


@query("mn1_psi", oracle.scored("SELECT feature, round(psi, 6) AS psi FROM ps", _REF + "," + oracle.psi_ctes(_SOME, "rf", "te")))
def _(spark, sf):
    return rounded(drift.psi_table(_reference(spark, sf), test_rows(spark, sf), _SOME), ["psi"], 6)


@query("mn2_status", oracle.scored(f"SELECT feature, {oracle.STATUS} AS status FROM ps", _REF + "," + oracle.psi_ctes(_SOME, "rf", "te")))
def _(spark, sf):
    return drift.psi_table(_reference(spark, sf), test_rows(spark, sf), _SOME).select("feature", drift.status(F.col("psi")).alias("status"))


@query("mn3_feature_drift", oracle.scored(f"SELECT feature, round(psi, 6) AS psi, {oracle.STATUS} AS status FROM ps",
                                          _REF + "," + oracle.psi_ctes(oracle.DRIFT_FEATURES, "rf", "te")))
def _(spark, sf):
    return rounded(drift.feature_drift(_reference(spark, sf), test_rows(spark, sf), drift.drift_features(FEATURES)), ["psi"], 6)


_SCORE_STATUS = oracle.STATUS.replace("psi", "score_psi")


@query("mn4_windowed_drift", oracle.scored(f"""SELECT win AS "window", CAST(d0 + win*4 AS INT) AS start_day, CAST(d0 + win*4 + 3 AS INT) AS end_day, n_txn, round(score_psi, 6) AS score_psi, {_SCORE_STATUS} AS score_status,
 round(mx, 6) AS max_feature_psi, nw AS n_features_warn, na AS n_features_alert, top AS top_drifting_features, round(alert_rate, 6) AS alert_rate, round(mean_score, 6) AS mean_score FROM
 (SELECT win, count(*) AS n_txn, count(CASE WHEN alert THEN 1 END)/count(*) AS alert_rate, avg(score_rules) AS mean_score FROM wi GROUP BY win)
 JOIN (SELECT win, psi AS score_psi FROM ps WHERE feature='score_rules') USING (win)
 JOIN (SELECT win, max(psi) AS mx, count(CASE WHEN psi >= 0.10 THEN 1 END) AS nw, count(CASE WHEN psi >= 0.25 THEN 1 END) AS na,
   string_agg(CASE WHEN rn <= 3 THEN feature || ' (' || format('{{:.2f}}', psi) || ')' END, ', ' ORDER BY rn) AS top
   FROM (SELECT *, row_number() OVER (PARTITION BY win ORDER BY psi DESC NULLS LAST, feature) AS rn FROM ps WHERE feature <> 'score_rules') GROUP BY win) USING (win),
 (SELECT min(day) AS d0 FROM sc)""",
                                           f"{_WIN}, rf AS (SELECT tr.*, 1.0 - {' * '.join(f'(CASE WHEN {oracle._hit(c)} THEN 1.0 - CAST({w} AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END)' for c, (_, w) in oracle.RULE_SQL.items())} AS score_rules FROM tr),"
                                           + oracle.psi_ctes([*oracle.DRIFT_FEATURES, "score_rules"], "rf", "wi", "win")))
def _(spark, sf):
    ref = _reference(spark, sf).withColumn("score_rules", rules.rule_score())
    out = drift.windowed_drift(scored(spark, sf), ref, FEATURES, "score_rules", SETTINGS.monitor_window_days, REVIEW)
    return rounded(out, ["score_psi", "max_feature_psi", "alert_rate", "mean_score"], 6)


@query("mn5_delayed_performance", oracle.scored("""SELECT win AS "window", CAST(d0 + win*4 AS INT) AS start_day, CAST(d0 + win*4 + 3 AS INT) AS end_day, mature AS labels_mature, round(base_rate, 6) AS fraud_rate,
 round(CASE WHEN ok THEN pr_auc END, 6) AS pr_auc, round(CASE WHEN ok THEN tp / greatest(a, 1) END, 6) AS precision, round(CASE WHEN ok THEN tp / greatest(n_fraud, 1) END, 6) AS recall FROM
 (SELECT *, d0 + win*4 + 3 + 2 <= as_of AS mature, d0 + win*4 + 3 + 2 <= as_of AND n_fraud >= 5 AS ok FROM rk JOIN
 (SELECT win, count(CASE WHEN alert THEN 1 END) AS a, count(CASE WHEN alert AND is_fraud=1 THEN 1 END) AS tp FROM wi GROUP BY win) USING (win), (SELECT min(day) AS d0, max(day) AS as_of FROM sc))""",
                                                _WIN + "," + oracle.ranking("wi", "score_rules", "win")))
def _(spark, sf):
    out = drift.delayed_performance(scored(spark, sf), "score_rules", SETTINGS.monitor_window_days, REVIEW, DELAY)
    return rounded(out, ["fraud_rate", "pr_auc", "precision", "recall"], 6)


@query("mn6_summary", f"""WITH d AS (SELECT * FROM ({ORACLES['mn4_windowed_drift']}) ORDER BY "window" DESC LIMIT 1),
p AS (SELECT * FROM ({ORACLES['mn5_delayed_performance']}) WHERE labels_mature AND pr_auc IS NOT NULL ORDER BY "window" DESC LIMIT 1),
b AS ({oracle.scored("SELECT pr_auc AS b_auc, (SELECT count(CASE WHEN alert AND is_fraud = 1 THEN 1 END) / greatest(sum(is_fraud), 1) FROM va) AS b_recall FROM rk", oracle.ranking("va", "score_rules"))}),
w AS (SELECT d.*, p.pr_auc AS a, p.recall AS r, b_auc, b_recall, p.pr_auc IS NOT NULL AS seen,
  greatest(coalesce(1 - p.pr_auc / nullif(b_auc, 0), 0), coalesce(1 - p.recall / nullif(b_recall, 0), 0)) AS worst FROM d CROSS JOIN b LEFT JOIN p ON true),
l AS (SELECT *, CASE WHEN n_features_alert > 0 THEN 2 WHEN n_features_warn > 0 THEN 1 ELSE 0 END AS lf, CASE score_status WHEN 'alert' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END AS ls,
  CASE WHEN seen AND worst >= 0.30 THEN 2 WHEN seen AND worst >= 0.15 THEN 1 ELSE 0 END AS lp FROM w)
SELECT ['ok', 'warn', 'alert'][greatest(lf, ls, lp) + 1] AS status, "window" AS latest_window,
  CAST((lf > 0)::INT + (ls > 0)::INT + (lp > 0)::INT AS INT) AS n_findings, lf > 0 AS features_moved, ls > 0 AS scores_moved, lp > 0 AS performance_fell FROM l""")
def _(spark, sf):
    """Status of the latest block; the findings are reduced to which of them there are."""
    ref = _reference(spark, sf).withColumn("score_rules", rules.rule_score())
    s, days = scored(spark, sf), SETTINGS.monitor_window_days
    base = evaluation.ranking_metrics(valid_rows(spark, sf), "score_rules").first()
    conf = evaluation.confusion(valid_rows(spark, sf), alert()).first()
    out = drift.summarize(drift.windowed_drift(s, ref, FEATURES, "score_rules", days, REVIEW),
                          drift.delayed_performance(s, "score_rules", days, REVIEW, DELAY), base["pr_auc"], conf["recall"])

    def says(part: str):
        return F.exists("findings", lambda x: F.contains(x, F.lit(part)))

    none = says("no material drift")
    return out.select("status", "latest_window", F.when(none, 0).otherwise(F.size("findings")).alias("n_findings"),
                      says("feature(s) with PSI").alias("features_moved"), says("distribution shifted").alias("scores_moved"),
                      says("performance").__and__(~none).alias("performance_fell"))


@query("mn7_latest_feature_psi", oracle.scored(f"SELECT feature, round(psi, 6) AS psi, {oracle.STATUS} AS status FROM ps",
                                               f"{_WIN}, {_REF}, lastw AS (SELECT * FROM wi WHERE win = (SELECT max(win) FROM wi))," + oracle.psi_ctes(oracle.DRIFT_FEATURES, "rf", "lastw")))
def _(spark, sf):
    blocks = drift.with_windows(scored(spark, sf), SETTINGS.monitor_window_days)
    last = blocks.agg(F.max("window").alias("window"))
    latest = blocks.join(F.broadcast(last), "window", "left_semi")
    return rounded(drift.feature_drift(_reference(spark, sf), latest, drift.drift_features(FEATURES)), ["psi"], 6)


def _cube(spark, sf):
    """A cube that was filled in two steps, the first day of the second step counted twice."""
    from ledgerlens.operators.cube import DriftCube

    cube = DriftCube(spark, _fresh(spark, "cube"), FEATURES, "score_rules", REVIEW)
    cube.start(_reference(spark, sf).withColumn("score_rules", rules.rule_score()))
    rows = scored(spark, sf)
    low, high = rows.agg(F.min("day"), F.max("day")).first()
    middle = (low + high) // 2
    cube.add(rows.where(F.col("day") <= middle))
    cube.add(rows.where(F.col("day") >= middle))
    return cube


@query("mn4_drift_cube", ORACLES["mn4_windowed_drift"])
def _(spark, sf):
    return rounded(_cube(spark, sf).windowed_drift(SETTINGS.monitor_window_days), ["score_psi", "max_feature_psi", "alert_rate", "mean_score"], 6)


@query("mn7_latest_from_cube", ORACLES["mn7_latest_feature_psi"])
def _(spark, sf):
    return rounded(_cube(spark, sf).latest_drift(SETTINGS.monitor_window_days), ["psi"], 6)


@query("snk3_monitoring_csv", ORACLES["mn4_windowed_drift"])
def _(spark, sf):
    """Writes the drift table of the monitoring run as CSV and reads it with its declared schema."""
    path = f"{workspace(spark)}/drift-csv"
    writers.write_csv(QUERIES["mn4_windowed_drift"](spark, sf), path)
    return readers.read_csv(spark, path, "window INT, start_day INT, end_day INT, n_txn BIGINT, score_psi DOUBLE, score_status STRING, "
                            "max_feature_psi DOUBLE, n_features_warn BIGINT, n_features_alert BIGINT, top_drifting_features STRING, "
                            "alert_rate DOUBLE, mean_score DOUBLE")


# =========================================================================================== data quality
@query("dq1_key_uniqueness", oracle.tables(" UNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*) AS n_rows, count(*) - count(DISTINCT {k}) AS duplicate_keys FROM {t}"
    for n, t, k in [("transactions", "txn", "txn_id"), ("customers", "cust", "customer_id"), ("accounts", "acct", "account_id"),
                    ("merchants", "merch", "merchant_id"), ("locations", "loc", "location_id")])))
def _(spark, sf):
    s = star(spark, sf)
    return quality.key_report({n: (getattr(s, n), k) for n, k in [
        ("transactions", "txn_id"), ("customers", "customer_id"), ("accounts", "account_id"), ("merchants", "merchant_id"),
        ("locations", "location_id")]})


@query("dq2_referential_integrity", oracle.tables(" UNION ALL ".join(
    f"SELECT '{fk}' AS foreign_key, count(*) AS orphans FROM txn WHERE {fk} NOT IN (SELECT {fk} FROM {t})"
    for fk, t in [("customer_id", "cust"), ("account_id", "acct"), ("merchant_id", "merch"), ("location_id", "loc")])))
def _(spark, sf):
    return quality.orphan_report(star(spark, sf))


@query("dq3_nulls", oracle.tables(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS nulls FROM txn" for c in [*quality.REQUIRED, "device_id"])))
def _(spark, sf):
    return quality.null_report(star(spark, sf).transactions, [*quality.REQUIRED, "device_id"])


@query("dq4_account_owner", oracle.tables("SELECT count(*) AS mismatched FROM txn t JOIN acct a USING (account_id) WHERE a.customer_id <> t.customer_id"))
def _(spark, sf):
    return quality.foreign_accounts(star(spark, sf))


_ODD = """odd AS (SELECT * REPLACE (CASE WHEN txn_id%50=0 THEN -amount WHEN txn_id%50=1 THEN amount*1e8 ELSE amount END AS amount,
 CASE WHEN txn_id%50=2 THEN 'wire' ELSE channel END AS channel, CASE WHEN txn_id%50=3 THEN 999999 ELSE merchant_id END AS merchant_id,
 CASE WHEN txn_id%50=4 THEN 'x''; DROP TABLE t' ELSE device_id END AS device_id) FROM txn)"""


@query("dq5_row_validation", oracle.with_ctes(_ODD, """SELECT txn_id, array_to_string(list_filter([
 CASE WHEN device_id IS NOT NULL AND NOT (regexp_full_match(device_id, '[A-Za-z0-9_-]+') AND length(device_id) <= 32) THEN 'bad_device_id' END,
 CASE WHEN NOT (amount > 0 AND amount < 1e7) THEN 'bad_amount' END, CASE WHEN channel NOT IN ('card_present','online','atm') THEN 'bad_channel' END,
 CASE WHEN merchant_id NOT IN (SELECT merchant_id FROM merch) THEN 'unknown_merchant_id' END], lambda x : x IS NOT NULL), '|') AS reject_reasons FROM odd"""))
def _(spark, sf):
    """The transactions with every kind of defect planted, so that good rows and rejects both occur."""
    s = star(spark, sf)
    t, kind = s.transactions, F.col("txn_id") % 50
    odd = t.withColumns({
        "amount": F.when(kind == 0, -F.col("amount")).when(kind == 1, F.col("amount") * 1e8).otherwise(F.col("amount")),
        "channel": F.when(kind == 2, "wire").otherwise(F.col("channel")),
        "merchant_id": F.when(kind == 3, F.lit(999999)).otherwise(F.col("merchant_id")),
        "device_id": F.when(kind == 4, "x'; DROP TABLE t").otherwise(F.col("device_id"))})
    return quality.validate_rows(odd, s).select("txn_id", F.concat_ws("|", "reject_reasons").alias("reject_reasons"))


@query("dq6_time_order", oracle.tables("""SELECT count(CASE WHEN p > ts_epoch THEN 1 END) AS unordered, count(CASE WHEN NOT amount > 0 THEN 1 END) AS bad_amounts
 FROM (SELECT *, lag(ts_epoch) OVER (ORDER BY txn_id) AS p FROM txn)"""))
def _(spark, sf):
    return quality.order_report(star(spark, sf).transactions)


@query("dq6_time_order_orders", """SELECT count(CASE WHEN p > t THEN 1 END) AS unordered, count(CASE WHEN NOT o_totalprice > 0 THEN 1 END) AS bad_amounts
 FROM (SELECT *, epoch(o_orderdate) AS t, lag(epoch(o_orderdate)) OVER (ORDER BY o_orderkey) AS p FROM orders)""")
def _(spark, sf):
    """Order keys do not follow time, so this one finds violations."""
    return quality.order_report(views.order_transactions(spark, sf))


@query("dq7_banned_columns", """SELECT 'features' AS input, '' AS banned, count(*) AS n_rows FROM events
UNION ALL SELECT 'with ground truth', 'is_fraud_true|true_pattern', count(*) FROM events""")
def _(spark, sf):
    """The feature table has none; joined with the ground truth it has two."""
    d = feature_table(spark, sf)
    both = {"features": d, "with ground truth": d.join(views.truth(spark, sf), "txn_id")}
    return reduce(DataFrame.unionByName, [x.agg(F.count("*").alias("n_rows")).select(
        F.lit(n).alias("input"), F.lit("|".join(quality.banned_columns(x))).alias("banned"), "n_rows") for n, x in both.items()])


@query("dq8_leakage_audit", oracle.tables(""", cut AS (SELECT CAST(floor(min(ts_epoch) + (max(ts_epoch) - min(ts_epoch)) * 2.0 / 3.0) AS BIGINT) // 86400 * 86400 AS c FROM txn)
SELECT 'planted' AS features, txn_id FROM txn t, cut WHERE ts_epoch <= c AND EXISTS (SELECT 1 FROM txn u WHERE u.customer_id = t.customer_id AND u.ts_epoch > c)"""))
def _(spark, sf):
    """The features pass; with a count of the customer's later rows planted among them, exactly the rows it touches are found."""
    from pyspark.sql import Window

    s = star(spark, sf)
    cut = quality.last_cut(s.transactions)

    def planted(part, *options, **more):
        future = Window.partitionBy("customer_id")
        counted = part.transactions.select("txn_id", F.count("*").over(future).alias("_all"))
        return features.build_features(part, *options, **more).drop("cnt_24h").join(counted, "txn_id").withColumnRenamed("_all", "cnt_24h")

    clean = quality.leakage_audit(s, DELAY, cut, SETTINGS.skew).select(F.lit("clean").alias("features"), "txn_id")
    return clean.unionByName(quality.leakage_audit(s, DELAY, cut, SETTINGS.skew, planted).select(F.lit("planted").alias("features"), "txn_id"))


# =============================================================================== models, reasons, backtest
def _trained(spark, sf):
    """One model per application, fitted with the production settings."""
    from ledgerlens.plans.training import train_all

    key = (spark.sparkContext.applicationId, sf, "trained")
    if key not in _tables:
        _tables[key] = train_all(feature_table(spark, sf), SETTINGS)
    return _tables[key]


def _model_scores(spark, sf, column):
    return _trained(spark, sf).scored.select("txn_id", "split", F.round(column, 6).alias(column))


@query("md1_logistic_regression")
def _(spark, sf):
    return _model_scores(spark, sf, "score_logreg")


@query("md2_boosted_trees")
def _(spark, sf):
    return _model_scores(spark, sf, "score_boosted")


def _newton_sql(steps: int) -> str:
    """CTEs: counts per score value of the validation rows, then one row of parameters per Newton step."""
    out = ["""pz AS MATERIALIZED (SELECT ln(p / (1 - p)) AS z, count(*) AS n, sum(is_fraud) AS pos FROM
 (SELECT greatest(1e-6, least(score_rules, 1 - 1e-6)) AS p, is_fraud FROM va) GROUP BY p),
n0 AS MATERIALIZED (SELECT CAST(0 AS DOUBLE) AS a, ln(sum(pos) / (sum(n) - sum(pos))) AS b FROM pz)"""]
    for i in range(steps):
        out.append(f"""s{i} AS MATERIALIZED (SELECT any_value(a) AS a, any_value(b) AS b, sum((n*p - pos)*z) + 1e-9*sum(n)*any_value(a) AS ga, sum(n*p - pos) AS gb,
 sum(n*p*(1-p)*z*z) + 1e-9*sum(n) AS haa, sum(n*p*(1-p)*z) AS hab, sum(n*p*(1-p)) AS hbb
 FROM (SELECT z, n, pos, a, b, 1/(1+exp(-(a*z+b))) AS p FROM pz, n{i})),
n{i + 1} AS MATERIALIZED (SELECT a - (hbb*ga - hab*gb)/(haa*hbb - hab*hab) AS a, b - (haa*gb - hab*ga)/(haa*hbb - hab*hab) AS b FROM s{i})""")
    return ",".join(out)


@query("md3_platt_calibration", oracle.scored("""SELECT txn_id, split, round(1/(1+exp(-(a*ln(p/(1-p)) + b))), 6) AS p_rules FROM
 (SELECT *, greatest(1e-6, least(score_rules, 1 - 1e-6)) AS p FROM sc), n12""", _newton_sql(12)))
def _(spark, sf):
    """The rule score calibrated on the validation rows."""
    from ledgerlens.plans.training import fit_platt

    rows = scored(spark, sf)
    platt = fit_platt(rows.where(F.col("split") == "valid"), "score_rules")
    return rows.select("txn_id", "split", F.round(platt.predict(F.col("score_rules")), 6).alias("p_rules"))


@query("md3_calibrated_model")
def _(spark, sf):
    return _model_scores(spark, sf, "p_model")


@query("md4_train_and_select")
def _(spark, sf):
    """Every method on the same validation and test rows."""
    from ledgerlens.plans.training import SCORES

    t = _trained(spark, sf)
    return rounded(evaluation.method_comparison(t.scored, {**SCORES, "calibrated": "p_model"}, 200, ["split"]),
                   [*_RKC, "precision_at_budget", "recall_at_budget"], 6)


@query("md5_score_record")
def _(spark, sf):
    return _trained(spark, sf).scored.select("txn_id", F.round("p_model", 6).alias("p_model"), "band")


@query("snk6_model_roundtrip", oracle.scored("SELECT count(*) AS n, CAST(0 AS BIGINT) AS different FROM te"))
def _(spark, sf):
    """Saves the model, loads it and counts the test rows on which both disagree (none)."""
    from ledgerlens.plans.training import RiskModel

    t = _trained(spark, sf)
    t.model.save(f"{workspace(spark)}/model")
    again = RiskModel.load(f"{workspace(spark)}/model")
    rows = feature_table(spark, sf).where(F.col("split") == "test")
    both = again.predict(rows).select("txn_id", F.col("p_model").alias("p2")).join(t.scored.select("txn_id", "p_model"), "txn_id")
    return both.agg(F.count("*").alias("n"), F.count(F.when(F.abs(F.col("p2") - F.col("p_model")) > 1e-9, 1)).alias("different"))


#: Coefficients of a fixed linear model, whose contributions any engine can work out.
_LINEAR = {f: (i * 7 % 11 - 5) / 100 for i, f in enumerate(FEATURES)}


def _linear_sql() -> str:
    """CTEs: baseline medians and, for each alert of the test rows, the contribution of every group and the codes of the strongest."""
    from ledgerlens.operators.explain import FEATURE_GROUPS, drop_column

    def log(x: str) -> str:
        return f"sign({x}) * ln(1 + abs({x}))"

    medians = ", ".join(f"coalesce(median(CAST({f} AS DOUBLE)), 0) AS b_{f}" for f in FEATURES)
    drops = ", ".join(f"{' + '.join(f'({_LINEAR[f]}) * (' + log(f'coalesce(CAST({f} AS DOUBLE), 0.0)') + ' - ' + log(f'b_{f}') + ')' for f in fs if f in _LINEAR)} AS {drop_column(g)}"
                      for g, fs in FEATURE_GROUPS.items())
    found = ", ".join(f"{{'w': {drop_column(g)}, 'i': {-i}, 'code': '{g}'}}" for i, g in enumerate(FEATURE_GROUPS))
    return f"""bm AS (SELECT {medians} FROM tr WHERE is_fraud = 0),
gc AS (SELECT te.txn_id, rule_hits, {drops} FROM te, bm WHERE alert),
ex AS (SELECT *, list_transform(list_sort(list_filter([{found}], lambda x : x.w >= 0.15), 'DESC')[1:3], lambda x : x.code) AS codes FROM gc)"""


def _linear(spark, sf):
    """The fixed model and the alerts of the test rows."""
    from ledgerlens.operators.explain import LinearModel
    from ledgerlens.plans.training import baseline_table

    baseline = {r["feature"]: r["baseline"] for r in baseline_table(train_rows(spark, sf)).collect()}  # one row per feature
    return LinearModel(_LINEAR, baseline), test_rows(spark, sf)


_GROUP_DROPS = ["drop_velocity", "drop_amount_deviation", "drop_geo_anomaly", "drop_new_device", "drop_merchant_risk", "drop_unfamiliar_merchant",
                "drop_time_pattern", "drop_customer_profile"]


@query("ex1_group_contributions", oracle.scored(f"SELECT txn_id, {oracle.rounded(_GROUP_DROPS, 5)} FROM gc", _linear_sql()))
def _(spark, sf):
    from ledgerlens.operators.explain import group_contributions

    model, rows = _linear(spark, sf)
    return rounded(group_contributions(model, rows.where(alert()), model.baseline), _GROUP_DROPS, 5)


@query("ex2_model_reasons", oracle.scored("SELECT txn_id, array_to_string(codes, '|') AS codes FROM ex", _linear_sql()))
def _(spark, sf):
    from ledgerlens.operators.explain import group_contributions, model_reasons

    model, rows = _linear(spark, sf)
    alerts = rows.where(alert())
    found = alerts.join(group_contributions(model, alerts, model.baseline), "txn_id").withColumn("r", model_reasons())
    return found.select("txn_id", F.array_join(F.transform("r", lambda x: x["code"]), "|").alias("codes"))


@query("ex3_merged_reasons", oracle.scored("""SELECT te.txn_id, coalesce(array_to_string(list_concat(ex.rule_hits, codes), '|'), '') AS codes,
 coalesce(list_concat(ex.rule_hits, codes)[1], '') AS top_reason FROM te LEFT JOIN ex USING (txn_id)""", _linear_sql()))
def _(spark, sf):
    from ledgerlens.operators.explain import with_reasons

    model, rows = _linear(spark, sf)
    merged = with_reasons(model, rows.withColumn("rule_hits", rules.rule_hits()), alert())
    codes = F.transform(F.from_json("reasons", "array<struct<code string>>"), lambda x: x["code"])
    return merged.select("txn_id", F.coalesce(F.array_join(codes, "|"), F.lit("")).alias("codes"), "top_reason")


def _explained(spark, sf):
    """Test rows of the trained model with the reasons of its alerts."""
    from ledgerlens.operators.explain import with_reasons

    t = _trained(spark, sf)
    return with_reasons(t.model, t.scored.where(F.col("split") == "test"), F.col("p_model") >= t.model.review)


@query("ex3_model_alert_reasons")
def _(spark, sf):
    """Reasons of the trained model's alerts."""
    return _explained(spark, sf).select("txn_id", "reasons", "top_reason")


def _backtest(spark, sf):
    from ledgerlens.plans.backtest import run_backtest

    key = (spark.sparkContext.applicationId, sf, "backtest")
    if key not in _tables:
        # days scaled to a history of thirty; two of the four origins have enough of it
        folds, summary = run_backtest(feature_table(spark, sf), SETTINGS, step_days=4, test_days=6, min_train_days=4)
        _tables[key] = (folds, materialize(summary, "summary"))
    return _tables[key]


@query("bt1_backtest_folds")
def _(spark, sf):
    return _backtest(spark, sf)[0]


@query("bt2_backtest_summary")
def _(spark, sf):
    return _backtest(spark, sf)[1]


_TXN_TEXT = " || ".join(f"coalesce(CAST(length({x}) AS VARCHAR) || ':' || {x}, '-')" for x in (
    "CAST(txn_id AS VARCHAR)", "CAST(account_id AS VARCHAR)", "CAST(customer_id AS VARCHAR)", "CAST(merchant_id AS VARCHAR)", "CAST(location_id AS VARCHAR)",
    "CAST(ts AS VARCHAR)", "txn_date", "CAST(hour_local AS VARCHAR)", "CAST(dow_local AS VARCHAR)", "CAST(ts_epoch AS VARCHAR)",
    "replace(printf('%a', CAST(amount AS DOUBLE)), '+', '')", "channel", "device_id", "CAST(is_fraud AS VARCHAR)"))
_TXN_COLUMNS = ["txn_id", "account_id", "customer_id", "merchant_id", "location_id", "ts", "txn_date", "hour_local", "dow_local", "ts_epoch", "amount", "channel",
                "device_id", "is_fraud"]
_PRINT = f"""SELECT n_rows, sha256(n_rows || '|' || {" || '|' || ".join(f"l{i}" for i in range(8))}) AS fingerprint FROM (SELECT count(*) AS n_rows,
 {", ".join(f"CAST(sum(CAST('0x' || substr(h, {8 * i + 1}, 8) AS HUGEINT)) % 4294967296 AS BIGINT) AS l{i}" for i in range(8))} FROM (SELECT sha256({_TXN_TEXT}) AS h FROM txn))"""


@query("pv1_fingerprint", oracle.tables(_PRINT))
def _(spark, sf):
    from ledgerlens.operators.provenance import fingerprint

    return fingerprint(star(spark, sf).transactions, _TXN_COLUMNS)


@query("pv2_manifest")
def _(spark, sf):
    from ledgerlens.operators.provenance import manifest

    return manifest(star(spark, sf).transactions.select(*_TXN_COLUMNS), SETTINGS, {"source": "driver tables"})


@query("pv2_manifest_data", oracle.tables(f"""SELECT '{__version__}' AS project_version, n_rows AS n_transactions, fingerprint AS data_fingerprint,
 sha256('{_CONFIG}') AS config_sha256 FROM ({_PRINT})"""))
def _(spark, sf):
    """The part of the manifest that does not depend on the machine."""
    from ledgerlens.operators.provenance import manifest

    made = manifest(star(spark, sf).transactions.select(*_TXN_COLUMNS), SETTINGS, {"source": "driver tables"})
    return made.select("project_version", "n_transactions", "data_fingerprint", "config_sha256")


# ============================================================================================== streaming
def _stream_star(spark, sf, days: int = 2):
    """The star cut at the last ``days`` days: (stored history, arriving rows)."""
    s = star(spark, sf)
    last = s.transactions.agg((F.max("ts_epoch") - days * DAY).alias("_cut"))
    marked = s.transactions.crossJoin(F.broadcast(last))
    return s, marked.where(F.col("ts_epoch") < F.col("_cut")).drop("_cut"), marked.where(F.col("ts_epoch") >= F.col("_cut")).drop("_cut")


def _fresh(spark, name: str) -> str:
    import uuid

    return f"{workspace(spark)}/{name}-{uuid.uuid4().hex}"


_ARRIVED = "ts_epoch >= (SELECT max(ts_epoch) - 172800 FROM txn)"


@query("st1_stream_scoring", oracle.scored(f"SELECT txn_id, {oracle.rounded(['cnt_24h', 'sum_7d', 'merch_prior_n', 'merch_fraud_rate_matured'])}, round(score_rules, 6) AS score_rules FROM s_ WHERE {_ARRIVED}",
                                          f"s_ AS (SELECT ds.*, 1.0 - {' * '.join(f'(CASE WHEN {oracle._hit(c)} THEN 1.0 - CAST({w} AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END)' for c, (_, w) in oracle.RULE_SQL.items())} AS score_rules FROM ds)"))
def _(spark, sf):
    """The last two days arrive as a file stream and are scored against the stored history."""
    from ledgerlens.streaming.scoring import start_scoring

    root = _fresh(spark, "st1")
    s, stored, arriving = _stream_star(spark, sf)
    stored.write.parquet(f"{root}/history/batch=-1")
    arriving.repartitionByRange(3, "ts_epoch").write.parquet(f"{root}/in")
    stream = spark.readStream.schema(arriving.schema).parquet(f"{root}/in")
    q = start_scoring(stream, f"{root}/history", s, SETTINGS, f"{root}/scored", f"{root}/bad", f"{root}/check", available_now=True)
    q.awaitTermination()
    cols = ["cnt_24h", "sum_7d", "merch_prior_n", "merch_fraud_rate_matured"]
    return rounded(rounded(spark.read.parquet(f"{root}/scored"), cols), ["score_rules"], 6).select("txn_id", *cols, "score_rules")


@query("st2_replay", oracle.features(f"SELECT txn_id, {oracle.rounded(FEATURES)} FROM f WHERE is_fraud = 1"))
def _(spark, sf):
    """Replays every fraud-labelled transaction from its own past."""
    from ledgerlens.streaming.scoring import replay

    s = star(spark, sf)
    ids = s.transactions.where(F.col("is_fraud") == 1).select("txn_id")
    return rounded(replay(s, ids, SETTINGS, lambda f: f), FEATURES).select("txn_id", *FEATURES)


_VEL = ["cnt_10m", "cnt_1h", "cnt_6h", "cnt_24h", "cnt_7d", "sum_1h", "sum_24h", "sum_7d", "small_cnt_30m", "online_cnt_1h",
        "distinct_merchants_24h"]


@query("st3_keyed_velocity", oracle.features(f"SELECT txn_id, {oracle.rounded(_VEL, 6)} FROM f"))
def _(spark, sf):
    """Velocity features of the whole stream from per-customer state."""
    from ledgerlens.streaming.velocity import velocity_stream

    root = _fresh(spark, "st3")
    t = star(spark, sf).transactions
    t.repartitionByRange(4, "ts_epoch").write.parquet(f"{root}/in")
    stream = spark.readStream.schema(t.schema).parquet(f"{root}/in")
    q = (velocity_stream(stream).writeStream.format("parquet").option("path", f"{root}/out")
         .option("checkpointLocation", f"{root}/check").outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    out = t.select("txn_id", "customer_id", "ts_epoch").join(spark.read.parquet(f"{root}/out"), ["customer_id", "ts_epoch"], "left")
    return rounded(out, _VEL, 6).select("txn_id", *_VEL)


@query("st4_stream_quarantine", oracle.with_ctes(_ODD + f", arr AS (SELECT * FROM odd WHERE {_ARRIVED})", """SELECT txn_id, array_to_string(list_filter([
 CASE WHEN device_id IS NOT NULL AND NOT (regexp_full_match(device_id, '[A-Za-z0-9_-]+') AND length(device_id) <= 32) THEN 'bad_device_id' END,
 CASE WHEN NOT (amount > 0 AND amount < 1e7) THEN 'bad_amount' END, CASE WHEN channel NOT IN ('card_present','online','atm') THEN 'bad_channel' END,
 CASE WHEN merchant_id NOT IN (SELECT merchant_id FROM merch) THEN 'unknown_merchant_id' END], lambda x : x IS NOT NULL), '|') AS r FROM arr""")
       .replace("SELECT txn_id, array_to_string(list_filter([\n CASE WHEN device_id IS NOT NULL", "SELECT txn_id, r AS reject_reasons FROM (SELECT txn_id, array_to_string(list_filter([\n CASE WHEN device_id IS NOT NULL") + ") WHERE r <> ''")
def _(spark, sf):
    """Defective rows of the stream end in the quarantine table with their reasons."""
    from ledgerlens.streaming.scoring import start_scoring

    root = _fresh(spark, "st4")
    s, stored, arriving = _stream_star(spark, sf)
    kind = F.col("txn_id") % 50
    odd = arriving.withColumns({
        "amount": F.when(kind == 0, -F.col("amount")).when(kind == 1, F.col("amount") * 1e8).otherwise(F.col("amount")),
        "channel": F.when(kind == 2, "wire").otherwise(F.col("channel")),
        "merchant_id": F.when(kind == 3, F.lit(999999)).otherwise(F.col("merchant_id")),
        "device_id": F.when(kind == 4, "x'; DROP TABLE t").otherwise(F.col("device_id"))})
    stored.write.parquet(f"{root}/history/batch=-1")
    odd.write.parquet(f"{root}/in")
    stream = spark.readStream.schema(arriving.schema).parquet(f"{root}/in")
    q = start_scoring(stream, f"{root}/history", s, SETTINGS, f"{root}/scored", f"{root}/bad", f"{root}/check", available_now=True)
    q.awaitTermination()
    return spark.read.parquet(f"{root}/bad").select("txn_id", F.concat_ws("|", "reject_reasons").alias("reject_reasons"))


@query("st5_windowed_volume", oracle.scored("""SELECT strftime(to_timestamp(start_s) AT TIME ZONE 'UTC', '%Y-%m-%d') AS start, n_txn, n_alerts FROM
 (SELECT (day//4)*4*86400 + (SELECT min(ts_epoch)//86400*86400 FROM txn) AS start_s, count(*) AS n_txn, count(CASE WHEN score_rules >= 0.35 THEN 1 END) AS n_alerts FROM s_ GROUP BY 1)
 WHERE start_s + 4*86400 <= (SELECT max(ts_epoch) FROM txn) - 86400""",
                                            f"s_ AS (SELECT ds.*, 1.0 - {' * '.join(f'(CASE WHEN {oracle._hit(c)} THEN 1.0 - CAST({w} AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END)' for c, (_, w) in oracle.RULE_SQL.items())} AS score_rules FROM ds)"))
def _(spark, sf):
    """Blocks of four days since the first day, each emitted when the watermark passes its end."""
    from ledgerlens.streaming.kpi import volume_stream

    root = _fresh(spark, "st5")
    rows = feature_table(spark, sf).select("txn_id", "ts", "ts_epoch", rules.rule_score().alias("score_rules"))
    rows.repartitionByRange(4, "ts_epoch").write.parquet(f"{root}/in")
    first = int(rows.agg(F.min("ts_epoch").alias("t")).first()["t"]) // DAY
    stream = spark.readStream.schema(rows.schema).parquet(f"{root}/in")
    q = (volume_stream(stream, alert(), SETTINGS.monitor_window_days, first).writeStream.format("parquet")
         .option("path", f"{root}/out").option("checkpointLocation", f"{root}/check").outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{root}/out").select(F.date_format("start", "yyyy-MM-dd").alias("start"), "n_txn", "n_alerts")


@query("st5_matured_kpi", oracle.scored(f"""SELECT day, count(*) AS n, count(CASE WHEN score_rules >= 0.35 THEN 1 END) AS alerts, CAST(sum(is_fraud) AS BIGINT) AS fraud,
 count(CASE WHEN score_rules >= 0.35 AND is_fraud = 1 THEN 1 END) AS caught FROM sc WHERE ts_epoch + 172800 <= (SELECT max(ts_epoch) FROM txn) GROUP BY day"""))
def _(spark, sf):
    from ledgerlens.streaming.kpi import matured_kpi

    s = star(spark, sf)
    as_of = s.transactions.agg(F.max("ts_epoch").alias("_as_of"))
    rows = scored(spark, sf).drop("is_fraud").crossJoin(F.broadcast(as_of))
    return matured_kpi(rows, s.transactions, alert(), F.col("_as_of"), DELAY * DAY, F.col("day"))


@query("st5_label_stream", oracle.scored(f"""SELECT day, count(*) AS n, count(CASE WHEN score_rules >= 0.35 THEN 1 END) AS alerts, CAST(sum(is_fraud) AS BIGINT) AS fraud,
 count(CASE WHEN score_rules >= 0.35 AND is_fraud = 1 THEN 1 END) AS caught, CAST(0 AS BIGINT) AS expired
 FROM sc WHERE ts_epoch + 172800 <= (SELECT max(ts_epoch) FROM txn) GROUP BY day"""))
def _(spark, sf):
    """Scores and labels as two streams in two runs: labels arrive days after their rows, many of them in the second run."""
    from ledgerlens.streaming.kpi import label_kpi, start_label_kpi

    root = _fresh(spark, "st5-labels")
    s = star(spark, sf)
    rows = scored(spark, sf).select("txn_id", "ts_epoch", "day", "score_rules")
    known = s.transactions.select("txn_id", "is_fraud", (F.col("ts_epoch") + DELAY * DAY).alias("label_epoch"))
    low, high = rows.agg(F.min("ts_epoch"), F.max("ts_epoch")).first()
    as_of = s.transactions.agg(F.max("ts_epoch")).first()[0]
    middle = (low + high) // 2
    for early in (True, False):
        for table, at, name in ((rows, "ts_epoch", "scores"), (known.where(F.col("label_epoch") <= as_of), "label_epoch", "labels")):
            table.where((F.col(at) < middle) == F.lit(early)).write.mode("append").parquet(f"{root}/{name}")
        arriving = [spark.readStream.schema(t.schema).parquet(f"{root}/{n}") for t, n in ((rows, "scores"), (known, "labels"))]
        start_label_kpi(*arriving, alert(), F.col("day"), DELAY * DAY, f"{root}/counts", f"{root}/check", available_now=True).awaitTermination()
    return label_kpi(spark, f"{root}/counts")
