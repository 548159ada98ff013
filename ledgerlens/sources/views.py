"""Canonical transaction tables over the driver's star schema (see FIXTURES.md, part C).

Real data comes in through :mod:`ledgerlens.sources.readers`; every operator takes these DataFrames only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.columns import epoch_seconds, flag
from ledgerlens.operators.arrivals import with_local_time
from ledgerlens.schema import CATEGORIES

EPOCH_2023 = 1_672_531_200

# Column types of the driver's tables: no footer read is needed to plan a query.
DRIVER_TABLES = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
                "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
                "l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
}


@dataclass(frozen=True)
class Star:
    """The fact table and its four dimensions."""

    transactions: DataFrame
    customers: DataFrame
    accounts: DataFrame
    merchants: DataFrame
    locations: DataFrame


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(DRIVER_TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    return (_table(spark, sf_dir, "nation")
            .join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(key.alias("location_id"), F.col("n_name").alias("city"), F.col("r_name").alias("country"),
                    ((key * 37) % 140 - 70).cast("double").alias("lat"),
                    ((key * 73) % 360 - 180).cast("double").alias("lon"),
                    (((key * 3) % 49).cast("double") / 2 - 12).alias("utc_offset"),
                    flag(F.col("n_regionkey") == 1).alias("is_domestic")))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("segment"),
        F.col("c_nationkey").alias("home_location_id"))


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("account_id"), F.col("c_custkey").alias("customer_id"),
        F.when(F.col("c_acctbal") >= 5000, "credit_card").otherwise("debit").alias("account_type"),
        (EPOCH_2023 + (F.col("c_custkey") % 700) * 86400).alias("opened_epoch"))


def merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    names = F.array(*[F.lit(c) for c in [*CATEGORIES, "other"]])
    return _table(spark, sf_dir, "supplier").select(
        key.alias("merchant_id"), F.col("s_name").alias("name"),
        F.element_at(names, (key % 14 + 1).cast("int")).alias("category"),
        F.col("s_nationkey").alias("location_id"), (key % 2).cast("int").alias("is_online"),
        (EPOCH_2023 + ((key * 7) % 500) * 86400).alias("onboarded_epoch"))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    events = _table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", k.alias("k"))
    home = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    t = (events.join(home, F.col("user_id") == F.col("c_custkey"), "left")
         .withColumn("location_id", F.when(F.col("event_id") % 5 == 0, F.col("k") % 25)
                     .otherwise(F.col("c_nationkey")).cast("int"))
         .withColumn("channel", F.when(F.col("event_type").isin("click", "view"), "online")
                     .when(F.col("event_type") == "error", "atm").otherwise("card_present")))
    return with_local_time(t, locations(spark, sf_dir)).select(
        F.col("event_id").alias("txn_id"), F.col("user_id").alias("account_id"),
        F.col("user_id").alias("customer_id"), F.col("k").cast("bigint").alias("merchant_id"), "location_id", "ts",
        "txn_date", "hour_local", "dow_local", "ts_epoch", F.col("value").alias("amount"), "channel",
        F.when(F.col("channel") == "online", F.concat(F.lit("D"), (F.col("k") % 7).cast("string"))).alias("device_id"),
        flag(((F.col("event_type") == "error") & (F.col("value") >= 60)) | (F.col("event_id") % 97 == 0))
        .alias("is_fraud"))


def star(spark: SparkSession, sf_dir: str) -> Star:
    return Star(transactions(spark, sf_dir), customers(spark, sf_dir), accounts(spark, sf_dir),
                merchants(spark, sf_dir), locations(spark, sf_dir))


def order_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as transactions: day-resolution times, so many ties per customer."""
    return _table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("txn_id"), F.col("o_custkey").alias("customer_id"),
        epoch_seconds("o_orderdate").alias("ts_epoch"), F.col("o_totalprice").alias("amount"))


def sales_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as transactions of their supplier; the largest table, for volume aggregations."""
    return _table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("merchant_id"), F.col("l_extendedprice").alias("amount"),
        flag(F.col("l_returnflag") == "R").alias("is_fraud"),
        F.when(F.col("l_linestatus") == "O", "online").otherwise("card_present").alias("channel"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("txn_date"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in ground truth for diagnostics: large errors are fraud, and a few frauds were never reported."""
    cash_out = (F.col("event_type") == "error") & (F.col("value") >= 60)
    hidden = F.col("event_id") % 89 == 0
    return _table(spark, sf_dir, "events").select(
        F.col("event_id").alias("txn_id"),
        F.when(cash_out, "cash_out").when(hidden, "hidden").alias("true_pattern"),
        flag(cash_out | hidden).alias("is_fraud_true"))
