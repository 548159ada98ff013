"""Table types, the feature list and other fixed values."""

from __future__ import annotations

# Merchant category dictionary (position = code; other names have no code).
CATEGORIES = ["grocery", "restaurant", "fuel", "retail", "electronics", "travel", "entertainment", "online_services",
              "gift_cards", "crypto_exchange", "utilities", "healthcare", "atm_cash"]
CHANNELS = ["card_present", "online", "atm"]

# Names of the feature columns, in output order.
FEATURES = [
    "amount", "log_amount", "is_online", "is_atm", "hour_local", "dow_local", "is_night", "is_weekend", "category_code",
    "cnt_10m", "cnt_1h", "cnt_6h", "cnt_24h", "cnt_7d", "sum_1h", "sum_24h", "sum_7d", "small_cnt_30m", "online_cnt_1h",
    "distinct_merchants_24h",
    "cust_prior_n", "cust_prior_mean", "cust_prior_max", "amount_to_mean", "amount_to_max", "amount_logz",
    "amount_gt_prior_max", "hours_since_last", "dist_from_last_km", "implied_speed_kmh", "dist_from_home_km",
    "is_foreign", "new_country", "new_merchant_for_cust", "new_category_for_cust", "cust_channel_share",
    "cust_category_share", "cust_hourband_share", "cust_night_share", "new_device", "device_prior_cnt",
    "cnt_24h_vs_daily_rate",
    "merch_prior_n", "merch_prior_mean", "amount_to_merch_mean", "merch_cnt_1h", "merch_cnt_24h", "merch_age_days",
    "merch_fraud_rate_matured", "merch_is_online",
    "account_age_days", "is_credit",
]

# Features that grow with calendar time by construction, left out of drift tests.
TREND_FEATURES = ["cust_prior_n", "merch_prior_n", "account_age_days", "merch_age_days", "device_prior_cnt",
                  "cust_prior_mean", "cust_prior_max", "merch_prior_mean", "merch_fraud_rate_matured"]

# Columns that carry ground truth and must never feed features or models.
BANNED_COLUMNS = ["true_pattern", "pattern", "is_fraud_true", "is_compromised"]


# Tables and column types as DDL text, accepted by ``spark.read.schema``.
TABLES = {
    "locations": ("location_id INT, city STRING, country STRING, lat DOUBLE, lon DOUBLE, "
                  "utc_offset DOUBLE, is_domestic INT"),
    "customers": ("customer_id STRING, segment STRING, age INT, home_location_id INT, "
                  "signup_date TIMESTAMP_NTZ, kyc_risk_rating STRING"),
    "accounts": ("account_id STRING, customer_id STRING, account_type STRING, opened_at TIMESTAMP_NTZ, "
                  "credit_limit DOUBLE"),
    "merchants": ("merchant_id STRING, name STRING, category STRING, location_id INT, is_online INT, "
                  "onboarded_at TIMESTAMP_NTZ"),
    "transactions": ("txn_id STRING, account_id STRING, customer_id STRING, merchant_id STRING, "
                  "location_id INT, ts TIMESTAMP_NTZ, txn_date STRING, hour_local INT, dow_local INT, "
                  "ts_epoch BIGINT, amount DOUBLE, channel STRING, device_id STRING, is_fraud INT"),
    "synthetic_truth": ("txn_id STRING, true_pattern STRING, is_fraud_true INT"),
    "synthetic_truth_merchants": ("merchant_id STRING, is_compromised BOOLEAN"),
}
# Names of the dimensions and their keys.
DIMENSIONS = ["customers", "accounts", "merchants", "locations"]
PRIMARY_KEYS = {"locations": "location_id", "customers": "customer_id", "accounts": "account_id",
                "merchants": "merchant_id", "transactions": "txn_id", "synthetic_truth": "txn_id",
                "synthetic_truth_merchants": "merchant_id"}
REASONS_TYPE = "array<struct<code:string,source:string,detail:string,contribution:double>>"
