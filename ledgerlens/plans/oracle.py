"""DuckDB statements that compute, independently of Spark, what each registered query must return.

Written straightforwardly (per-row window frames, plain joins), with the canonical tables as leading CTEs.
"""

from __future__ import annotations

from ledgerlens.operators.evaluation import quantile_grid
from ledgerlens.schema import FEATURES, TREND_FEATURES

CATEGORY_NAMES = ("grocery,restaurant,fuel,retail,electronics,travel,entertainment,online_services,gift_cards,"
                  "crypto_exchange,utilities,healthcare,atm_cash,other")

TABLE_CTES = f"""
loc AS (SELECT n_nationkey AS location_id, n_name AS city, r_name AS country,
  CAST((n_nationkey*37)%140 - 70 AS DOUBLE) AS lat, CAST((n_nationkey*73)%360 - 180 AS DOUBLE) AS lon,
  CAST((n_nationkey*3)%49 AS DOUBLE)/2 - 12 AS utc_offset, CASE WHEN n_regionkey=1 THEN 1 ELSE 0 END AS is_domestic
  FROM nation JOIN region ON n_regionkey = r_regionkey),
cust AS (SELECT c_custkey AS customer_id, c_mktsegment AS segment, c_nationkey AS home_location_id FROM customer),
acct AS (SELECT c_custkey AS account_id, c_custkey AS customer_id,
  CASE WHEN c_acctbal >= 5000 THEN 'credit_card' ELSE 'debit' END AS account_type,
  1672531200 + (c_custkey%700)*86400 AS opened_epoch FROM customer),
merch AS (SELECT s_suppkey AS merchant_id, s_name AS name,
  split_part('{CATEGORY_NAMES}', ',', CAST(s_suppkey%14 + 1 AS INT)) AS category, s_nationkey AS location_id,
  CAST(s_suppkey%2 AS INT) AS is_online, 1672531200 + ((s_suppkey*7)%500)*86400 AS onboarded_epoch FROM supplier),
ev AS (SELECT event_id, user_id, event_type, value, ts, CAST(floor(epoch(ts)) AS BIGINT) AS ts_epoch,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
  CASE WHEN event_type IN ('click','view') THEN 'online' WHEN event_type='error' THEN 'atm' ELSE 'card_present' END AS channel
  FROM events),
ev2 AS (SELECT ev.*, CAST(CASE WHEN event_id%5=0 THEN k%25 ELSE c_nationkey END AS INT) AS location_id
  FROM ev LEFT JOIN customer ON user_id = c_custkey),
txn AS (SELECT event_id AS txn_id, user_id AS account_id, user_id AS customer_id, CAST(k AS BIGINT) AS merchant_id,
  ev2.location_id, ts, CAST(CAST(ts AS DATE) AS VARCHAR) AS txn_date,
  CAST(CAST(floor((ts_epoch + utc_offset*3600)/3600) AS BIGINT)%24 AS INT) AS hour_local,
  CAST((CAST(floor((ts_epoch + utc_offset*3600)/86400) AS BIGINT)+3)%7 AS INT) AS dow_local,
  ts_epoch, value AS amount, channel, CASE WHEN channel='online' THEN 'D'||CAST(k%7 AS VARCHAR) END AS device_id,
  CAST(CASE WHEN (event_type='error' AND value>=60) OR event_id%97=0 THEN 1 ELSE 0 END AS INT) AS is_fraud
  FROM ev2 LEFT JOIN loc ON ev2.location_id = loc.location_id),
truth AS (SELECT event_id AS txn_id,
  CASE WHEN event_type='error' AND value>=60 THEN 'cash_out' WHEN event_id%89=0 THEN 'hidden' END AS true_pattern,
  CAST(CASE WHEN (event_type='error' AND value>=60) OR event_id%89=0 THEN 1 ELSE 0 END AS INT) AS is_fraud_true FROM events),
sales AS (SELECT l_suppkey AS merchant_id, l_extendedprice AS amount, CAST(CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END AS INT) AS is_fraud,
  CASE WHEN l_linestatus='O' THEN 'online' ELSE 'card_present' END AS channel, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS txn_date
  FROM lineitem)"""


def _over(part: str, low: str, high: str = "1 PRECEDING") -> str:
    return f"OVER (PARTITION BY {part} ORDER BY ts_epoch RANGE BETWEEN {low} PRECEDING AND {high})"


def _past(part: str) -> str:
    return _over(part, "UNBOUNDED")


def _km(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (f"2*6371.0088*asin(sqrt(least(1.0, greatest(0.0, pow(sin((radians({lat2})-radians({lat1}))/2),2)"
            f" + cos(radians({lat1}))*cos(radians({lat2}))*pow(sin(radians({lon2}-{lon1})/2),2)))))")


_C = "customer_id"
_WINDOWS = {
    **{f"cnt_{n}": f"count(*) {_over(_C, s)}" for n, s in
       [("10m", "600"), ("1h", "3600"), ("6h", "21600"), ("24h", "86400"), ("7d", "604800")]},
    **{f"sum_{n}": f"coalesce(sum(amount) {_over(_C, s)}, 0)" for n, s in
       [("1h", "3600"), ("24h", "86400"), ("7d", "604800")]},
    "small_cnt_30m": f"count(*) FILTER (WHERE amount < 5) {_over(_C, '1800')}",
    "online_cnt_1h": f"count(*) FILTER (WHERE channel = 'online') {_over(_C, '3600')}",
    "distinct_merchants_24h": f"count(DISTINCT merchant_id) {_over(_C, '86400')}",
    "cust_prior_n": f"count(*) {_past(_C)}",
    "cust_prior_mean": f"avg(amount) {_past(_C)}",
    "cust_prior_max": f"max(amount) {_past(_C)}",
    "mean_log": f"avg(ln(1+amount)) {_past(_C)}",
    "mean_log2": f"avg(ln(1+amount)*ln(1+amount)) {_past(_C)}",
    "prev": f"max({{'t': ts_epoch, 'i': txn_id, 'lat': lat, 'lon': lon}}) {_past(_C)}",
    "first_ts": f"min(ts_epoch) {_past(_C)}",
    "nights": f"count(*) FILTER (WHERE hour_local <= 5) {_past(_C)}",
    **{f"seen_{d}": f"count(*) {_past(f'{_C}, {x}')}" for d, x in
       [("country", "country"), ("merchant", "merchant_id"), ("category", "category"), ("channel", "channel"),
        ("band", "hour_local//4"), ("device", "device_id")]},
    "merch_prior_n": f"count(*) {_past('merchant_id')}",
    "merch_prior_mean": f"avg(amount) {_past('merchant_id')}",
    "merch_cnt_1h": f"count(*) {_over('merchant_id', '3600')}",
    "merch_cnt_24h": f"count(*) {_over('merchant_id', '86400')}",
}


def feature_ctes(txn: str = "txn", delay_days: int = 2, suffix: str = "") -> str:
    delay = delay_days * 86400
    mature = _over("merchant_id", "UNBOUNDED", f"{delay} PRECEDING")
    windows = ",\n  ".join(f"{sql} AS {name}" for name, sql in _WINDOWS.items())
    cats = CATEGORY_NAMES.rsplit(",", 1)[0]
    return f"""
e{suffix} AS (SELECT t.*, m.category, m.is_online AS m_online, m.onboarded_epoch, l.lat, l.lon, l.country, c.segment,
  c.home_location_id, h.lat AS home_lat, h.lon AS home_lon, h.country AS home_country, a.account_type, a.opened_epoch
  FROM {txn} t LEFT JOIN merch m ON t.merchant_id = m.merchant_id LEFT JOIN loc l ON t.location_id = l.location_id
  LEFT JOIN cust c ON t.customer_id = c.customer_id LEFT JOIN loc h ON c.home_location_id = h.location_id
  LEFT JOIN acct a ON t.account_id = a.account_id),
w{suffix} AS (SELECT e{suffix}.*, {windows},
  (coalesce(sum(is_fraud) {mature}, 0) + 2.0) / (count(is_fraud) {mature} + 200.0) AS merch_fraud_rate_matured
  FROM e{suffix}),
f{suffix} AS (SELECT txn_id, customer_id, merchant_id, account_id, ts_epoch, channel, is_fraud, ts, category, segment,
  amount, ln(1+amount) AS log_amount, CASE WHEN channel='online' THEN 1 ELSE 0 END AS is_online,
  CASE WHEN channel='atm' THEN 1 ELSE 0 END AS is_atm, hour_local, dow_local,
  CASE WHEN hour_local<=5 THEN 1 ELSE 0 END AS is_night, CASE WHEN dow_local>=5 THEN 1 ELSE 0 END AS is_weekend,
  CAST(nullif(coalesce(list_position(string_split('{cats}', ','), category), 0), 0) - 1 AS DOUBLE) AS category_code,
  {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in ["cnt_10m", "cnt_1h", "cnt_6h", "cnt_24h", "cnt_7d"])},
  sum_1h, sum_24h, sum_7d,
  {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in ["small_cnt_30m", "online_cnt_1h", "distinct_merchants_24h", "cust_prior_n"])},
  cust_prior_mean, cust_prior_max, amount / cust_prior_mean AS amount_to_mean, amount / cust_prior_max AS amount_to_max,
  CASE WHEN cust_prior_n >= 5 THEN (ln(1+amount) - mean_log) / greatest(sqrt(greatest(mean_log2 - mean_log*mean_log, 0)), 0.25) END AS amount_logz,
  CASE WHEN cust_prior_n >= 5 THEN CAST(amount > cust_prior_max AS DOUBLE) END AS amount_gt_prior_max,
  (ts_epoch - prev.t) / 3600.0 AS hours_since_last,
  CASE WHEN prev.t IS NOT NULL THEN {_km("prev.lat", "prev.lon", "lat", "lon")} END AS dist_from_last_km,
  CASE WHEN prev.t IS NOT NULL THEN {_km("prev.lat", "prev.lon", "lat", "lon")} / greatest((ts_epoch - prev.t) / 3600.0, CAST(1 AS DOUBLE)/60) END AS implied_speed_kmh,
  CASE WHEN home_lat IS NOT NULL AND lat IS NOT NULL THEN {_km("home_lat", "home_lon", "lat", "lon")} END AS dist_from_home_km,
  CASE WHEN home_country IS NOT NULL THEN CAST(country IS DISTINCT FROM home_country AS DOUBLE) END AS is_foreign,
  {", ".join(f"CASE WHEN cust_prior_n > 0 THEN CAST(seen_{s} = 0 AS DOUBLE) END AS {n}" for n, s in
             [("new_country", "country"), ("new_merchant_for_cust", "merchant"), ("new_category_for_cust", "category")])},
  {", ".join(f"seen_{s} / CAST(nullif(cust_prior_n, 0) AS DOUBLE) AS {n}" for n, s in
             [("cust_channel_share", "channel"), ("cust_category_share", "category"), ("cust_hourband_share", "band")])},
  nights / CAST(nullif(cust_prior_n, 0) AS DOUBLE) AS cust_night_share,
  CASE WHEN device_id IS NOT NULL AND cust_prior_n > 0 THEN CAST(seen_device = 0 AS DOUBLE) END AS new_device,
  CASE WHEN device_id IS NOT NULL THEN CAST(seen_device AS DOUBLE) END AS device_prior_cnt,
  CASE WHEN cust_prior_n > 0 THEN cnt_24h / greatest(cust_prior_n / greatest((ts_epoch - first_ts) / 86400.0, 1.0), 0.05) END AS cnt_24h_vs_daily_rate,
  CAST(merch_prior_n AS DOUBLE) AS merch_prior_n, merch_prior_mean, amount / merch_prior_mean AS amount_to_merch_mean,
  CAST(merch_cnt_1h AS DOUBLE) AS merch_cnt_1h, CAST(merch_cnt_24h AS DOUBLE) AS merch_cnt_24h,
  CASE WHEN onboarded_epoch IS NOT NULL THEN greatest((ts_epoch - onboarded_epoch) / 86400.0, 0.0) END AS merch_age_days,
  merch_fraud_rate_matured, CAST(m_online AS DOUBLE) AS merch_is_online,
  CASE WHEN opened_epoch IS NOT NULL THEN greatest((ts_epoch - opened_epoch) / 86400.0, 0.0) END AS account_age_days,
  CASE WHEN account_type IS NOT NULL THEN CAST(account_type = 'credit_card' AS DOUBLE) END AS is_credit
  FROM w{suffix})"""


RULE_SQL = {
    "R01_VELOCITY_1H": ("cnt_1h >= 4", 0.55),
    "R02_CARD_TESTING": ("small_cnt_30m >= 3", 0.70),
    "R03_AMOUNT_SPIKE": ("cust_prior_n >= 10 AND amount_to_mean >= 5 AND amount >= 100", 0.35),
    "R04_IMPOSSIBLE_TRAVEL": ("dist_from_last_km >= 500 AND implied_speed_kmh >= 900", 0.60),
    "R05_NEW_DEVICE_LARGE": ("new_device = 1 AND amount_to_mean >= 3", 0.45),
    "R06_RISKY_MERCHANT": ("merch_fraud_rate_matured >= 0.05", 0.30),
    "R07_UNUSUAL_NIGHT": ("is_night = 1 AND cust_night_share < 0.05 AND cust_prior_n >= 10 AND amount >= 50", 0.20),
    "R08_FOREIGN_ONLINE_NEW_COUNTRY": ("is_foreign = 1 AND is_online = 1 AND new_country = 1", 0.35),
    "R09_NEW_DEVICE_RISKY_CATEGORY": ("new_device = 1 AND category_code IN (8, 9, 4)", 0.40),
}
_Z = {"amount_logz": "amount_logz", "cnt_1h": "ln(1+cnt_1h)", "cnt_24h_vs_daily_rate": "ln(1+cnt_24h_vs_daily_rate)",
      "dist_from_home_km": "ln(1+dist_from_home_km)", "implied_speed_kmh": "ln(1+implied_speed_kmh)",
      "small_cnt_30m": "ln(1+small_cnt_30m)", "amount_to_merch_mean": "ln(1+amount_to_merch_mean)"}
REVIEW, BLOCK = 0.35, 0.6


def _hit(code: str) -> str:
    return f"coalesce({RULE_SQL[code][0]}, false)"


def _bucket(x: str, edges: list[float], labels: list[str]) -> str:
    parts = [f"WHEN {x} <= {edges[0]} THEN NULL"] + [f"WHEN {x} <= {hi} THEN '{label}'" for label, hi in zip(labels, edges[1:])]
    return f"CASE {' '.join(parts)} END"


AMOUNT_BUCKET = _bucket("amount", [0, 25, 100, 500, "CAST('inf' AS DOUBLE)"], ["<25", "25-100", "100-500", "500+"])
HISTORY_BUCKET = _bucket("coalesce(cust_prior_n, 0)", [-1, 9, 49, "CAST('inf' AS DOUBLE)"],
                         ["new (<10 txns)", "established (10-49)", "mature (50+)"])
DATASET_CTES = f"""
d AS (SELECT f.*, CAST((ts_epoch - (SELECT min(ts_epoch)//86400*86400 FROM txn))//86400 AS INT) AS day FROM f),
ds AS (SELECT *, CASE WHEN day >= 3 AND day < 14 THEN 'train' WHEN day >= 16 AND day < 20 THEN 'valid'
  WHEN day >= 22 THEN 'test' END AS split FROM d),
zl AS ({" UNION ALL ".join(f"SELECT '{k}' AS feature, {v} AS x FROM ds WHERE split = 'train'" for k, v in _Z.items())}),
zm AS (SELECT feature, median(x) AS center FROM zl WHERE x IS NOT NULL GROUP BY feature),
zp AS (SELECT feature, any_value(center) AS center,
  CASE WHEN median(abs(x-center)) < 1e-9 THEN greatest(avg(abs(x-center))/1.2533, stddev_samp(x), 1e-3)
    ELSE 1.4826*median(abs(x-center)) END AS scale FROM zl JOIN zm USING (feature) WHERE x IS NOT NULL GROUP BY feature),
z AS (SELECT txn_id, list_sort([{", ".join(
    f"greatest(coalesce(greatest(-50.0, least(50.0, ({v} - (SELECT center FROM zp WHERE feature='{k}')) / (SELECT scale FROM zp WHERE feature='{k}'))), 0.0), 0.0)"
    for k, v in _Z.items())}], 'DESC') AS zs FROM ds WHERE split IN ('valid','test')),
s AS (SELECT ds.*, 1.0 - {" * ".join(f"(CASE WHEN {_hit(c)} THEN 1.0 - CAST({w} AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END)" for c, (_, w) in RULE_SQL.items())} AS score_rules,
  list_filter([{", ".join(f"CASE WHEN {_hit(c)} THEN '{c}' END" for c in RULE_SQL)}], lambda x : x IS NOT NULL) AS rule_hits,
  round((zs[1] + zs[2]) / 2, 9) AS score_z, {AMOUNT_BUCKET} AS amount_bucket, {HISTORY_BUCKET} AS history
  FROM ds JOIN z USING (txn_id)),
sc AS (SELECT s.*, CASE WHEN score_rules >= {BLOCK} THEN 'block' WHEN score_rules >= {REVIEW} THEN 'review' ELSE 'allow' END AS band,
  score_rules >= {REVIEW} AS alert FROM s),
te AS (SELECT * FROM sc WHERE split = 'test'), va AS (SELECT * FROM sc WHERE split = 'valid'),
tr AS (SELECT * FROM ds WHERE split = 'train')"""


def tables(body: str) -> str:
    return f"WITH {TABLE_CTES} {body}"


def with_ctes(ctes: str, body: str) -> str:
    return f"WITH {TABLE_CTES}, {ctes} {body}"


def features(body: str) -> str:
    return f"WITH {TABLE_CTES}, {feature_ctes()} {body}"


def scored(body: str, ctes: str = "") -> str:
    return f"WITH {TABLE_CTES}, {feature_ctes()}, {DATASET_CTES}{', ' + ctes if ctes else ''} {body}"


# Distances, speeds and logs are irrational, so few digits suffice; exact fractions need enough digits to avoid ties.
FEATURE_DIGITS = {"dist_from_last_km": 4, "implied_speed_kmh": 4, "dist_from_home_km": 4, "amount_logz": 6, "log_amount": 6,
                  "cnt_24h_vs_daily_rate": 6}


def digits_of(column: str) -> int:
    return FEATURE_DIGITS.get(column, 9)


def rounded(columns: list[str], digits: int | None = None) -> str:
    return ", ".join(f"round(CAST({c} AS DOUBLE), {digits or digits_of(c)}) AS {c}" for c in columns)


def ranking(source: str, score: str, by: str = "", where: str = "") -> str:
    """CTEs g/c/rk: average precision and ROC-AUC from tie groups."""
    part = f"PARTITION BY {by}" if by else ""
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""
g AS (SELECT {keys}{score} AS score, count(*) AS n, sum(is_fraud) AS pos FROM {source} {where} GROUP BY {keys}{score}),
c AS (SELECT *, sum(n) OVER ({part} ORDER BY score DESC) AS alerts, sum(pos) OVER ({part} ORDER BY score DESC) AS tp,
  sum(pos) OVER ({part}) AS p, sum(n) OVER ({part}) AS total FROM g),
rk AS (SELECT {keys}CAST(max(total) AS BIGINT) AS n, CAST(max(p) AS BIGINT) AS n_fraud,
  CASE WHEN max(p) > 0 AND max(p) < max(total) THEN sum(CAST(pos AS DOUBLE) / p * tp / alerts) END AS pr_auc,
  CASE WHEN max(p) > 0 AND max(p) < max(total) THEN sum(CAST(n - pos AS DOUBLE) * (tp - pos / 2.0)) / max(p) / (max(total) - max(p)) END AS roc_auc,
  CAST(max(p) AS DOUBLE) / max(total) AS base_rate FROM c {group})"""


def psi_ctes(features_: list[str], ref: str, cur: str, by: str = "") -> str:
    """CTEs ed/rb/cb/ps: population stability index per feature (and block)."""
    keys = f"{by}, " if by else ""
    ref_long = " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS x FROM {ref}" for f in features_)
    cur_long = " UNION ALL ".join(f"SELECT {keys}'{f}' AS feature, CAST({f} AS DOUBLE) AS x FROM {cur}" for f in features_)
    probs = ", ".join(str(i / 10) for i in range(1, 10))
    bin_ = "CASE WHEN x IS NULL THEN -1 ELSE len(list_filter(edges, lambda q : q <= x)) END"
    of = "PARTITION BY " + ", ".join(f"gr.{k}" for k in [*by.split(", "), "feature"] if k)
    match = " AND ".join(f"gr.{k} = cb.{k}" for k in [*by.split(", "), "feature", "bin"] if k)
    out = ", ".join(f"gr.{k}" for k in [*by.split(", "), "feature"] if k)
    return f"""
rl AS ({ref_long}), cl AS ({cur_long}),
ed AS (SELECT feature, list_sort(list_distinct(quantile_cont(x, [{probs}]))) AS edges FROM rl WHERE x IS NOT NULL GROUP BY feature),
rb AS (SELECT feature, {bin_} AS bin, count(*) AS n FROM rl JOIN ed USING (feature) GROUP BY ALL),
cb AS (SELECT {keys}feature, {bin_} AS bin, count(*) AS n FROM cl JOIN ed USING (feature) GROUP BY ALL),
gr AS (SELECT DISTINCT {keys}cb.feature, unnest(range(-1, len(edges) + 1)) AS bin FROM cb JOIN ed USING (feature)),
pp AS (SELECT {out}, greatest(coalesce(rb.n, 0) / CAST(sum(rb.n) OVER ({of}) AS DOUBLE), 1e-4) AS r,
  greatest(coalesce(cb.n, 0) / CAST(sum(cb.n) OVER ({of}) AS DOUBLE), 1e-4) AS c
  FROM gr LEFT JOIN rb ON gr.feature = rb.feature AND gr.bin = rb.bin LEFT JOIN cb ON {match}),
ps AS (SELECT {keys}feature, sum((c - r) * ln(c / r)) AS psi FROM pp GROUP BY {keys}feature)"""


STATUS = "CASE WHEN psi >= 0.25 THEN 'alert' WHEN psi >= 0.10 THEN 'warn' ELSE 'ok' END"
DRIFT_FEATURES = [f for f in FEATURES if f not in TREND_FEATURES]


def grid_sql(low: float, high: float, points: int) -> str:
    return "[" + ", ".join(repr(p) for p in quantile_grid(low, high, points)) + "]"
