"""Point-in-time features: each row sees only rows of its customer or merchant with an earlier second.

Plan shape: one shuffle by merchant on the narrow fact columns, the event-side lookups, then one shuffle by customer
under which the customer lookup and every customer and (customer, x) window run. Bounded windows are differences of growing sums, so a
row costs the same however many rows fall into its last week.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.config import DAY, Skew
from ledgerlens.functions.columns import (at_least, category_code, epoch_seconds, flag, flag_or_null, haversine_km,
                                          safe_div)
from ledgerlens.operators.skew import (HotKeys, attach_slab, before, find_hot_keys, partition_keys, running, slab_of,
                                       with_history, with_pair_carry)
from ledgerlens.schema import FEATURES
from ledgerlens.session import discard, materialize
from ledgerlens.sources.views import Star

# Shrinkage of the matured merchant fraud rate.
MERCHANT_PRIOR_RATE = 0.01
MERCHANT_PRIOR_WEIGHT = 200.0

# Spans of the velocity counts in seconds.
VELOCITY = {"10m": 600, "1h": 3600, "6h": 21_600, "24h": DAY, "7d": 7 * DAY}
FACT_COLUMNS = ["txn_id", "customer_id", "account_id", "merchant_id", "location_id", "ts_epoch", "amount", "channel",
                "device_id", "hour_local", "dow_local", "is_fraud"]
ROWS_PER_PARTITION = 50_000  # a customer task sorts its wide rows about ten times over
CUSTOMER_REACH = 7 * DAY  # seconds of the longest window of a customer
PAIR_DIMS = ["country", "merchant_id", "category", "channel", "hour_band", "device_key"]


@dataclass(frozen=True)
class HotSpots:
    """Hot customers and merchants of a transaction table (None = none)."""

    customers: HotKeys | None = None
    merchants: HotKeys | None = None


@dataclass(frozen=True)
class Older:
    """Totals of all rows before ``cut`` that are not among the rows at hand: per customer, per (customer, ``dim``, ``value``) and per merchant.

    ``cut`` is at least the longest window before the rows whose features are wanted.
    """

    customers: DataFrame
    pairs: DataFrame
    merchants: DataFrame
    cut: int


def _at_each_slab(totals: DataFrame, rows: DataFrame, key: str, hot: HotKeys | None) -> DataFrame:
    """Totals of a key for each slab that its rows are cut into."""
    if hot is None:
        return totals
    return totals.join(rows.select(key, "_slab_s", "_slab").distinct(), key)


def partitions_for(df: DataFrame, rows: int) -> int | None:
    """Partitions for windows over ``rows`` rows: what one task holds stays the same however many rows there are. None if one task may hold them all."""
    return None if rows <= ROWS_PER_PARTITION else max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_PER_PARTITION))


def _dealt(rows: DataFrame, parts: int | None, keys: list[str]) -> DataFrame:
    return rows.repartition(parts, *keys) if parts else rows


def merchant_reach(label_delay_days: int) -> int:
    return max(1, label_delay_days) * DAY


def find_hot_spots(transactions: DataFrame, label_delay_days: int, skew: Skew = Skew()) -> HotSpots:
    return HotSpots(find_hot_keys(transactions, "customer_id", skew.rows_per_task, CUSTOMER_REACH),
                    find_hot_keys(transactions, "merchant_id", skew.rows_per_task, merchant_reach(label_delay_days)))


def build_features(star: Star, label_delay_days: int, skew: Skew = Skew(), hot: HotSpots | None = None,
                   keep: list[str] | None = None) -> DataFrame:
    """``txn_id``, the columns named in ``keep`` and the 52 features, one row per transaction.

    ``keep`` may name any column of the transactions as well as ``category`` and ``segment``.
    """
    if label_delay_days < 1:
        raise ValueError("a label delay below one day would let a row see its own label")
    keep = keep or []
    hot = hot or find_hot_spots(star.transactions, label_delay_days, skew)
    extra = [c for c in keep if c in star.transactions.columns and c not in FACT_COLUMNS]
    rows = star.transactions.select(*FACT_COLUMNS, *extra)
    parts = partitions_for(rows, star.transactions.count())
    if hot.merchants or hot.customers:  # history rows read the rows they stand for several times over
        rows = facts = materialize(rows, "facts")
    rows = enrich_event(merchant_history(rows, label_delay_days, hot.merchants, parts=parts), star)
    if hot.customers:
        rows = events = materialize(rows, "events")
        discard(facts)
    rows = customer_history(rows, star, hot.customers, parts=parts)
    if hot.customers:
        discard(events)
    kept = [c for c in keep if c not in FEATURES]
    return rows.select("txn_id", *kept, *FEATURES)


# ------------------------------------------------------------------------------------------ merchant side
def merchant_history(rows: DataFrame, label_delay_days: int, hot: HotKeys | None, older: Older | None = None, parts: int | None = None) -> DataFrame:
    """Prior count and mean, short-term counts and the fraud rate over labels already mature at the row's time. The windows run in ``parts`` partitions."""
    delay = label_delay_days * DAY
    rows = attach_slab(rows, hot).withColumns({
        "_n": F.lit(1).cast("bigint"),
        "_labelled": flag(F.col("is_fraud").isNotNull()).cast("bigint"),
        "_fraud": F.coalesce(F.col("is_fraud"), F.lit(0)).cast("bigint")})
    series = with_history(rows, hot, merchant_reach(label_delay_days), ["_n", "amount", "_labelled", "_fraud"])
    if older is not None:
        totals = older.merchants.withColumns({"ts_epoch": F.lit(older.cut - 1).cast("bigint"), "_own": F.lit(False)})
        series = series.unionByName(_at_each_slab(totals, rows, "merchant_id", hot), allowMissingColumns=True)
    keys = partition_keys("merchant_id", hot)
    mature = before(keys, delay)
    series = _dealt(series, parts, keys).withColumns({
        **{f"_n_{lag}": running(F.col("_n"), before(keys, lag)) for lag in (1, 3601, DAY + 1)},
        "_amt_1": running(F.col("amount"), before(keys)),
        "_mature_fraud": running(F.col("_fraud"), mature), "_mature_n": running(F.col("_labelled"), mature)})
    n = F.col("_n_1")
    return series.where("_own").select(
        *[c for c in rows.columns if not c.startswith("_")],
        n.cast("double").alias("merch_prior_n"),
        safe_div(F.col("_amt_1"), n).alias("merch_prior_mean"),
        (n - F.col("_n_3601")).cast("double").alias("merch_cnt_1h"),
        (n - F.col(f"_n_{DAY + 1}")).cast("double").alias("merch_cnt_24h"),
        ((F.col("_mature_fraud") + MERCHANT_PRIOR_WEIGHT * MERCHANT_PRIOR_RATE)
         / (F.col("_mature_n") + MERCHANT_PRIOR_WEIGHT)).alias("merch_fraud_rate_matured"))


# ------------------------------------------------------------------------------------------- enrichment
def _epoch_of(table: DataFrame, name: str):
    return F.col(f"{name}_epoch") if f"{name}_epoch" in table.columns else epoch_seconds(F.col(f"{name}_at"))


def enrich_event(rows: DataFrame, star: Star) -> DataFrame:
    """Merchant, place and account of each transaction.

    Spark broadcasts a dimension only when its size allows; otherwise it shuffles and splits skewed keys.
    """
    merch = star.merchants.select("merchant_id", "category", F.col("is_online").alias("m_online"),
                                  _epoch_of(star.merchants, "onboarded").alias("onboarded_epoch"))
    place = star.locations.select("location_id", "lat", "lon", "country")
    acct = star.accounts.select("account_id", "account_type",
                                _epoch_of(star.accounts, "opened").alias("opened_epoch"))
    return (rows.join(merch, "merchant_id", "left").join(place, "location_id", "left")
            .join(acct, "account_id", "left"))


def enrich_customer(rows: DataFrame, star: Star) -> DataFrame:
    """Segment and home of the customer. Called on rows already partitioned by customer, a shuffled join moves only the
    dimension."""
    cust = star.customers.select("customer_id", "segment", "home_location_id")
    home = star.locations.select(F.col("location_id").alias("home_location_id"), F.col("lat").alias("home_lat"),
                                 F.col("lon").alias("home_lon"), F.col("country").alias("home_country"))
    return rows.join(cust, "customer_id", "left").join(home, "home_location_id", "left")


def enrich(rows: DataFrame, star: Star) -> DataFrame:
    """All N:1 lookups; the row count does not change while dimension keys are unique."""
    return enrich_customer(enrich_event(rows, star), star)


def row_features(d: DataFrame) -> DataFrame:
    """Features that need no customer history. They are computed below the windows: they replace the looked-up columns they
    come from, and keep the projection above the windows small enough for the JIT compiler."""
    amount, ts = F.col("amount"), F.col("ts_epoch")
    return d.withColumns({
        "log_amount": F.log1p(amount),
        "is_online": flag(F.col("channel") == "online"),
        "is_atm": flag(F.col("channel") == "atm"),
        "is_night": flag(F.col("hour_local") <= 5),
        "is_weekend": flag(F.col("dow_local") >= 5),
        "category_code": category_code(F.col("category")),
        "dist_from_home_km": haversine_km(F.col("home_lat"), F.col("home_lon"), F.col("lat"), F.col("lon")),
        "is_foreign": F.when(F.col("home_country").isNotNull(),
                             (~F.col("country").eqNullSafe(F.col("home_country"))).cast("double")),
        "amount_to_merch_mean": safe_div(amount, F.col("merch_prior_mean")),
        "merch_age_days": at_least((ts - F.col("onboarded_epoch")) / DAY, 0.0),
        "merch_is_online": F.col("m_online").cast("double"),
        "account_age_days": at_least((ts - F.col("opened_epoch")) / DAY, 0.0),
        "is_credit": F.when(F.col("account_type").isNotNull(),
                            (F.col("account_type") == "credit_card").cast("double"))})


# ------------------------------------------------------------------------------------------ customer side
def with_pair_values(rows: DataFrame) -> DataFrame:
    """Enriched rows with every column of ``PAIR_DIMS``."""
    return rows.withColumns({"hour_band": F.floor(F.col("hour_local") / 4), "device_key": F.coalesce(F.col("device_id"), F.lit(""))})


def customer_history(rows: DataFrame, star: Star, hot: HotKeys | None, older: Older | None = None, parts: int | None = None) -> DataFrame:
    """All features of enriched rows with the columns of ``merchant_history``. The windows run in ``parts`` partitions. With hot keys what comes before the last
    windows is stored, so that the result does not read ``rows`` again."""
    rows = attach_slab(with_pair_values(rows), hot)
    keys = partition_keys("customer_id", hot)
    slabs = rows
    rows = with_pair_carry(rows, hot, PAIR_DIMS)
    if older is not None:  # a pair's earlier rows stand as one row at the time of the last of them
        for d in PAIR_DIMS:
            pairs = older.pairs.where(F.col("dim") == d).select("customer_id", F.col("value").cast(slabs.schema[d].dataType).alias(d), F.col("n").alias(f"_w_{d}"),
                                                                F.col("last").alias("ts_epoch"), F.lit(False).alias("_own"))
            rows = rows.unionByName(_at_each_slab(pairs, slabs, "customer_id", hot), allowMissingColumns=True)
    rows = _dealt(rows, parts, keys) if parts else rows.repartition(*keys)
    rows = row_features(enrich_customer(rows, star))
    # Last time the same customer used the same merchant; same-second repeats are recognised by the id order.
    visits = Window.partitionBy(*keys, "merchant_id").orderBy("ts_epoch", "txn_id")
    rows = rows.withColumns({
        **{f"_seen_{d}": running(F.col(f"_w_{d}"), before([*keys, d])) for d in PAIR_DIMS},
        "_last_visit": F.last(F.when(F.col("_w_merchant_id") > 0, F.col("ts_epoch")), True)
        .over(visits.rowsBetween(Window.unboundedPreceding, -1))})
    rows = rows.where("_own").drop(*[f"_w_{d}" for d in PAIR_DIMS])
    totals = None
    if older is not None:
        totals = _at_each_slab(older.customers, slabs, "customer_id", hot).withColumns({"ts_epoch": F.lit(older.cut - 1).cast("bigint"), "_own": F.lit(False)})
    rows = _with_expiry_rows(rows, hot)
    return _customer_windows(rows if hot is None else materialize(rows, "visits"), hot, totals, parts)


def _with_expiry_rows(rows: DataFrame, hot: HotKeys | None) -> DataFrame:
    """Turns the distinct-merchant count into sums.

    A visit keeps its merchant active for 24 h. ``_enter`` counts visits from the moment they add a merchant that is
    not active any more through an earlier visit: the visit itself, or, when the previous visit is less than 24 h
    old, an extra row at the time the previous visit expires. ``_visit`` counts visits; those 24 h ago have expired.
    Distinct merchants in [t - 24 h, t) = entered before t - visited before t - 24 h.
    """
    first_in_second = F.col("_last_visit").isNull() | (F.col("_last_visit") < F.col("ts_epoch"))
    overlaps = first_in_second & (F.col("_last_visit") + DAY > F.col("ts_epoch"))
    rows = rows.withColumns({"_overlap": F.coalesce(overlaps, F.lit(False)),
                             "_visit": flag(first_in_second).cast("bigint")})
    rows = rows.withColumn("_extra", F.explode(F.when(F.col("_overlap"), F.array(F.lit(False), F.lit(True)))
                                               .otherwise(F.array(F.lit(False)))))
    real = ~F.col("_extra")
    rows = rows.withColumns({
        "ts_epoch": F.when(F.col("_extra"), F.col("_last_visit") + DAY).otherwise(F.col("ts_epoch")),
        "_enter": F.when(F.col("_extra"), 1).when(F.col("_overlap"), 0).otherwise(F.col("_visit")).cast("bigint"),
        "_visit": F.when(real, F.col("_visit")).otherwise(0).cast("bigint"),
        "_n": flag(real).cast("bigint"),
        "_own": real})
    return rows if hot is None else rows.withColumn("_slab", slab_of(F.col("ts_epoch")))


def _customer_windows(rows: DataFrame, hot: HotKeys | None, totals: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    real = F.col("_n") == 1
    amount, log_amount = F.col("amount"), F.col("log_amount")

    def on(condition):
        return flag(real & condition).cast("bigint")

    rows = rows.withColumns({
        "_amt": F.when(real, amount).otherwise(0.0),
        "_log": F.when(real, log_amount).otherwise(0.0),
        "_log2": F.when(real, log_amount * log_amount).otherwise(0.0),
        "_small": on(amount < 5.0), "_online": on(F.col("channel") == "online"), "_night": on(F.col("hour_local") <= 5),
        "_peak": F.when(real, amount), "_first": F.when(real, F.col("ts_epoch")),
        "_prev": F.when(real, F.struct("ts_epoch", "txn_id", "lat", "lon"))})
    series = with_history(rows, hot, CUSTOMER_REACH,
                          ["_n", "_enter", "_visit", "_amt", "_log", "_log2", "_small", "_online", "_night"],
                          ["_peak", "_prev"], ["_first"])
    if totals is not None:
        series = series.unionByName(totals, allowMissingColumns=True)
    keys = partition_keys("customer_id", hot)
    if hot is not None or totals is not None:  # a union has lost the partitions
        series = _dealt(series, parts, keys)
    past = before(keys)
    # Growing sums, once per (weight, lag); lag 1 = strictly earlier, lag w + 1 = more than w seconds earlier.
    lags = {"_n": [1, *[w + 1 for w in VELOCITY.values()]], "_amt": [1, 3601, DAY + 1, 7 * DAY + 1],
            "_small": [1, 1801], "_online": [1, 3601], "_enter": [1], "_visit": [DAY + 1],
            "_log": [1], "_log2": [1], "_night": [1]}
    sums = {f"{w}_{lag}": running(F.col(w), before(keys, lag)) for w, ls in lags.items() for lag in ls}
    series = series.withColumns({**sums, "cust_prior_max": F.max("_peak").over(past), "_before": F.max("_prev").over(past),
                                 "_since": F.min("_first").over(past)})

    def within(weight, span):
        return F.col(f"{weight}_1") - F.col(f"{weight}_{span + 1}")

    columns = {f"cnt_{name}": within("_n", span).cast("double") for name, span in VELOCITY.items()}
    for name in ("1h", "24h", "7d"):  # rounding removes the residue of the difference: equal windows, equal sums
        total = F.round(within("_amt", VELOCITY[name]), 6)
        columns[f"sum_{name}"] = F.when(within("_n", VELOCITY[name]) > 0, total).otherwise(0.0)
    out = series.where("_own").withColumns({
        **columns,
        "small_cnt_30m": within("_small", 1800).cast("double"),
        "online_cnt_1h": within("_online", 3600).cast("double"),
        "distinct_merchants_24h": (F.col("_enter_1") - F.col(f"_visit_{DAY + 1}")).cast("double"),
        "cust_prior_n": F.col("_n_1").cast("double")})
    return _derive(out)


def _derive(d: DataFrame) -> DataFrame:
    amount, ts, prior_n = F.col("amount"), F.col("ts_epoch"), F.col("cust_prior_n")
    mean_log = safe_div(F.col("_log_1"), prior_n)
    # Shared intermediate values, one projection below the features so that each is computed once.
    d = d.withColumns({
        "cust_prior_mean": safe_div(F.col("_amt_1"), prior_n),
        "_mean_log": mean_log,
        "_variance": safe_div(F.col("_log2_1"), prior_n) - mean_log * mean_log,
        "hours_since_last": (ts - F.col("_before.ts_epoch")) / 3600,
        "dist_from_last_km": haversine_km(F.col("_before.lat"), F.col("_before.lon"), F.col("lat"), F.col("lon")),
        "_days": at_least((ts - F.col("_since")) / DAY, 1.0)})
    d = d.withColumns({"_sd": at_least(F.sqrt(at_least(F.col("_variance"), 0.0)), 0.25),
                       "_daily": at_least(safe_div(prior_n, F.col("_days")), 0.05)})
    mean = F.col("cust_prior_mean")
    has_history, has_device = prior_n > 0, F.col("device_key") != ""

    def unseen(dim):
        return F.when(has_history, (F.col(f"_seen_{dim}") == 0).cast("double"))

    def share(dim):
        return safe_div(F.col(f"_seen_{dim}"), prior_n)

    columns = {
        "amount_to_mean": safe_div(amount, mean),
        "amount_to_max": safe_div(amount, F.col("cust_prior_max")),
        "amount_logz": F.when(prior_n >= 5, (F.col("log_amount") - F.col("_mean_log")) / F.col("_sd")),
        "amount_gt_prior_max": F.when(prior_n >= 5, flag_or_null(amount > F.col("cust_prior_max"))),
        "implied_speed_kmh": F.col("dist_from_last_km") / at_least(F.col("hours_since_last"), 1.0 / 60.0),
        "new_country": unseen("country"),
        "new_merchant_for_cust": unseen("merchant_id"),
        "new_category_for_cust": unseen("category"),
        "cust_channel_share": share("channel"),
        "cust_category_share": share("category"),
        "cust_hourband_share": share("hour_band"),
        "cust_night_share": safe_div(F.col("_night_1"), prior_n),
        "device_prior_cnt": F.when(has_device, F.col("_seen_device_key").cast("double")),
        "new_device": F.when(has_device & has_history, (F.col("_seen_device_key") == 0).cast("double")),
        "cnt_24h_vs_daily_rate": safe_div(F.col("cnt_24h"), F.col("_daily")),
    }
    return d.withColumns(columns)


# ------------------------------------------------------------------------------------- smaller customer series
def customer_series(transactions: DataFrame, columns: list[str], reach: int, skew: Skew = Skew(),
                    sums: dict | None = None) -> tuple[DataFrame, list[str]]:
    """Transactions with weights ``_n`` and ``sums``, ready for past windows over the returned keys."""
    hot = find_hot_keys(transactions, "customer_id", skew.rows_per_task, reach)
    rows = transactions.select(*columns).withColumns({"_n": F.lit(1).cast("bigint"), **(sums or {})})
    rows = attach_slab(rows, hot)
    return with_history(rows, hot, reach, ["_n", *(sums or {})]), partition_keys("customer_id", hot)
