"""Point-in-time features: strictly past, independent of the future, equal with and without slabs."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.config import DAY, Skew
from ledgerlens.operators.features import build_features, customer_series
from ledgerlens.operators.quality import last_cut, leakage_audit
from ledgerlens.schema import FEATURES


def to_frame(df):
    return df.toPandas().set_index("txn_id").sort_index()


@pytest.fixture(scope="module")
def base(star):
    return to_frame(build_features(star, 2))


def same(a, b, tolerance=1e-6):
    a, b = a.astype(float), b.astype(float)
    return bool((((a - b).abs() <= tolerance) | (a.isna() & b.isna())).all().all())


def test_one_row_per_transaction_in_feature_order(star, base):
    assert list(base.columns) == FEATURES and len(base) == star.transactions.count()
    assert not np.isinf(base.astype(float).to_numpy()).any()


def test_brute_force_counts(star, base):
    t = star.transactions.toPandas()
    for cust in t.customer_id.value_counts().index[:3]:
        rows = t[t.customer_id == cust]
        for r in rows.itertuples():
            past = rows[rows.ts_epoch < r.ts_epoch]
            f = base.loc[r.txn_id]
            assert f.cust_prior_n == len(past)
            for name, span in [("1h", 3600), ("24h", DAY), ("7d", 7 * DAY)]:
                recent = past[past.ts_epoch >= r.ts_epoch - span]
                assert f[f"cnt_{name}"] == len(recent)
                assert f[f"sum_{name}"] == pytest.approx(recent.amount.sum(), abs=1e-6)
            day = past[past.ts_epoch >= r.ts_epoch - DAY]
            assert f.distinct_merchants_24h == day.merchant_id.nunique()
            if len(past):
                assert f.cust_prior_max == past.amount.max()
                assert f.new_merchant_for_cust == float(r.merchant_id not in set(past.merchant_id))


def test_slabs_change_nothing(star, base):
    assert same(base, to_frame(build_features(star, 2, Skew(rows_per_task=4)))[FEATURES])


def hot_star(spark, star, seed=5, n=600):
    """One customer and one merchant hold most rows; many rows share a second."""
    rng = np.random.default_rng(seed)
    t0 = 1_704_067_200
    ts = np.sort(rng.integers(0, 5 * DAY, n) // 300 * 300) + t0
    pdf = pd.DataFrame({
        "txn_id": np.arange(n), "account_id": 1, "customer_id": np.where(rng.random(n) < 0.7, 1, rng.integers(2, 9, n)),
        "merchant_id": np.where(rng.random(n) < 0.6, 3, rng.integers(0, 10, n)), "location_id": rng.integers(0, 25, n).astype("int32"),
        "ts_epoch": ts, "amount": np.round(rng.gamma(1, 40, n) + 0.01, 2), "channel": rng.choice(["online", "atm", "card_present"], n),
        "device_id": rng.choice(["D1", "D2", "D3"], n), "hour_local": rng.integers(0, 24, n).astype("int32"),
        "dow_local": rng.integers(0, 7, n).astype("int32"), "is_fraud": rng.integers(0, 2, n).astype("int32")})
    pdf["account_id"] = pdf.customer_id
    return replace(star, transactions=spark.createDataFrame(pdf)), pdf


def test_hot_customer_and_merchant_with_ties(spark, star):
    s, pdf = hot_star(spark, star)
    plain = to_frame(build_features(s, 1))
    cut = to_frame(build_features(s, 1, Skew(rows_per_task=40)))
    assert same(plain, cut)
    r = pdf.merge(plain[["cust_prior_n", "distinct_merchants_24h", "merch_prior_n", "merch_fraud_rate_matured", "device_prior_cnt"]],
                  left_on="txn_id", right_index=True)
    for x in r.sample(60, random_state=1).itertuples():
        past = pdf[(pdf.customer_id == x.customer_id) & (pdf.ts_epoch < x.ts_epoch)]
        shop = pdf[(pdf.merchant_id == x.merchant_id) & (pdf.ts_epoch < x.ts_epoch)]
        known = pdf[(pdf.merchant_id == x.merchant_id) & (pdf.ts_epoch <= x.ts_epoch - DAY)]
        assert x.cust_prior_n == len(past) and x.merch_prior_n == len(shop)
        assert x.distinct_merchants_24h == past[past.ts_epoch >= x.ts_epoch - DAY].merchant_id.nunique()
        assert x.device_prior_cnt == (past.device_id == x.device_id).sum()
        assert x.merch_fraud_rate_matured == pytest.approx((known.is_fraud.sum() + 2) / (len(known) + 200))


@pytest.mark.parametrize("step", [300, 1])
def test_history_rows_do_not_outgrow_the_rows(spark, star, step):
    """However low the row limit: slabs far shorter than the window would each repeat the rows of all of it."""
    rows = spark.range(20_000).select(F.lit(7).alias("customer_id"), (F.col("id") * step).alias("ts_epoch"))
    series, keys = customer_series(rows, ["customer_id", "ts_epoch"], 7 * DAY // 300 * step, Skew(rows_per_task=20))
    counted = series.groupBy(F.col("_own")).count().collect()
    found = {r["_own"]: r["count"] for r in counted}
    assert keys == ["customer_id", "_slab"] and found[True] == 20_000 and 0 < found[False] <= 20_000
    assert series.select("_slab").distinct().count() > 5


def test_future_rows_change_nothing(star):
    assert leakage_audit(star, 2, last_cut(star.transactions)).count() == 0


def test_labels_matter_only_after_the_delay(spark, star):
    s, pdf = hot_star(spark, star, seed=9)
    target = pdf[pdf.merchant_id == 3].iloc[20]
    flipped = replace(s, transactions=s.transactions.withColumn("is_fraud", F.when(
        F.col("txn_id") == int(target.txn_id), 1 - F.col("is_fraud")).otherwise(F.col("is_fraud"))))
    a, b = to_frame(build_features(s, 1)), to_frame(build_features(flipped, 1))
    assert same(a.loc[[target.txn_id]], b.loc[[target.txn_id]])
    changed = (a.merch_fraud_rate_matured - b.merch_fraud_rate_matured).abs() > 1e-12
    ids = pdf[(pdf.merchant_id == 3) & (pdf.ts_epoch >= target.ts_epoch + DAY)].txn_id
    assert set(changed[changed].index) == set(ids) and len(ids)


def test_delay_of_zero_is_refused(star):
    with pytest.raises(ValueError):
        build_features(star, 0)


def test_missing_dimension_rows_stay_missing(star, base):
    unknown = star.transactions.join(star.merchants, "merchant_id", "left_anti").select("txn_id").toPandas().txn_id
    assert len(unknown) and base.loc[unknown, ["category_code", "merch_age_days", "merch_is_online"]].isna().all().all()


def test_two_shuffles_by_entity(star):
    """One exchange by merchant, one by customer; window sorts reuse them."""
    plan = build_features(star, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(merchant_id") == 1 and plan.count("hashpartitioning(customer_id") == 1
    assert "CartesianProduct" not in plan


def test_tasks_grow_in_number_not_in_size(spark, star, base, monkeypatch):
    from ledgerlens.operators import features

    monkeypatch.setattr(features, "ROWS_PER_PARTITION", 40)
    wanted = -(-star.transactions.count() // 40)
    built = build_features(star, 2)
    assert built.rdd.getNumPartitions() == wanted > spark.sparkContext.defaultParallelism
    assert same(base, to_frame(built)[FEATURES])
    audit = leakage_audit(star, 2, last_cut(star.transactions))
    assert audit.rdd.getNumPartitions() == wanted and audit.count() == 0
