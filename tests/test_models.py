"""Models: backtest folds, occlusion, calibration, unused labels, determinism."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from ledgerlens.config import THIRTY_DAYS, Cost, Split
from ledgerlens.operators.explain import FEATURE_GROUPS, drop_column, group_contributions
from ledgerlens.plans import training
from ledgerlens.plans.backtest import METRICS, origins, run_backtest

LIGHT = replace(THIRTY_DAYS, training=replace(THIRTY_DAYS.training, boosting_rounds=2, logistic_iterations=20, min_leaf_rows=5))


@pytest.fixture(scope="module")
def trained(data):
    return training.train_all(data, LIGHT, forest=False)


def test_origins():
    split = Split(label_delay_days=2, warmup_days=3, train_end_day=16, valid_end_day=22)
    found = origins(split, 4, 4, 4)
    assert [(s.train_end_day, s.valid_end_day) for s in found] == [(12, 18), (16, 22)] and found[-1] == split
    assert origins(split, 1, 4, 4) == [split] and origins(split, 4, 4, 40) == []


def test_backtest(data):
    folds, summary = run_backtest(data, replace(LIGHT, cost=Cost(review_cost=0.0, friction_cost=0.0)), step_days=4, test_days=6,
                                  min_train_days=4)
    rows = sorted(folds.collect(), key=lambda r: r.origin_day)
    assert [r.origin_day for r in rows] == [18, 22]
    for r in rows:
        assert r.first_train_day >= 3 and r.last_train_day < r.origin_day - 6 - 1 and r.first_test_day >= r.origin_day
        assert r.last_test_day < r.origin_day + 6 and 0 <= r.precision <= 1
        assert r.cost_saving_pct >= 0  # reviews are free here, so catching fraud can only save
    for m in summary.collect():
        values = [getattr(r, m.metric) for r in rows]
        assert m.min == min(values) and m.max == max(values) and m.mean == pytest.approx(sum(values) / len(values))
    assert {m.metric for m in summary.collect()} == set(METRICS)
    with pytest.raises(ValueError):
        run_backtest(data, LIGHT, min_train_days=400)


def test_a_row_at_the_baseline_has_no_contributions(trained, data):
    m = trained.model
    typical = data.limit(1).select("txn_id", *[F.lit(float(m.baseline[f])).alias(f) for f in m.features])
    row = group_contributions(m, typical, m.baseline).first()
    assert all(row[drop_column(g)] == pytest.approx(0) for g in FEATURE_GROUPS)


def test_platt_is_monotone(spark):
    rows = [(i / 200, int(i % 10 < i / 20)) for i in range(1, 200)]
    df = spark.createDataFrame(rows, "raw double, is_fraud int")
    platt = training.fit_platt(df, "raw")
    p = [r[0] for r in df.orderBy("raw").select(platt.predict(F.col("raw"))).collect()]
    assert platt.slope > 0 and p == sorted(p) and 0 < p[0] < p[-1] < 1


def test_same_seed_same_model_and_immature_labels_are_unused(trained, data):
    """Labels between the end of training and its maturity gap change nothing; neither does running again."""
    gap = F.col("split").isNull()
    assert data.where(gap).count() > 0
    flipped = data.withColumn("is_fraud", F.when(gap, 1 - F.col("is_fraud")).otherwise(F.col("is_fraud")))
    again = training.train_all(flipped, LIGHT, forest=False)
    assert (again.model.review, again.model.block, again.model.name) == (trained.model.review, trained.model.block, trained.model.name)
    both = trained.scored.select("txn_id", "p_model").join(again.scored.select("txn_id", F.col("p_model").alias("q")), "txn_id")
    assert both.where("p_model <> q").count() == 0 and both.count() == trained.scored.count()


def test_models_of_all_origins_are_fitted_side_by_side(data, monkeypatch):
    from threading import Barrier

    all_there = Barrier(4)

    def fit(name, rows, features, t, n_rows, fraud_rate):
        all_there.wait(60)
        return name, n_rows

    monkeypatch.setattr(training, "fit_candidate", fit)
    part = training.train_rows(data)
    n = part.facts["train"]["n_rows"]
    assert part.rows.rdd.getNumPartitions() == 1  # a small table is one task
    own = {"logistic_regression": ("logistic_regression", n), "boosted_trees": ("boosted_trees", n)}
    assert training.fit_candidates([part, part], ["amount"], LIGHT.training) == [own, own]


def test_training_rows_keep_every_core_busy(data, monkeypatch):
    monkeypatch.setattr(training, "ROWS_WORTH_A_TASK", 50)
    found = data.repartition(16)
    assert training.train_rows(found).rows.rdd.getNumPartitions() == min(8, training.train_rows(found).rows.count() // 50)
