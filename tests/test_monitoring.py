"""Drift, delayed labels, status summary, fingerprint and data quality."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.config import THIRTY_DAYS, Split
from ledgerlens.operators import drift, quality
from ledgerlens.operators.dataset import split_of
from ledgerlens.operators.provenance import fingerprint, manifest
from ledgerlens.plans.backtest import origins


def sample(spark, x):
    return spark.createDataFrame(pd.DataFrame({"x": x}).astype(object).where(lambda d: d.notna(), None), "x double")


def psi_of(spark, a, b):
    return drift.psi_table(sample(spark, a), sample(spark, b), ["x"]).first().psi


def test_psi(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=20000)
    assert psi_of(spark, a, rng.normal(size=20000)) < 0.02
    assert psi_of(spark, a, rng.normal(1.0, 1, 20000)) >= drift.PSI_ALERT
    gaps = np.r_[a, [np.nan] * 100]
    assert psi_of(spark, gaps, gaps) < 0.01
    assert psi_of(spark, [np.nan] * 5, a) is None and psi_of(spark, a, [np.nan] * 5) is None


def test_psi_hand_number(spark):
    """Two halves: reference 50/50, current 90/10."""
    ref, cur = [0.0] * 50 + [1.0] * 50, [0.0] * 90 + [1.0] * 10
    got = psi_of(spark, ref, cur)
    edges = np.unique(np.quantile(ref, np.linspace(0, 1, 11)[1:-1]))
    r = np.r_[np.bincount(np.searchsorted(edges, ref, side="right"), minlength=len(edges) + 1), 0] / 100
    c = np.r_[np.bincount(np.searchsorted(edges, cur, side="right"), minlength=len(edges) + 1), 0] / 100
    r, c = np.maximum(r, 1e-4), np.maximum(c, 1e-4)
    assert got == pytest.approx(((c - r) * np.log(c / r)).sum())


def _perf(spark, rows):
    return spark.createDataFrame(rows, "window int, labels_mature boolean, pr_auc double, recall double")


def _drift(spark, warn, alert, score="ok"):
    return spark.createDataFrame([(0, 0, 0, "ok", 0.01, ""), (1, warn, alert, score, 0.3, "x (0.30)")],
                                 "window int, n_features_warn long, n_features_alert long, score_status string, score_psi double, top_drifting_features string")


def test_summary_levels(spark):
    good = _perf(spark, [(0, True, 0.8, 0.7), (1, False, None, None)])
    assert drift.summarize(_drift(spark, 0, 0), good, 0.8, 0.7).first().status == "ok"
    assert drift.summarize(_drift(spark, 2, 0), good, 0.8, 0.7).first().status == "warn"
    assert drift.summarize(_drift(spark, 2, 1), good, 0.8, 0.7).first().status == "alert"
    worse = drift.summarize(_drift(spark, 0, 0), _perf(spark, [(0, True, 0.5, 0.7)]), 0.8, 0.7).first()
    assert worse.status == "alert" and "performance down" in worse.findings[0]
    slipping = drift.summarize(_drift(spark, 0, 0), _perf(spark, [(0, True, 0.65, 0.7)]), 0.8, 0.7).first()
    assert slipping.status == "warn"
    assert drift.summarize(_drift(spark, 0, 0), _perf(spark, [(0, False, None, None)]), 0.8, 0.7).first().findings == [
        "no material drift or performance degradation detected"]


def test_partial_blocks_are_skipped_and_labels_mature(spark):
    days = [d for d in range(10) for _ in range(20)]
    df = spark.createDataFrame(pd.DataFrame({"day": days, "p": np.tile(np.linspace(0, 1, 20), 10), "is_fraud": ([0] * 18 + [1, 1]) * 10}))
    perf = drift.delayed_performance(df, "p", 4, 0.9, 2).toPandas().sort_values("window")
    assert perf.window.tolist() == [0, 1]  # the third block has two of four days
    assert perf.labels_mature.tolist() == [True, True] and perf.recall.tolist() == [1.0, 1.0]
    assert drift.delayed_performance(df, "p", 4, 0.9, 3).toPandas().sort_values("window").labels_mature.tolist() == [True, False]


def test_split_leaves_label_gaps(spark):
    s = Split(label_delay_days=2, warmup_days=3, train_end_day=16, valid_end_day=22)
    got = spark.range(30).select("id", split_of(F.col("id"), s).alias("s")).toPandas().set_index("id").s
    assert got[2] is None and got[3] == "train" and got[13] == "train" and got[14] is None
    assert got[16] == "valid" and got[19] == "valid" and got[20] is None and got[22] == "test"


def test_origins_end_at_the_production_split():
    o = origins(Split(), 4, 30)
    assert o[-1] == Split() and [s.valid_end_day for s in o] == sorted(s.valid_end_day for s in o)
    assert all(s.train_end_day - s.label_delay_days > s.warmup_days + 30 for s in o)


def test_fingerprint(star):
    t = star.transactions
    a = fingerprint(t).first()
    assert fingerprint(t.orderBy(F.rand(3)).repartition(7)).first() == a
    changed = t.withColumn("amount", F.when(F.col("txn_id") == 5, F.col("amount") + 0.01).otherwise(F.col("amount")))
    assert fingerprint(changed).first().fingerprint != a.fingerprint
    doubled = t.unionByName(t.where("txn_id < 2"))
    assert fingerprint(doubled).first().fingerprint != a.fingerprint
    m = manifest(t, THIRTY_DAYS, {"x": 1}).first()
    assert m.n_transactions == a.n_rows and len(m.config_sha256) == 64


def test_quality_checks(spark, star):
    dup = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    assert quality.duplicate_keys(dup, "k").count() == 1
    with pytest.raises(ValueError):
        quality.require_unique(dup, "k")
    assert {r.foreign_key: r.orphans for r in quality.orphan_report(star).collect()}["customer_id"] == 0
    assert quality.foreign_accounts(star).first().mismatched == 0
    assert quality.banned_columns(spark.createDataFrame([(1, 2)], "a int, true_pattern int")) == ["true_pattern"]


def test_validation_reasons(star):
    t = star.transactions.join(star.merchants.select("merchant_id"), "merchant_id").select(*star.transactions.columns)
    assert quality.validate_rows(t, star).where(F.size("reject_reasons") > 0).count() == 0
    bad = t.limit(1).withColumns({"amount": F.lit(float("nan")), "channel": F.lit("wire"), "location_id": F.lit(77),
                                  "device_id": F.lit("a b")})
    assert quality.validate_rows(bad, star).first().reject_reasons == ["bad_device_id", "bad_amount", "bad_channel", "unknown_location_id"]


def test_time_order(spark):
    rows = [(1, 100, 5.0), (2, 50, 1.0), (3, 9000, -1.0)]
    r = quality.order_report(spark.createDataFrame(rows, "txn_id long, ts_epoch long, amount double")).first()
    assert (r.unordered, r.bad_amounts) == (1, 1)


def test_cube_equals_reports_over_rows(spark):
    """Counts kept per day give the report over all rows; a day given again replaces only itself, and reports read nothing but the cube."""
    import uuid

    from ledgerlens.operators.cube import DriftCube
    from ledgerlens.session import workspace

    rng = np.random.default_rng(5)
    n = 6000
    table = pd.DataFrame({"day": rng.integers(3, 15, n), "x": rng.normal(size=n), "y": rng.integers(0, 3, n).astype(float), "score": rng.random(n)})
    table.loc[table.day > 9, "x"] += 0.8
    table = table.astype(object)
    table.loc[rng.random(n) < 0.1, "y"] = None
    table.loc[rng.random(n) < 0.05, "score"] = None
    rows = spark.createDataFrame(table, "day int, x double, y double, score double")
    reference = rows.where("day < 8")
    folder = f"{workspace(spark)}/cube-{uuid.uuid4().hex}"
    cube = DriftCube(spark, folder, ["x", "y"], "score", 0.7)
    cube.start(reference)
    cube.add(rows.where("day <= 8"))
    cube.add(rows.where("day = 9").limit(20))  # an incomplete day that is given again below
    before = set(spark.read.parquet(f"{folder}/bins").where("day < 9").inputFiles())
    cube.add(rows.where("day >= 9"))
    files = spark.read.parquet(f"{folder}/bins").inputFiles()
    assert {f for f in files if int(f.split("day=")[1].split("/")[0]) < 9} == {f for f in before if int(f.split("day=")[1].split("/")[0]) < 9}
    got = cube.windowed_drift(4)
    want = drift.windowed_drift(rows, reference, ["x", "y"], "score", 4, 0.7)
    for g, w in zip(got.orderBy("window").collect(), want.orderBy("window").collect(), strict=True):
        assert g.asDict().keys() == w.asDict().keys()
        assert all(a == b or a == pytest.approx(b, abs=1e-9) for a, b in zip(g, w))
    assert got.count() == 3 and all(folder in f for f in got.inputFiles())
    last = drift.feature_drift(reference, rows.where("day >= 11"), ["x", "y"]).collect()
    assert [(r.feature, r.status, pytest.approx(r.psi)) for r in last] == [(r.feature, r.status, r.psi) for r in cube.latest_drift(4).collect()]
