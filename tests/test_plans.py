"""Sources, SQL runner, training, reasons, backtest and the end-to-end run."""

import re
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.config import THIRTY_DAYS, AnalyticsParams, Skew
from ledgerlens.operators import evaluation
from ledgerlens.operators.anomaly import fit_forest, forest_score
from ledgerlens.plans import analytics, report, training
from ledgerlens.schema import FEATURES
from ledgerlens.session import materialize, workspace
from ledgerlens.sources import readers, writers

LIGHT = replace(THIRTY_DAYS, training=replace(THIRTY_DAYS.training, boosting_rounds=5, forest_trees=20, logistic_iterations=40,
                                              min_leaf_rows=5))


@pytest.fixture(scope="module")
def trained(data):
    return training.train_all(data, LIGHT)


def test_materialize_keeps_rows_and_types(spark):
    df = spark.range(10).withColumn("x", F.array(F.col("id")))
    again = materialize(df, "x")
    assert again.dtypes == df.dtypes and again.count() == 10 and workspace(spark)


def test_star_roundtrip_prunes_partitions(spark, star):
    root = f"{workspace(spark)}/star"
    writers.write_star(star, root)
    df = spark.read.parquet(f"{root}/transactions").where("txn_date = '2024-01-05'")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(txn_date" in plan
    assert df.count() == star.transactions.where("txn_date = '2024-01-05'").count()


def test_declared_schemas_read_back(spark):
    root = f"{workspace(spark)}/declared"
    rows = [("t1", "a", "c", "m", 1, None, "2024-01-01", 3, 0, 1_704_067_200, 5.0, "online", None, 0)]
    cols = ("txn_id STRING, account_id STRING, customer_id STRING, merchant_id STRING, location_id INT, ts TIMESTAMP_NTZ, "
            "txn_date STRING, hour_local INT, dow_local INT, ts_epoch BIGINT, amount DOUBLE, channel STRING, device_id STRING, is_fraud INT")
    writers.write_transactions(spark.createDataFrame(rows, cols), f"{root}/transactions")
    got = readers.read_transactions(spark, root, since="2024-01-01", until="2024-01-01").first()
    assert got.txn_id == "t1" and got.amount == 5.0 and got.txn_date == "2024-01-01"


def test_sql_runner_binds_only_named_parameters(spark, star, tmp_path):
    analytics.register_views(star)
    path = tmp_path / "q.sql"
    path.write_text("-- :nothing here\nSELECT channel, COUNT(*) AS n FROM transactions GROUP BY channel ORDER BY n DESC LIMIT :limit")
    assert analytics.run_sql_file(spark, str(path), {**analytics.default_bindings(), "limit": 2}).count() == 2


def test_library_runs_and_shares_add_up(spark, star):
    p = replace(THIRTY_DAYS.analytics, min_txn=1, category_min_txn=1)
    out = f"{workspace(spark)}/library"
    results = analytics.run_library(star, p, out)
    assert len(results) == 11
    assert results["01_transaction_frequency"].agg(F.sum("pct_of_customer_months")).first()[0] == pytest.approx(100, abs=0.1)
    assert results["03_spending_patterns"].agg(F.sum("pct_of_spend")).first()[0] == pytest.approx(100, abs=0.5)
    back = spark.read.option("header", True).csv(f"{out}/09_hourly_lift")
    assert back.columns == results["09_hourly_lift"].columns and back.count() == 24


def test_velocity_peaks_with_hot_customers(star):
    a = analytics.velocity_peaks(star, AnalyticsParams(limit=50)).collect()
    assert a == analytics.velocity_peaks(star, AnalyticsParams(limit=50), Skew(3)).collect()


def test_forest_separates_an_outlier(spark):
    from ledgerlens.operators.anomaly import FOREST_FEATURES

    rng = np.random.default_rng(0)
    rows = [(i, *[float(v) for v in rng.normal(size=len(FOREST_FEATURES))]) for i in range(400)]
    rows.append((999, *[12.0] * len(FOREST_FEATURES)))
    df = spark.createDataFrame(rows, ["txn_id", *FOREST_FEATURES])
    forest = fit_forest(df, seed=1, trees=30, sample=128)
    scores = df.select("txn_id", forest_score(forest, df).alias("s")).toPandas().set_index("txn_id").s
    assert scores.idxmax() == 999 and scores.between(0, 1).all()
    again = fit_forest(df.repartition(5), seed=1, trees=30, sample=128)
    assert np.array_equal(forest.threshold, again.threshold)  # same forest whatever the partitioning


def test_training_orders_thresholds_and_calibrates(trained, data):
    m, scored = trained.model, trained.scored
    assert m.review <= m.block and m.features == FEATURES
    p = scored.agg(F.min("p_model"), F.max("p_model"), F.count("*"), F.countDistinct("txn_id")).first()
    assert 0 <= p[0] and p[1] <= 1 and p[2] == p[3]
    assert {r.band for r in scored.select("band").distinct().collect()} <= {"allow", "review", "block"}
    assert {r.split for r in scored.select("split").distinct().collect()} == {"valid", "test"}
    row = evaluation.ranking_metrics(scored.where("split = 'test'"), "p_model").first()
    assert row.pr_auc > row.base_rate


def test_test_labels_never_reach_the_model(trained, data):
    """Flipping every test-period label leaves thresholds and validation scores as they are."""
    flipped = data.withColumn("is_fraud", F.when(F.col("split") == "test", 1 - F.col("is_fraud")).otherwise(F.col("is_fraud")))
    other = training.train_all(flipped, LIGHT, forest=False)
    assert (other.model.review, other.model.block) == pytest.approx((trained.model.review, trained.model.block))
    a = trained.scored.where("split = 'valid'").select("txn_id", "p_model")
    b = other.scored.where("split = 'valid'").select("txn_id", F.col("p_model").alias("q"))
    assert a.join(b, "txn_id").where(F.abs(F.col("p_model") - F.col("q")) > 1e-9).count() == 0


def test_banned_columns_are_refused(data):
    with pytest.raises(ValueError):
        training.train_all(data.withColumn("is_fraud_true", F.lit(0)), LIGHT, [*FEATURES, "is_fraud_true"])


def test_full_run_writes_every_artifact(spark, star):
    from ledgerlens.sources.views import truth
    from tests.conftest import SF

    out = f"{workspace(spark)}/run"
    t = report.run(star, replace(LIGHT, training=replace(LIGHT.training, boosting_rounds=3)), out, truth(spark, SF))
    scored = readers.read_scored(spark, f"{out}/scored")
    assert scored.count() == t.scored.count() and {"reasons", "top_reason", "true_pattern"} <= set(scored.columns)
    alerts = scored.where(f"split = 'test' and p_model >= {t.model.review}")
    assert alerts.where("reasons = ''").count() == 0
    assert scored.where(f"split = 'valid' and reasons <> ''").count() == 0
    assert spark.read.json(f"{out}/metrics/methods_test").count() == 6
    assert spark.read.json(f"{out}/monitoring/summary").first().status in ("ok", "warn", "alert")
    assert spark.read.json(f"{out}/run_manifest").first().n_transactions == star.transactions.count()
    loaded = training.RiskModel.load(f"{out}/model")
    assert (loaded.review, loaded.block) == (t.model.review, t.model.block)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_needed_columns_and_push_filters(spark):
    from ledgerlens.sources.views import merchants, sales_transactions, transactions
    from tests.conftest import SF

    plan = plan_of(analytics.merchant_risk(sales_transactions(spark, SF), merchants(spark, SF)))
    assert "ReadSchema: struct<l_suppkey:bigint,l_extendedprice:double,l_returnflag:string>" in plan
    assert "CartesianProduct" not in plan
    plan = plan_of(transactions(spark, SF).where("amount > 100").select("txn_id"))
    assert "GreaterThan(value,100.0)" in plan


def test_top_lists_do_not_sort_everything(star):
    assert "TakeOrderedAndProject" in plan_of(analytics.unusual_behaviour(star))


def test_scratch_tables_are_deleted(spark):
    from pathlib import Path

    from ledgerlens.session import scratch

    before = materialize(spark.range(3), "kept")
    with scratch(spark):
        inside = materialize(spark.range(5), "gone")
        assert inside.count() == 5
        path = Path(inside.inputFiles()[0].removeprefix("file://").removeprefix("file:"))
        assert path.exists()
    assert not path.parent.exists() and before.count() == 3


def test_shuffle_files_go_with_the_write(tmp_path):
    """Storing a table leaves no shuffle files behind and the session's setting as it was."""
    import subprocess
    import sys

    code = f"""
import glob, os
os.environ["SPARK_LOCAL_DIRS"] = {str(tmp_path)!r}
from ledgerlens.session import SHUFFLE_CLEANUP, local_session, materialize
s = local_session(2, shuffle_partitions=3, memory="1g")
before = s.conf.get(SHUFFLE_CLEANUP)
stored = materialize(s.range(100000).selectExpr("id % 1000 k").groupBy("k").count(), "t")
files = lambda: glob.glob({str(tmp_path)!r} + "/**/shuffle_*", recursive=True)
for _ in range(50):
    if not files():
        break
    __import__("time").sleep(0.1)
assert not files() and stored.count() == 1000 and s.conf.get(SHUFFLE_CLEANUP) == before
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)


def test_scored_sink_query(spark, trained, monkeypatch):
    from ledgerlens.plans import catalog

    monkeypatch.setattr(catalog, "_tables", {(spark.sparkContext.applicationId, "own", "trained"): trained})
    rows = catalog.QUERIES["snk4_scored_parquet"](spark, "own").collect()
    assert len(rows) == trained.scored.count() and {r.split for r in rows} == {"valid", "test"} and all(r.complete for r in rows)


def test_unusual_behaviour_after_zero_amounts(spark):
    """A mean of zero gives an infinite ratio, or none that is a number, and comes first as in the statement."""
    from ledgerlens.sources.views import Star

    rows = [(1, 1, 100, 0.0), (2, 1, 200, 5.0), (3, 2, 100, 0.0), (4, 2, 200, 0.0), (5, 3, 100, 2.0), (6, 3, 200, 3.0)]
    t = spark.createDataFrame([(i, c, s, a, "online", 0) for i, c, s, a in rows],
                              "txn_id long, customer_id long, ts_epoch long, amount double, channel string, is_fraud int")
    t = t.withColumn("ts", F.timestamp_seconds("ts_epoch"))
    found = analytics.unusual_behaviour(Star(t, None, None, None, None), AnalyticsParams(burst_count=1)).collect()
    assert [(r.txn_id, r.flag) for r in found] == [(4, "velocity_burst"), (2, "spike+burst"), (6, "velocity_burst")]
    assert np.isnan(found[0].amount_vs_mean) and found[1].amount_vs_mean == np.inf and found[2].amount_vs_mean == 1.5


def test_feature_rows_stay_out_of_one_generated_method(data):
    """The method that reads all columns is one that the JVM compiles late or never, so Spark must not use it."""
    from ledgerlens.session import TUNING

    plan = data._sc._jvm.PythonSQLUtils.explainString(data._jdf.queryExecution(), "codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", plan)]
    assert max(sizes) > int(TUNING["spark.sql.codegen.hugeMethodLimit"])
