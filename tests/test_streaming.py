"""Stream results equal batch results, whatever the batching; late and defective rows are handled."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.config import DAY, THIRTY_DAYS
from ledgerlens.operators.features import build_features
from ledgerlens.schema import FEATURES
from ledgerlens.session import workspace
from ledgerlens.streaming import scoring, velocity


def frame(df, columns):
    return df.select("txn_id", *columns).toPandas().set_index("txn_id").sort_index().astype(float)


def close(a, b):
    return bool((((a - b).abs() <= 1e-6) | (a.isna() & b.isna())).all().all())


@pytest.fixture()
def root(spark):
    import uuid

    return f"{workspace(spark)}/test-{uuid.uuid4().hex}"


def known(star):
    """Rows whose merchant exists (the others would be rejected)."""
    return star.transactions.join(star.merchants.select("merchant_id"), "merchant_id").select(*star.transactions.columns)


def test_stream_scoring_equals_batch(spark, star, root):
    from dataclasses import replace

    rows = known(star)
    base = replace(star, transactions=rows)
    cut = rows.agg(F.max("ts_epoch")).first()[0] - 2 * DAY
    rows.where(F.col("ts_epoch") < cut).write.parquet(f"{root}/history/batch=-1")
    late = rows.where(F.col("ts_epoch") >= cut)
    bad = late.orderBy("txn_id").limit(1).withColumns({"txn_id": F.lit(-5).cast("bigint"), "amount": F.lit(-1.0)})
    stream_schema, middle = rows.schema, cut + DAY
    for part in [late.where(F.col("ts_epoch") < middle), late.where(F.col("ts_epoch") >= middle).unionByName(bad)]:
        part.coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(stream_schema).parquet(f"{root}/in")
        q = scoring.start_scoring(stream, f"{root}/history", base, THIRTY_DAYS, f"{root}/scored", f"{root}/bad", f"{root}/check",
                                  available_now=True)
        q.awaitTermination()
    got = frame(spark.read.parquet(f"{root}/scored"), FEATURES)
    want = frame(build_features(base, 2).join(rows.where(F.col("ts_epoch") >= cut).select("txn_id"), "txn_id"), FEATURES)
    assert len(got) == late.count() and close(got, want)
    rejected = spark.read.parquet(f"{root}/bad").collect()
    assert [(r.txn_id, r.reject_reasons) for r in rejected] == [(-5, ["bad_amount"])]
    assert spark.read.parquet(f"{root}/history").count() == rows.count()


def test_replay_equals_batch(star):
    ids = star.transactions.where("is_fraud = 1").select("txn_id")
    got = frame(scoring.replay(star, ids, THIRTY_DAYS, lambda f: f), FEATURES)
    want = frame(build_features(star, 2).join(ids, "txn_id"), FEATURES)
    assert len(got) and close(got, want)


def test_history_is_shared_entities_only(star):
    t = star.transactions
    cut = t.agg(F.max("ts_epoch")).first()[0] - 3600
    batch, stored = t.where(F.col("ts_epoch") >= cut), t.where(F.col("ts_epoch") < cut)
    p, b = stored.toPandas(), batch.toPandas()
    want = set(p[p.customer_id.isin(b.customer_id) | p.merchant_id.isin(b.merchant_id)].txn_id)
    got = [r.txn_id for r in scoring.relevant_history(stored, batch).collect()]
    assert set(got) == want and len(got) == len(want)


def test_velocity_state_over_several_batches(spark, star, root):
    """Three files in time order, one row repeated late beyond the watermark: it is dropped, the rest equals batch."""
    t, schema = star.transactions, star.transactions.schema
    lo, hi = t.agg(F.min("ts_epoch"), F.max("ts_epoch")).first()
    third = (hi - lo) // 3 + 1
    old = t.orderBy("ts_epoch").limit(1).withColumn("customer_id", F.lit(-1).cast("bigint"))
    for i in range(3):
        part = t.where(F.floor((F.col("ts_epoch") - lo) / third) == i)
        (part.unionByName(old) if i == 2 else part).coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(schema).parquet(f"{root}/in")
        q = (velocity.velocity_stream(stream).writeStream.format("parquet").option("path", f"{root}/out")
             .option("checkpointLocation", f"{root}/check").outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
    columns = [*velocity.SPANS, "sum_1h", "sum_24h", "sum_7d", "small_cnt_30m", "online_cnt_1h", "distinct_merchants_24h"]
    out = spark.read.parquet(f"{root}/out")
    assert out.where("customer_id = -1").count() == 0
    rows = t.select("txn_id", "customer_id", "ts_epoch").join(out, ["customer_id", "ts_epoch"])
    got, want = frame(rows, columns), frame(build_features(star, 2), columns)
    assert len(got) == len(want) and close(got, want)


def test_redelivered_events_change_nothing(spark, star, root):
    """The same events in a later batch, and twice in one batch, are scored and stored once; local time is added on arrival."""
    from dataclasses import replace

    rows = known(star)
    cut = rows.agg(F.max("ts_epoch")).first()[0] - DAY
    rows.where(F.col("ts_epoch") < cut).write.parquet(f"{root}/history/batch=-1")
    late = rows.where(F.col("ts_epoch") >= cut)
    arriving = late.drop("ts_epoch", "txn_date", "hour_local", "dow_local")
    want = sorted(map(tuple, late.select("txn_id", "txn_date", "hour_local", "dow_local", "ts_epoch").collect()))
    for part in (arriving, arriving.unionByName(arriving)):
        part.coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(arriving.schema).parquet(f"{root}/in")
        q = scoring.start_scoring(stream, f"{root}/history", replace(star, transactions=rows), THIRTY_DAYS, f"{root}/scored", f"{root}/bad",
                                  f"{root}/check", available_now=True)
        q.awaitTermination()
        assert spark.read.parquet(f"{root}/scored").count() == late.count()
        stored = spark.read.parquet(f"{root}/history").where("batch >= 0")
        assert sorted(map(tuple, stored.select("txn_id", "txn_date", "hour_local", "dow_local", "ts_epoch").collect())) == want


def test_model_scores_and_reasons_of_a_batch(spark, star, data):
    from dataclasses import replace

    from ledgerlens.plans import training

    light = replace(THIRTY_DAYS, training=replace(THIRTY_DAYS.training, boosting_rounds=3, logistic_iterations=20, min_leaf_rows=5))
    model = replace(training.train_all(data, light, forest=False).model, review=0.01)
    ids = star.transactions.where("txn_id % 40 = 0").select("txn_id")
    got = scoring.replay(star, ids, THIRTY_DAYS, scoring.model_scorer(model), ["amount"])
    rows = got.select("p_model", "band", "reasons", "top_reason", "score_rules").collect()
    assert len(rows) == ids.count() and all(0 <= r.p_model <= 1 for r in rows)
    assert all((r.reasons != "") == (r.p_model >= 0.01) for r in rows) and any(r.reasons != "" for r in rows)
    direct = {r.txn_id: r.p_model for r in model.predict(data.join(ids, "txn_id")).select("txn_id", "p_model").collect()}
    again = {r.txn_id: r.p_model for r in got.select("txn_id", "p_model").collect()}
    assert all(again[t] == pytest.approx(p, abs=1e-6) for t, p in direct.items())


def test_state_does_not_grow_with_the_history(spark, star, root):
    """Whatever the length of the history, a batch reads the rows of the last days and one total per key; many small batches equal one plan over everything."""
    from dataclasses import replace

    from ledgerlens.streaming.state import State

    rows = known(star)
    base = replace(star, transactions=rows)
    last = rows.agg(F.max("ts_epoch")).first()[0]
    state, day0 = State(spark, f"{root}/state", base, 2, buckets=4), last // DAY - 5
    state.start(rows.where(F.col("ts_epoch") < day0 * DAY))
    got, sizes = [], []
    newest = rows.where(F.col("ts_epoch") < day0 * DAY).agg(F.max("ts_epoch")).first()[0]
    for i in range(5):
        batch = rows.where((F.col("ts_epoch") >= (day0 + i) * DAY) & (F.col("ts_epoch") < (day0 + i + 1) * DAY))
        for _ in range(2 if i == 3 else 1):  # one batch is repeated
            past = state.past(batch, i)
            got.append(scoring.batch_features(base, batch, THIRTY_DAYS, past=past).withColumn("b", F.lit(i)).select("b", "txn_id", *FEATURES).collect())
            state.add(batch, i)
        sizes.append(past.by_customer.count())
        newest_now = batch.agg(F.max("ts_epoch")).first()[0]
        assert past.by_customer.where(F.col("ts_epoch") < past.cut).isEmpty() and past.cut >= newest // DAY * DAY - 8 * DAY
        newest = newest_now or newest
        assert past.older.customers.count() <= batch.select("customer_id").distinct().count()
    again = got.pop(4)
    assert sorted(map(str, again)) == sorted(map(str, got[3]))
    seen = {r["txn_id"]: [None if r[f] is None else float(r[f]) for f in FEATURES] for part in got for r in part}
    wanted = build_features(base, 2).join(rows.where((F.col("ts_epoch") >= day0 * DAY) & (F.col("ts_epoch") < (day0 + 5) * DAY)).select("txn_id"), "txn_id").collect()
    assert len(seen) == len(wanted) and max(sizes) < rows.count()
    for r in wanted:
        for f, x in zip(FEATURES, seen[r["txn_id"]]):
            assert (x is None) == (r[f] is None) and (x is None or x == pytest.approx(float(r[f]), abs=1e-6)), (r["txn_id"], f)


def test_state_reads_only_the_buckets_of_the_batch(spark, star, root):
    from dataclasses import replace

    from ledgerlens.streaming.state import State

    rows = known(star)
    state = State(spark, f"{root}/state", replace(star, transactions=rows), 2, buckets=8)
    state.start(rows)
    one = rows.where(F.col("txn_id") == rows.agg(F.min("txn_id")).first()[0])
    plan = state.past(one, 0).older.customers._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan or "(bucket#" in plan.split("PartitionFilters")[1][:80]
    assert state.past(one, 0).by_customer.select("customer_id").distinct().count() <= 1


def test_labels_that_arrive_later(spark, star, root):
    """Two streams in four runs: matched rows equal the batch join, rows whose label never comes are counted once when they expire, repeats change nothing."""
    from ledgerlens.streaming import kpi

    delay = 2 * DAY
    day, alert = F.floor(F.col("ts_epoch") / DAY), F.col("amount") > 50
    rows = star.transactions.select("txn_id", "ts_epoch", "amount")
    low, high = rows.agg(F.min("ts_epoch"), F.max("ts_epoch")).first()
    lost = F.col("txn_id") % 7 == 0
    late = F.col("txn_id") % 7 == 1  # known after maturity
    known = star.transactions.where(~lost).select("txn_id", "is_fraud", (F.col("ts_epoch") + F.when(late, delay + 5).otherwise(delay // 2)).alias("label_epoch"))
    cuts = [low - 1, low + (high - low) // 3, low + 2 * (high - low) // 3, high + 10 * DAY]
    end = spark.createDataFrame([(-1, high + 20 * DAY, 0.0)], rows.schema)  # moves the watermark on
    last = spark.createDataFrame([(-2, 0, high + 20 * DAY)], known.schema)
    for i in range(4):
        if i < 3:
            new = [t.where((F.col(c) > cuts[i]) & (F.col(c) <= cuts[i + 1])) for t, c in ((rows, "ts_epoch"), (known, "label_epoch"))]
            again = [t.unionByName(t.orderBy("txn_id").limit(50)) for t in new]
        else:
            again = [end, last]
        for t, name in zip(again, ("scores", "labels")):
            t.coalesce(1).write.mode("append").parquet(f"{root}/{name}")
        streams = [spark.readStream.schema(t.schema).parquet(f"{root}/{n}") for t, n in ((rows, "scores"), (known, "labels"))]
        kpi.start_label_kpi(*streams, alert, day, delay, f"{root}/counts", f"{root}/check", available_now=True).awaitTermination()
    got = {r["day"]: tuple(r)[1:] for r in kpi.label_kpi(spark, f"{root}/counts").collect()}
    a, y = F.when(alert, 1).otherwise(0), F.when(~(lost | late), F.col("is_fraud"))
    want = star.transactions.groupBy(day.alias("day")).agg(F.count(y), F.coalesce(F.sum(F.when(y.isNotNull(), a)), F.lit(0)), F.coalesce(F.sum(y), F.lit(0)),
                                                           F.coalesce(F.sum(a * y), F.lit(0)), F.count_if(y.isNull()))
    assert got == {r["day"]: tuple(r)[1:] for r in want.collect()} and sum(v[4] for v in got.values()) > 0


def test_tasks_of_a_batch_grow_in_number_not_in_size(spark, star, monkeypatch):
    from ledgerlens.operators import features

    monkeypatch.setattr(features, "ROWS_PER_PARTITION", 40)
    ids = star.transactions.where("txn_id % 40 = 0").select("txn_id")
    got = scoring.replay(star, ids, THIRTY_DAYS, lambda f: f)
    assert got.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
    assert close(frame(got, FEATURES), frame(build_features(star, 2).join(ids, "txn_id"), FEATURES))


def test_velocity_against_single_rows():
    """Batches of one customer, some of them with missing merchants, amounts and channels, against a count of single rows."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(4)
    parts = []
    for i in range(3):
        n = 60
        rows = pd.DataFrame({"ts_epoch": np.sort(i * 50_000 + rng.integers(0, 50_000, n) // 20 * 20), "merchant_id": rng.integers(0, 9, n),
                             "amount": np.round(rng.exponential(9, n), 2), "channel": rng.choice(["online", "atm"], n)})
        if i == 1:  # the ids arrive as floats
            rows.loc[::7, ["merchant_id", "amount", "channel"]] = None
        parts.append(rows)
    past = velocity._seconds(parts[0])
    for rows in parts[1:]:
        past = velocity._merged(past, velocity._seconds(rows))
    every = pd.concat(parts)
    times = past["sec"]
    assert times.tolist() == sorted(set(every.ts_epoch)) and velocity._seconds(every[every.ts_epoch < 0]) is None
    got = velocity._features(times, past)
    for i, t in enumerate(times):
        def last(span):
            return every[(every.ts_epoch < t) & (every.ts_epoch >= t - span)]

        assert [got[c][i] for c in velocity.SPANS] == [len(last(s)) for s in velocity.SPANS.values()]
        assert got["sum_24h"][i] == pytest.approx(last(DAY).amount.sum(), abs=1e-6)
        assert got["small_cnt_30m"][i] == (last(1800).amount < 5).sum() and got["online_cnt_1h"][i] == (last(3600).channel == "online").sum()
        assert got["distinct_merchants_24h"][i] == last(DAY).merchant_id.nunique(dropna=False)
