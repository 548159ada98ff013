"""Scoring of arriving transactions with Structured Streaming; the feature code is the batch code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlens.config import Settings
from ledgerlens.operators.arrivals import first_seen, with_local_time
from ledgerlens.operators.explain import with_reasons
from ledgerlens.operators.features import (CUSTOMER_REACH, FACT_COLUMNS, customer_history, enrich_event, merchant_history, merchant_reach,
                                            partitions_for)
from ledgerlens.operators.quality import validate_rows
from ledgerlens.operators.rules import rule_hits, rule_score
from ledgerlens.operators.skew import find_hot_keys
from ledgerlens.plans.training import RiskModel
from ledgerlens.schema import FEATURES
from ledgerlens.sources.views import Star
from ledgerlens.streaming.state import Past, State

Scorer = Callable[[DataFrame], DataFrame]


def history_of(stored: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Stored rows earlier than the batch's last row whose ``key`` occurs in the batch; the bound is a number and reaches the scan."""
    last = batch.agg(F.max("ts_epoch")).first()[0]
    past = stored.where(F.col("ts_epoch") < F.lit(last).cast("bigint"))
    return past.join(batch.select(key).distinct(), key, "left_semi").select(*stored.columns)


def relevant_history(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Earlier stored rows that share a customer or a merchant with the batch.

    Two semi joins on distinct keys and a union; one OR condition would compare every pair of rows. Rows already taken
    through their customer are left out of the merchant half, so no distinct over wide rows is needed.
    """
    customers = batch.select("customer_id").distinct()
    by_merchant = history_of(stored, batch, "merchant_id").join(customers, "customer_id", "left_anti").select(*stored.columns)
    return history_of(stored, batch, "customer_id").unionByName(by_merchant)


def batch_features(star: Star, batch: DataFrame, settings: Settings, keep: list[str] | None = None,
                   labelled: bool = False, past: Past | None = None) -> DataFrame:
    """Features of the batch rows from strictly earlier rows: stored history plus earlier rows of the batch.

    With ``past`` the rows of the last days and the totals of everything before stand for the history, which is then not read.

    ``star.transactions`` is the stored history. Arriving rows have no label yet, so theirs is blanked unless
    ``labelled``; a row's own label can never reach its features either way, because labels mature after a delay.
    The merchant half reads only four columns of the merchants' rows; the customer half only the customers' rows.
    """
    if settings.split.label_delay_days < 1:
        raise ValueError("a label delay below one day would let a row see its own label")
    keep = keep or []
    limit, delay = settings.skew.rows_per_task, settings.split.label_delay_days
    columns = [*FACT_COLUMNS, *[c for c in keep if c in batch.columns and c not in FACT_COLUMNS]]
    stored = star.transactions
    new = batch.select(*columns).withColumn("is_new", F.lit(True))
    if not labelled:
        new = new.withColumn("is_fraud", F.lit(None).cast("int"))

    slim = past.by_merchant if past else history_of(stored.select("merchant_id", "ts_epoch", "amount", "is_fraud"), batch, "merchant_id")
    older = past.older if past else None
    arrived = batch.count()
    series = new.unionByName(slim.withColumn("is_new", F.lit(False)), allowMissingColumns=True)
    parts = partitions_for(batch, arrived + slim.count())
    new = merchant_history(series, delay, find_hot_keys(series, "merchant_id", limit, merchant_reach(delay)), older, parts).where("is_new")

    old = (past.by_customer if past else history_of(stored.select(*columns), batch, "customer_id")).withColumn("is_new", F.lit(False))
    parts = partitions_for(batch, arrived + old.count() + (older.pairs.count() if older else 0))  # a pair's total becomes a row
    series = new.unionByName(old, allowMissingColumns=True)
    hot = find_hot_keys(series, "customer_id", limit, CUSTOMER_REACH)
    out = customer_history(enrich_event(series, star), star, hot, older, parts).where("is_new")
    return out.select("txn_id", *[c for c in keep if c not in FEATURES], *FEATURES)


def rule_scorer(features: DataFrame) -> DataFrame:
    """Rule hits and rule score."""
    return features.withColumns({"rule_hits": rule_hits(), "score_rules": rule_score()})


def model_scorer(model: RiskModel) -> Scorer:
    """Rule hits and score, calibrated probability, decision band, and the merged reasons of alerts."""
    def score(features: DataFrame) -> DataFrame:
        predicted = model.predict(rule_scorer(features))
        return with_reasons(model, predicted, F.col("p_model") >= model.review)

    return score


def replay(star: Star, ids: DataFrame, settings: Settings, scorer: Scorer = rule_scorer,
           keep: list[str] | None = None) -> DataFrame:
    """Re-scores stored transactions (``ids``: txn_id) from their own past only."""
    wanted = ids.select("txn_id").distinct()
    batch = star.transactions.join(wanted, "txn_id", "left_semi").select(*star.transactions.columns)
    rest = star.transactions.join(wanted, "txn_id", "left_anti").select(*star.transactions.columns)
    stored = Star(rest, star.customers, star.accounts, star.merchants, star.locations)
    return scorer(batch_features(stored, batch, settings, keep, labelled=True))


def start_scoring(stream: DataFrame, history_path: str, dims: Star, settings: Settings, scored_path: str,
                  quarantine_path: str, checkpoint: str, scorer: Scorer = rule_scorer, available_now: bool = False, buckets: int = 16) -> StreamingQuery:
    """Validates, scores and stores every micro-batch.

    Times local to the transaction's place are added to rows that come without them. Rejected rows go to the quarantine table
    with their reasons, rows that come later than a day after the newest ones with the reason ``too_late``; good rows that are not stored yet are scored and
    appended to the history. What scoring needs of the past is kept beside the history (``<history_path>-state``, see ``state.State``); it is made from the
    history when the stream first starts, and after that the history is written only.
    Each output is keyed by the batch id and overwritten when a batch is retried, so a restart repeats nothing.
    """
    spark = stream.sparkSession
    state = State(spark, f"{history_path.rstrip('/')}-state", dims, settings.split.label_delay_days, buckets)
    if not state.exists():
        state.start(spark.read.schema(dims.transactions.schema).parquet(history_path))

    def handle(batch: DataFrame, batch_id: int) -> None:
        if "hour_local" not in batch.columns:
            batch = with_local_time(batch, dims.locations)
        columns = batch.columns
        late = F.when(F.col("ts_epoch") < state.first_time(batch_id), F.array(F.lit("too_late"))).otherwise(F.array().cast("array<string>"))
        checked = validate_rows(batch, dims).withColumn("reject_reasons", F.concat("reject_reasons", late)).persist()
        good = None
        try:
            bad = checked.where(F.size("reject_reasons") > 0)
            bad.write.mode("overwrite").parquet(f"{quarantine_path}/batch={batch_id}")
            good = checked.where(F.size("reject_reasons") == 0).select(*columns)
            past = state.past(good, batch_id)
            good = first_seen(good, past.by_customer).persist()
            scored = scorer(batch_features(dims, good, settings, ["customer_id", "merchant_id", "ts_epoch"], past=past))
            scored.write.mode("overwrite").parquet(f"{scored_path}/batch={batch_id}")
            good.write.mode("overwrite").parquet(f"{history_path}/batch={batch_id}")
            state.add(good, batch_id)
        finally:
            checked.unpersist()
            if good is not None:
                good.unpersist()

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
