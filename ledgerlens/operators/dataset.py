"""Dataset assembly: features with metadata, simulation day and time split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.config import DAY, Settings, Split
from ledgerlens.functions.columns import band
from ledgerlens.operators.features import HotSpots, build_features
from ledgerlens.operators.quality import require_unique
from ledgerlens.operators.rules import rule_hits, rule_score
from ledgerlens.schema import PRIMARY_KEYS
from ledgerlens.session import materialize
from ledgerlens.sources.views import Star

META = ["customer_id", "merchant_id", "account_id", "ts_epoch", "channel", "is_fraud", "ts", "category", "segment"]


def with_day(df: DataFrame, first_epoch: DataFrame | None = None) -> DataFrame:
    """Day number since midnight of the first transaction; the minimum is one row."""
    first = first_epoch or df.agg(F.min("ts_epoch").alias("_t0"))
    start = F.floor(F.col("_t0") / DAY) * DAY
    return (df.crossJoin(F.broadcast(first))
            .withColumn("day", F.floor((F.col("ts_epoch") - start) / DAY).cast("int")).drop("_t0"))


def split_of(day: Column, split: Split) -> Column:
    """train / valid / test, missing in the warm-up and in the label-maturity gaps."""
    d = split.label_delay_days
    return (F.when((day >= split.warmup_days) & (day < split.train_end_day - d), "train")
            .when((day >= split.train_end_day) & (day < split.valid_end_day - d), "valid")
            .when(day >= split.valid_end_day, "test"))


def make_dataset(star: Star, settings: Settings = Settings(), hot: HotSpots | None = None,
                 check_keys: bool = True) -> DataFrame:
    """Features plus metadata, day and split for every transaction, written once to the workspace.

    Everything downstream (rules, models, evaluation, monitoring) reads this table instead of the window plan.
    """
    if check_keys:  # a repeated dimension key would multiply rows
        for name in ("customers", "accounts", "merchants", "locations"):
            require_unique(getattr(star, name), PRIMARY_KEYS[name])
    features = build_features(star, settings.split.label_delay_days, settings.skew, hot, META)
    first = star.transactions.agg(F.min("ts_epoch").alias("_t0"))
    data = with_day(features, first)
    return materialize(data.withColumn("split", split_of(F.col("day"), settings.split)), "dataset")


def rule_scored(dataset: DataFrame, review: float, block: float) -> DataFrame:
    """Validation and test rows with rule hits, rule score and decision band."""
    return (dataset.where(F.col("split").isin("valid", "test"))
            .withColumns({"rule_hits": rule_hits(), "score_rules": rule_score()})
            .withColumn("band", band(F.col("score_rules"), review, block)))
