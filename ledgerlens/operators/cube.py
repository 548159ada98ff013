"""Stored counts behind the drift reports: each day's rows are read once, reports are roll-ups.

Layout of ``folder``: ``edges`` (bin edges per feature), ``reference`` (counts per feature and bin), ``bins/day=..`` (counts per feature and bin of a day) and
``totals/day=..`` (rows, alerts and score sum of a day). A day takes at most features * (bins + 1) rows, however many transactions it has, and a block of
days or a trend reads only these. The values equal those of ``drift.windowed_drift`` and ``drift.feature_drift``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators import drift


class DriftCube:
    """Counts of ``features`` and ``score`` per day under ``folder``; alerts are scores of at least ``threshold``."""

    def __init__(self, spark: SparkSession, folder: str, features: Sequence[str], score: str, threshold: float):
        self.spark, self.folder, self.score, self.threshold = spark, folder, score, threshold
        self.features = [*drift.drift_features(features), score]

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def start(self, reference: DataFrame, bins: int = 10) -> None:
        """Fixes the bins and the reference counts; days that are stored already belong to the old bins, so begin with an empty folder."""
        drift.bin_edges(reference, self.features, bins).write.parquet(f"{self.folder}/edges")
        drift.bin_counts(reference, self.features, self._table("edges")).write.parquet(f"{self.folder}/reference")

    def add(self, rows: DataFrame, day: str = "day") -> None:
        """Counts whole days of ``rows``; a day that is given again, after a retry or with late rows, replaces its counts and leaves all others as they are."""
        score, dated = F.col(self.score), rows.withColumn("day", F.col(day))
        counts = drift.bin_counts(dated, self.features, self._table("edges"), ["day"])
        totals = dated.groupBy("day").agg(F.count("*").alias("n"), F.count_if(score >= self.threshold).alias("alerts"),
                                          F.count(score).alias("scores"), F.sum(score).alias("score_sum"))
        for table, name in ((counts, "bins"), (totals, "totals")):
            (table.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day")
             .parquet(f"{self.folder}/{name}"))

    def _blocks(self, window_days: int) -> DataFrame:
        return drift.with_windows(self._table("totals"), window_days)  # one row per day

    def _psi(self, days: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        counts = self._table("bins").join(F.broadcast(days.select("day", *by)), "day")  # one row per day
        return drift.psi_of_counts(self._table("edges"), self._table("reference"), counts.groupBy(*by, "feature", "bin").agg(F.sum("n").alias("n")), by)

    def windowed_drift(self, window_days: int) -> DataFrame:
        """As ``drift.windowed_drift``."""
        days = self._blocks(window_days)
        base = days.groupBy("window").agg(F.min("_d0").alias("_d0"), F.sum("n").alias("n_txn"), (F.sum("alerts") / F.sum("n")).alias("alert_rate"),
                                          F.try_divide(F.sum("score_sum"), F.sum("scores")).alias("mean_score"))
        return drift.drift_report(self._psi(days, ["window"]), base, self.score, window_days)

    def latest_drift(self, window_days: int) -> DataFrame:
        """PSI and status per feature in the last full block, largest first."""
        days = self._blocks(window_days)
        last = days.join(F.broadcast(days.agg(F.max("window").alias("window"))), "window", "left_semi")
        psi = self._psi(last).where(F.col("feature") != self.score)
        return psi.withColumn("status", drift.status(F.col("psi"))).orderBy(F.desc_nulls_last("psi"), "feature")
