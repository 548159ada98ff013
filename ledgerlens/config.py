"""Frozen settings; every function takes them as arguments so tests can shrink them."""

from __future__ import annotations

from dataclasses import dataclass, field

DAY = 86_400


# The defaults of Split, Cost and Training.
@dataclass(frozen=True)
class Split:
    """Time split in days since the first transaction day.

    train ``[warmup, train_end - delay)``, valid ``[train_end, valid_end - delay)``, test ``[valid_end, ..)``;
    the gaps keep every label used for fitting mature at the moment it is used.
    """

    label_delay_days: int = 14
    warmup_days: int = 30
    train_end_day: int = 230
    valid_end_day: int = 290


@dataclass(frozen=True)
class Cost:
    review_cost: float = 6.0
    friction_cost: float = 3.0
    fraud_fixed_cost: float = 25.0
    loss_given_missed: float = 1.0
    review_minutes_per_alert: float = 6.0
    analyst_hours_per_day: float = 6.5


@dataclass(frozen=True)
class AnalyticsParams:
    """Bind values of the analytical queries."""

    limit: int = 25
    k: int = 200
    min_txn: int = 100
    month_buckets: tuple[int, int, int, int] = (2, 5, 10, 20)
    spike_ratio: float = 5.0
    spike_min_history: int = 10
    burst_count: int = 4
    category_min_txn: int = 200
    baseline_days: int = 28
    baseline_min_days: int = 14
    z_limit: float = 3.0


@dataclass(frozen=True)
class Skew:
    """A key with more rows than ``rows_per_task`` is cut into time slabs of about that many rows."""

    rows_per_task: int = 2_000_000


@dataclass(frozen=True)
class Training:
    seed: int = 42
    boosting_rounds: int = 350
    boosting_step: float = 0.06
    boosting_depth: int = 5
    min_leaf_rows: int = 40
    logistic_c: float = 0.3
    logistic_iterations: int = 800
    forest_trees: int = 200
    forest_sample: int = 256
    drift_reference_days: int = 60


@dataclass(frozen=True)
class Settings:
    split: Split = field(default_factory=Split)
    cost: Cost = field(default_factory=Cost)
    skew: Skew = field(default_factory=Skew)
    training: Training = field(default_factory=Training)
    analytics: AnalyticsParams = field(default_factory=AnalyticsParams)
    monitor_window_days: int = 14


# The driver tables span 30 days, so the day-based settings are scaled to that range.
THIRTY_DAYS = Settings(
    split=Split(label_delay_days=2, warmup_days=3, train_end_day=16, valid_end_day=22),
    analytics=AnalyticsParams(min_txn=50, month_buckets=(55, 65, 75, 85), burst_count=1,
                              baseline_days=14, baseline_min_days=7, z_limit=1.5),
    monitor_window_days=4,
)
