"""Data-quality checks: keys, references, nulls, validation of incoming rows, order and leakage."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.config import DAY, Skew
from ledgerlens.operators.ordering import range_partitioned
from ledgerlens.schema import BANNED_COLUMNS, CHANNELS, FEATURES
from ledgerlens.sources.views import Star

FOREIGN_KEYS = [("customer_id", "customers", "customer_id"), ("account_id", "accounts", "account_id"),
                ("merchant_id", "merchants", "merchant_id"), ("location_id", "locations", "location_id")]
REQUIRED = ["txn_id", "account_id", "customer_id", "merchant_id", "location_id", "ts", "txn_date", "hour_local",
            "dow_local", "ts_epoch", "amount", "channel", "is_fraud"]

# Shape and limits of an acceptable incoming row.
ID_PATTERN, ID_LENGTH, DEVICE_LENGTH, MAX_AMOUNT = "^[A-Za-z0-9_-]+$", 16, 32, 1e7


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def require_unique(df: DataFrame, key: str) -> None:
    if not duplicate_keys(df, key).isEmpty():
        raise ValueError(f"{key} is not unique")


def key_report(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows and duplicated keys per table."""
    parts = [df.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n"))
             .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.when(F.col("n") > 1, 1)).alias("duplicate_keys"))
             .select(F.lit(name).alias("table_name"), "n_rows", "duplicate_keys") for name, (df, key) in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def orphan_report(star: Star) -> DataFrame:
    """Transactions whose foreign key has no dimension row; ids are counted first, so a hot id is one row."""
    parts = []
    for fk, table, pk in FOREIGN_KEYS:
        used = star.transactions.groupBy(F.col(fk).alias("id")).agg(F.count("*").alias("n"))
        known = getattr(star, table).select(F.col(pk).alias("id"))
        parts.append(used.join(known, "id", "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orphans"))
                     .select(F.lit(fk).alias("foreign_key"), "orphans"))
    return reduce(DataFrame.unionByName, parts)


def null_report(df: DataFrame, columns: Sequence[str] = REQUIRED) -> DataFrame:
    counts = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in columns])
    return counts.select(F.explode(pairs).alias("p")).select("p.column_name", "p.nulls")


def foreign_accounts(star: Star) -> DataFrame:
    """Transactions on an account of another customer (distinct pairs are joined, not rows)."""
    pairs = star.transactions.groupBy("account_id", "customer_id").agg(F.count("*").alias("n"))
    owners = star.accounts.select("account_id", F.col("customer_id").alias("owner"))
    return pairs.join(owners, "account_id").where(F.col("owner") != F.col("customer_id")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("mismatched"))


def validate_rows(rows: DataFrame, star: Star) -> DataFrame:
    """Adds ``reject_reasons`` (empty = acceptable): missing id or time, id shape, amount, channel and unknown ids."""
    def bad_id(name: str, length: int) -> Column:
        text = F.col(name).cast("string")
        return ~(text.rlike(ID_PATTERN) & (F.length(text) <= length))

    amount = F.col("amount").cast("double")
    checks = {"customer_id": bad_id("customer_id", ID_LENGTH), "account_id": bad_id("account_id", ID_LENGTH),
              "merchant_id": bad_id("merchant_id", ID_LENGTH),
              "device_id": F.col("device_id").isNotNull() & bad_id("device_id", DEVICE_LENGTH),
              "amount": ~((amount > 0) & (amount < MAX_AMOUNT) & ~F.isnan(amount)),
              "channel": ~F.col("channel").isin(*CHANNELS),
              "txn_id": F.col("txn_id").isNull(), "ts_epoch": F.col("ts_epoch").isNull()}
    out = rows
    unknown = []
    for fk, table, pk in FOREIGN_KEYS:
        known = getattr(star, table).select(F.col(pk).cast("string").alias(f"_k_{fk}"))
        out = out.join(known, F.col(fk).cast("string") == F.col(f"_k_{fk}"), "left")
        unknown.append(F.when(F.col(f"_k_{fk}").isNull(), F.lit(f"unknown_{fk}")))
    reasons = [F.when(F.coalesce(bad, F.lit(True)), F.lit(f"bad_{name}")) for name, bad in checks.items()]
    return out.withColumn("reject_reasons", F.array_compact(F.array(*reasons, *unknown))).drop(
        *[f"_k_{fk}" for fk, _, _ in FOREIGN_KEYS])


def order_report(transactions: DataFrame) -> DataFrame:
    """Rows whose time is before that of the row with the next smaller id, and non-positive amounts.

    Ids are range partitioned; each range compares its first row with the last row of the range before it.
    """
    ranged = range_partitioned(transactions.select("txn_id", "ts_epoch", "amount"), ["txn_id"])
    inside = ranged.withColumn("_p", F.lag("ts_epoch").over(Window.partitionBy("_part").orderBy("txn_id"))).agg(
        F.count(F.when(F.col("_p") > F.col("ts_epoch"), 1)).alias("_inside"),
        F.count(F.when(~(F.col("amount") > 0), 1)).alias("bad_amounts"))
    ends = ranged.groupBy("_part").agg(F.min_by("ts_epoch", "txn_id").alias("_first"), F.max_by("ts_epoch", "txn_id").alias("_last"))
    across = ends.withColumn("_p", F.lag("_last").over(Window.orderBy("_part"))).agg(  # one row per range
        F.count(F.when(F.col("_p") > F.col("_first"), 1)).alias("_across"))
    return inside.crossJoin(F.broadcast(across)).select((F.col("_inside") + F.col("_across")).alias("unordered"), "bad_amounts")


def banned_columns(df: DataFrame) -> list[str]:
    """Ground-truth columns present in a feature or model input."""
    return sorted(set(df.columns) & set(BANNED_COLUMNS))


def leakage_audit(star: Star, label_delay_days: int, cut_epoch: int, skew: Skew = Skew(), build: Callable | None = None) -> DataFrame:
    """Rows up to the cut whose features change when everything after the cut is dropped (should be none).

    ``build`` makes the features, by default ``build_features``.
    """
    from ledgerlens.operators.features import build_features, partitions_for

    build = build or build_features
    past = Star(star.transactions.where(F.col("ts_epoch") <= cut_epoch), star.customers, star.accounts, star.merchants,
                star.locations)
    full = build(star, label_delay_days, skew, keep=["ts_epoch"]).where(F.col("ts_epoch") <= cut_epoch)
    part = build(past, label_delay_days, skew)
    different = F.lit(False)
    for f in FEATURES:
        a, b = F.col(f"a.{f}").cast("double"), F.col(f"b.{f}").cast("double")
        different = different | (a.isNull() != b.isNull()) | F.coalesce(F.abs(a - b) > 1e-6, F.lit(False))
    parts = partitions_for(full, star.transactions.count())  # wide rows of both sides are sorted by id
    if parts:
        full, part = full.repartition(parts, "txn_id"), part.repartition(parts, "txn_id")
    joined = full.alias("a").join(part.alias("b"), F.col("a.txn_id") == F.col("b.txn_id"), "full")
    return joined.where(F.col("a.txn_id").isNull() | F.col("b.txn_id").isNull() | different).select(
        F.coalesce("a.txn_id", "b.txn_id").alias("txn_id"))


def last_cut(transactions: DataFrame, share: float = 2 / 3) -> int:
    """A cut time at the given share of the covered time range (one row)."""
    r = transactions.agg(F.min("ts_epoch").alias("lo"), F.max("ts_epoch").alias("hi")).first()
    return int(r["lo"] + (r["hi"] - r["lo"]) * share) // DAY * DAY
