"""Strictly-past window sums that survive hot keys.

A window partitioned by a key is one task per key, so a key that holds a large share of all rows would
stall the job. Keys above a row limit are cut into time slabs ``(key, slab)``; each slab additionally
receives *history rows* that stand for everything before it:

* halo rows: earlier rows within ``reach`` seconds, pre-aggregated to one row per second
  (at most ``reach`` plus one slab length of them, however hot the key is);
* one carry row: totals of everything earlier than the halo.

Sums, counts, minima and maxima over ``own + history`` rows are then exactly those over the whole key, so the
caller writes ordinary windows over ``partition_keys`` and keeps the rows with ``_own`` set. Without hot keys
nothing is added and the window runs over the plain key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.config import DAY
from ledgerlens.session import materialize


@dataclass(frozen=True)
class HotKeys:
    """``table(_hot_key, _slab_s)``: at most total_rows / rows_per_task entries, so it is safe to broadcast."""

    key: str
    table: DataFrame


def find_hot_keys(rows: DataFrame, key: str, rows_per_task: int, reach: int = 0) -> HotKeys | None:
    """Keys with more than ``rows_per_task`` rows and the slab length that spreads their rows.

    A slab repeats the history of ``reach`` seconds, so it is made long enough to hold as many rows of its own: history rows are one a second at
    most, and all slabs together never have more of them than there are rows, however short ``rows_per_task`` would make a slab.
    """
    daily = rows.groupBy(key, F.floor(F.col("ts_epoch") / DAY).alias("_day")).agg(F.count("*").alias("_n"))
    per_key = daily.groupBy(key).agg(F.sum("_n").alias("_n"), F.count("*").alias("_days"))
    seconds_a_row = F.lit(float(DAY)) * F.col("_days") / F.col("_n")
    own = F.floor(F.lit(float(DAY * rows_per_task)) * F.col("_days") / F.col("_n"))
    slab = F.greatest(own, F.ceil(F.lit(float(reach)) * F.least(F.lit(1.0), seconds_a_row)))
    hot = per_key.where(F.col("_n") > rows_per_task).select(
        F.col(key).alias("_hot_key"), F.greatest(slab, F.lit(60)).cast("bigint").alias("_slab_s"))
    if hot.isEmpty():
        return None
    return HotKeys(key, materialize(hot, "hot-keys"))


def partition_keys(key: str, hot: HotKeys | None) -> list[str]:
    return [key] if hot is None else [key, "_slab"]


def attach_slab(rows: DataFrame, hot: HotKeys | None) -> DataFrame:
    """Adds ``_slab_s`` (missing for ordinary keys) and ``_slab``."""
    if hot is None:
        return rows
    joined = rows.join(F.broadcast(hot.table), F.col(hot.key).eqNullSafe(F.col("_hot_key")), "left").drop("_hot_key")
    return joined.withColumn("_slab", slab_of(F.col("ts_epoch")))


def slab_of(ts: Column) -> Column:
    return F.coalesce(F.floor(ts / F.col("_slab_s")), F.lit(0)).cast("bigint")


def _merge(cols: Sequence[str], how) -> list[Column]:
    return [how(c).alias(c) for c in cols]


def history_rows(rows: DataFrame, hot: HotKeys, reach: int, sums: Sequence[str], maxima: Sequence[str] = (),
                 minima: Sequence[str] = ()) -> DataFrame:
    """Halo and carry rows for the slabs of hot keys; columns: key, _slab, ts_epoch, sums, maxima, minima.

    ``sums[0]`` must never be missing on ``rows`` (a row count, say): it tells a slab with a past from one without.
    """
    key = hot.key
    merged = [*_merge(sums, F.sum), *_merge(maxima, F.max), *_merge(minima, F.min)]
    measures = [*sums, *maxima, *minima]
    hot_rows = rows.where(F.col("_slab_s").isNotNull())
    seconds = hot_rows.groupBy(key, "_slab_s", "_slab", "ts_epoch").agg(*merged)
    width = F.ceil(F.lit(float(reach)) / F.col("_slab_s")).cast("bigint")

    slabs = seconds.groupBy(key, "_slab_s", "_slab").agg(*merged)
    wanted = slabs.select(F.col(key).alias("_k"), F.col("_slab").alias("_target"))
    halo = seconds.withColumn("_target", F.explode(F.sequence(F.col("_slab") + 1, F.col("_slab") + width)))
    halo = halo.join(wanted, F.col(key).eqNullSafe(F.col("_k")) & (halo["_target"] == wanted["_target"]), "left_semi")
    halo = halo.select(key, F.col("_target").alias("_slab"), "ts_epoch", *measures)

    # A slab's totals reach the carry of slabs more than ``width`` later: both meet on a shifted slab axis.
    moved = slabs.select(key, "_slab_s", (F.col("_slab") + width + 1).alias("_at"), F.lit(False).alias("_asks"), *measures)
    empty = [F.lit(None).cast(slabs.schema[c].dataType).alias(c) for c in measures]
    asks = slabs.select(key, "_slab_s", F.col("_slab").alias("_at"), F.lit(True).alias("_asks"), *empty)
    upto = Window.partitionBy(key).orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    carried = [*[F.sum(c).over(upto).alias(c) for c in sums], *[F.max(c).over(upto).alias(c) for c in maxima],
               *[F.min(c).over(upto).alias(c) for c in minima]]
    carry = (moved.unionByName(asks).select(key, "_slab_s", "_at", "_asks", *carried).where("_asks")
             .select(key, F.col("_at").alias("_slab"), ((F.col("_at") - width) * F.col("_slab_s") - 1).alias("ts_epoch"),
                     *measures)
             .where(F.col(sums[0]).isNotNull()))
    return halo.unionByName(carry)


def with_history(rows: DataFrame, hot: HotKeys | None, reach: int, sums: Sequence[str], maxima: Sequence[str] = (),
                 minima: Sequence[str] = ()) -> DataFrame:
    """``rows`` plus the history rows of hot keys; rows of ``rows`` keep their ``_own`` flag (default true)."""
    own = rows if "_own" in rows.columns else rows.withColumn("_own", F.lit(True))
    if hot is None:
        return own
    extra = history_rows(rows, hot, reach, sums, maxima, minima).withColumn("_own", F.lit(False))
    return own.unionByName(extra, allowMissingColumns=True)


def with_pair_carry(rows: DataFrame, hot: HotKeys | None, dims: Sequence[str]) -> DataFrame:
    """Prepares running counts per (key, dim value).

    Adds one weight column ``_w_<dim>`` per dim: 1 on own rows; on carry rows the number of rows of that pair
    in all earlier slabs, placed at the pair's last earlier time.
    """
    own = rows.withColumns({"_own": F.lit(True), **{f"_w_{d}": F.lit(1).cast("bigint") for d in dims}})
    if hot is None:
        return own
    out = own
    hot_rows = rows.where(F.col("_slab_s").isNotNull())
    for d in dims:
        per_slab = hot_rows.groupBy(hot.key, "_slab", d).agg(F.count("*").alias("_n"), F.max("ts_epoch").alias("_t"))
        before = Window.partitionBy(hot.key, d).orderBy("_slab").rowsBetween(Window.unboundedPreceding, -1)
        carry = (per_slab.select(hot.key, "_slab", d, F.sum("_n").over(before).alias(f"_w_{d}"),
                                 F.max("_t").over(before).alias("ts_epoch"), F.lit(False).alias("_own"))
                 .where(F.col(f"_w_{d}").isNotNull()))
        out = out.unionByName(carry, allowMissingColumns=True)
    return out


def before(keys: Sequence[str], seconds: int = 1, order: str = "ts_epoch"):
    """All rows of the key at least ``seconds`` earlier; grows with the row, so it costs linear time."""
    return Window.partitionBy(*keys).orderBy(order).rangeBetween(Window.unboundedPreceding, -seconds)


def running(column: Column, window) -> Column:
    return F.coalesce(F.sum(column).over(window), F.lit(0))


def last_seconds(column: Column, keys: Sequence[str], span: int) -> Column:
    """Sum over ``[t - span, t)`` as a difference of two growing sums instead of a rescanned sliding frame."""
    return running(column, before(keys)) - running(column, before(keys, span + 1))
