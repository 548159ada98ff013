"""Row-level expressions; plain Column functions that stay inside generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.schema import CATEGORIES

EARTH_RADIUS_KM = 6371.0088


def flag(condition: Column) -> Column:
    """0/1 integer; an unknown condition counts as 0."""
    return F.when(condition, 1).otherwise(0)


def flag_or_null(condition: Column) -> Column:
    return condition.cast("int").cast("double")


def safe_div(a: Column, b: Column) -> Column:
    """``a / b`` where b is positive, otherwise missing."""
    return F.when(b > 0, a / b)


def ieee_div(a: Column, b: Column) -> Column:
    """``a / b`` of doubles by IEEE 754: a zero denominator gives an infinity, or NaN for zero by zero, instead of an error."""
    zero = F.when(a > 0, float("inf")).when(a < 0, float("-inf")).when(a == 0, float("nan"))
    return F.when(b != 0, a / b).when(b == 0, zero)


def signed_log(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def logit(p: Column, eps: float = 1e-6) -> Column:
    clipped = F.when(p.isNotNull(), F.greatest(F.lit(eps), F.least(p, F.lit(1.0 - eps))))
    return F.log(clipped / (1.0 - clipped))


def at_least(x: Column, floor: float) -> Column:
    """max(x, floor) that keeps missing values missing (``greatest`` would skip them)."""
    return F.when(x < floor, F.lit(floor)).otherwise(x)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2) - F.radians(lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(F.when(a > 1.0, F.lit(1.0)).otherwise(a)))


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a UTC timestamp (with or without time zone)."""
    return F.unix_timestamp(ts)


def local_hour(epoch: Column, utc_offset: Column) -> Column:
    shifted = F.floor((epoch + utc_offset * 3600) / 3600)
    return (((shifted % 24) + 24) % 24).cast("int")


def local_weekday(epoch: Column, utc_offset: Column) -> Column:
    """0 = Monday; 1970-01-01 was a Thursday."""
    shifted = F.floor((epoch + utc_offset * 3600) / 86400) + 3
    return (((shifted % 7) + 7) % 7).cast("int")


def category_code(category: Column) -> Column:
    position = F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), category)
    return F.when(position > 0, (position - 1).cast("double"))


def right_closed_bucket(x: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the interval ``(edges[i], edges[i+1]]`` holding x; outside all of them: missing."""
    out = F.when(x <= edges[0], F.lit(None).cast("string"))
    for label, upper in zip(labels, edges[1:]):
        out = out.when(x <= upper, F.lit(label))
    return out


# Edges and labels of the buckets; the last one is open.
def amount_bucket(amount: Column) -> Column:
    return right_closed_bucket(amount, [0, 25, 100, 500, float("inf")], ["<25", "25-100", "100-500", "500+"])


def history_bucket(prior_n: Column) -> Column:
    return right_closed_bucket(F.coalesce(prior_n, F.lit(0)), [-1, 9, 49, float("inf")],
                               ["new (<10 txns)", "established (10-49)", "mature (50+)"])


def band(p: Column, review: float, block: float) -> Column:
    return F.when(p >= block, "block").when(p >= review, "review").otherwise("allow")


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    """``a / b``, or ``empty`` when the denominator is zero."""
    return F.when(b != 0, a / b).otherwise(F.lit(empty))
