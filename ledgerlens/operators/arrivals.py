"""What arriving transactions need before they are scored: local time, and each of them only once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.columns import epoch_seconds, local_hour, local_weekday


def with_local_time(rows: DataFrame, locations: DataFrame) -> DataFrame:
    """Adds ``ts_epoch``, ``txn_date`` (UTC), ``hour_local`` and ``dow_local`` from ``ts`` and the location's offset from UTC.

    Rows of an unknown location have no local hour and weekday. Columns of these names are replaced.
    """
    made = ["ts_epoch", "txn_date", "hour_local", "dow_local"]
    offsets = locations.select(F.col("location_id").alias("_location"), F.col("utc_offset").alias("_offset"))
    joined = rows.drop(*made).join(offsets, F.col("location_id") == F.col("_location"), "left")
    joined = joined.withColumn("ts_epoch", epoch_seconds("ts"))
    day = F.date_from_unix_date(F.floor(F.col("ts_epoch") / 86_400).cast("int"))  # no zone takes part
    return joined.withColumns({"txn_date": day.cast("string"), "hour_local": local_hour(F.col("ts_epoch"), F.col("_offset")),
                               "dow_local": local_weekday(F.col("ts_epoch"), F.col("_offset"))}).drop("_location", "_offset")


def first_seen(batch: DataFrame, stored: DataFrame, row_id: str = "txn_id", time: str = "ts_epoch") -> DataFrame:
    """Rows of the batch whose id is neither stored nor earlier in the batch; a repeated id keeps its earliest row.

    An event that is delivered again has its old time, so only stored rows within the batch's span of time are compared; the two
    bounds are pushed into the scan.
    """
    span = batch.agg(F.min(time), F.max(time)).first()
    if span[0] is None:
        return batch
    known = stored.where(F.col(time).between(span[0], span[1])).select(row_id)
    whole = F.struct(F.col(time), *[F.col(c) for c in batch.columns if c != time])
    once = batch.groupBy(row_id).agg(F.min(whole).alias("_row")).select("_row.*").select(*batch.columns)
    return once.join(known, row_id, "left_anti").select(*batch.columns)
