"""Windowed volume and alert rate of the scored stream, and its precision and recall once labels arrive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def volume_stream(scored: DataFrame, alert: Column, window_days: int, first_day: int = 0, lateness: str = "1 day") -> DataFrame:
    """Rows and alerts per block of days. Spark aligns windows to 1970-01-01; ``first_day`` (days since then) moves
    the grid to the data's first day. A block is emitted once the watermark passes its end."""
    offset = f"{first_day % window_days} days"
    w = F.window("ts", f"{window_days} days", startTime=offset)
    timed = scored.withColumn("ts", F.timestamp_seconds("ts_epoch"))  # UTC, whatever the session's zone
    return (timed.withWatermark("ts", lateness).groupBy(w.alias("w"))
            .agg(F.count("*").alias("n_txn"), F.sum(F.when(alert, 1).otherwise(0)).alias("n_alerts"))
            .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_txn", "n_alerts",
                    (F.col("n_alerts") / F.col("n_txn")).alias("alert_rate")))


def matured_kpi(scored: DataFrame, labels: DataFrame, alert: Column, as_of_epoch: Column, delay_seconds: int,
                day: Column) -> DataFrame:
    """Per day precision and recall over rows whose label is known by ``as_of_epoch``: a stream-static join on the id."""
    known = scored.where(F.col("ts_epoch") + delay_seconds <= as_of_epoch).join(labels.select("txn_id", "is_fraud"), "txn_id")
    a, y = F.when(alert, 1).otherwise(0), F.col("is_fraud")
    return known.groupBy(day.alias("day")).agg(F.count("*").alias("n"), F.sum(a).alias("alerts"), F.sum(y).alias("fraud"),
                                               F.sum(a * y).alias("caught"))


def labelled_stream(scored: DataFrame, labels: DataFrame, delay_seconds: int, lateness: str = "1 day") -> DataFrame:
    """Rows of the stream ``scored`` (``txn_id``, ``ts_epoch`` and others, no ``is_fraud``) with ``is_fraud`` from the stream ``labels`` (``txn_id``,
    ``is_fraud``, ``label_epoch``: when the label became known).

    A label counts if it is known between the transaction and ``delay_seconds`` after it. A row comes out when its label does; a row without one
    comes out once, with a null label, when the watermark has passed its maturity. Both sides keep state no longer than that. An event that is
    delivered again within ``lateness`` changes nothing; one with a null id finds no label.
    """
    rows = scored.withColumn("ts", F.timestamp_seconds("ts_epoch")).withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["txn_id"])
    known = labels.select(F.col("txn_id").alias("_label_id"), "is_fraud", F.timestamp_seconds("label_epoch").alias("_label_ts"))
    known = known.where("is_fraud IS NOT NULL").withWatermark("_label_ts", lateness).dropDuplicatesWithinWatermark(["_label_id"])
    matched = F.expr(f"txn_id = _label_id AND _label_ts >= ts AND _label_ts <= ts + INTERVAL {int(delay_seconds)} SECONDS")
    return rows.join(known, matched, "left").drop("_label_id", "_label_ts")


def start_label_kpi(scored: DataFrame, labels: DataFrame, alert: Column, day: Column, delay_seconds: int, out: str, checkpoint: str,
                    lateness: str = "1 day", available_now: bool = False) -> StreamingQuery:
    """Counts per day of what each micro-batch of ``labelled_stream`` brings, stored in a folder per batch: a repeated batch replaces its own."""
    a, y = F.when(alert, 1).otherwise(0), F.col("is_fraud")

    def store(rows: DataFrame, batch_id: int) -> None:
        (rows.groupBy(day.alias("day")).agg(F.count(y).alias("n"), F.sum(F.when(y.isNotNull(), a)).alias("alerts"), F.sum(y).alias("fraud"),
                                            F.sum(a * y).alias("caught"), F.count_if(y.isNull()).alias("expired"))
         .write.mode("overwrite").parquet(f"{out}/batch={batch_id}"))

    writer = labelled_stream(scored, labels, delay_seconds, lateness).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def label_kpi(spark: SparkSession, out: str) -> DataFrame:
    """Per day rows with a label, alerts, fraud and caught fraud among them, and rows whose label never came."""
    names = ["n", "alerts", "fraud", "caught", "expired"]
    return spark.read.parquet(out).groupBy("day").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])
