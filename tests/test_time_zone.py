"""Streams and texts of SQL do not depend on the session's time zone."""

from pyspark.sql import functions as F

from ledgerlens.plans.analytics import run_sql
from ledgerlens.streaming.kpi import volume_stream


def test_windows_in_another_zone(spark):
    """Day blocks of a streaming-style aggregation are UTC days in any session zone."""
    day = 19_000 * 86_400
    rows = [(i, day + h * 3600, 0.5) for i, h in enumerate((0, 3, 12, 23, 24, 47))]
    df = spark.createDataFrame(rows, "txn_id long, ts_epoch long, score double")
    found = {}
    for zone in ("UTC", "America/New_York"):
        old = spark.conf.get("spark.sql.session.timeZone")
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            out = volume_stream(df.withColumn("ts", F.timestamp_seconds("ts_epoch")), F.col("score") > 1, 1)
            found[zone] = sorted((r[0], r[1]) for r in out.select(F.unix_seconds("start"), "n_txn").collect())
        finally:
            spark.conf.set("spark.sql.session.timeZone", old)
    assert found["UTC"] == found["America/New_York"] == [(day, 4), (day + 86_400, 2)]


def test_dashes_in_a_literal(spark):
    row = run_sql(spark, "SELECT 'a--:b' AS x, :n AS y -- :unused\n", {"n": 3, "unused": 4}).first()
    assert (row.x, row.y) == ("a--:b", 3)
