"""What scoring needs to know about the past, kept up to date batch by batch.

A version of the state consists of the rows of the last days, stored by customer and by merchant, and of totals of everything before: one row per
customer, per (customer, value) pair and per merchant. Rows and totals lie in ``buckets`` folders by the hash of their key. A micro-batch reads the newest version
before it, the rows of the batches since, and of all these only the buckets of its own keys; how long the history is makes no difference. When the
last days have moved on by ``step_days``, the rows that fell behind are added to the totals and a new version is written.

Versions and batches carry the id of the batch that wrote them, are written whole before their ``meta`` row, and a batch looks only at what has a smaller
id. So a batch that is repeated finds the state it found before and overwrites what it wrote.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.config import DAY
from ledgerlens.operators.features import FACT_COLUMNS, PAIR_DIMS, Older, enrich_event, with_pair_values
from ledgerlens.sources.views import Star

SLIM = ["merchant_id", "ts_epoch", "amount", "is_fraud"]
WINDOW_DAYS = 7  # longest window over single rows


@dataclass(frozen=True)
class Past:
    """Rows and totals of the keys of one batch."""

    by_customer: DataFrame
    by_merchant: DataFrame
    older: Older
    cut: int


def bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def customer_totals(rows: DataFrame) -> DataFrame:
    """One row per customer of enriched rows; the same columns as the totals that it is added to."""
    log = F.log1p("amount")
    return rows.groupBy("customer_id").agg(
        F.count("*").alias("_n"), F.sum("amount").alias("_amt"), F.sum(log).alias("_log"), F.sum(log * log).alias("_log2"),
        F.sum((F.col("hour_local") <= 5).cast("bigint")).alias("_night"), F.max("amount").alias("_peak"), F.min("ts_epoch").alias("_first"),
        F.max(F.struct("ts_epoch", "txn_id", "lat", "lon")).alias("_prev"))


def pair_totals(rows: DataFrame) -> DataFrame:
    """How often and when last each customer was seen with each value of each of ``PAIR_DIMS``: ``dim``, ``value`` (null is a value too)."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in PAIR_DIMS])
    long = with_pair_values(rows).select("customer_id", "ts_epoch", F.explode(pairs).alias("p")).select("customer_id", "ts_epoch", "p.*")
    return long.groupBy("customer_id", "dim", "value").agg(F.count("*").alias("n"), F.max("ts_epoch").alias("last"))


def merchant_totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("merchant_id").agg(F.count("*").alias("_n"), F.sum("amount").alias("amount"), F.count("is_fraud").alias("_labelled"),
                                           F.coalesce(F.sum("is_fraud"), F.lit(0)).alias("_fraud"))


def _added(old: DataFrame, new: DataFrame, keys: Sequence[str], how: dict[str, str]) -> DataFrame:
    """Totals of two sets of rows."""
    function = {"sum": F.sum, "max": F.max, "min": F.min}
    return old.unionByName(new).groupBy(*keys).agg(*[function[f](c).alias(c) for c, f in how.items()])


CUSTOMER = {"_n": "sum", "_amt": "sum", "_log": "sum", "_log2": "sum", "_night": "sum", "_peak": "max", "_first": "min", "_prev": "max"}
PAIR = {"n": "sum", "last": "max"}
MERCHANT = {"_n": "sum", "amount": "sum", "_labelled": "sum", "_fraud": "sum"}


class State:
    """The versions under ``path``; ``dims`` gives the lookups that totals are grouped by."""

    def __init__(self, spark: SparkSession, path: str, dims: Star, label_delay_days: int, buckets: int = 16, late_days: int = 1, step_days: int = 1):
        self.spark, self.path, self.dims, self.buckets, self.step = spark, path.rstrip("/"), dims, buckets, step_days * DAY
        self.reach = max(WINDOW_DAYS, label_delay_days) * DAY
        self.keep = self.reach + late_days * DAY

    # ------------------------------------------------------------------------------------------ storage
    def _ids(self, kind: str, before: int) -> list[int]:
        """Finished versions or batches with an id below ``before``."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        top = hadoop.Path(f"{self.path}/{kind}")
        fs = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(top):
            return []
        ids = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(top) if "=" in s.getPath().getName()]
        return sorted(i for i in ids if i < before and fs.exists(hadoop.Path(f"{self.path}/{kind}/id={i}/meta/_SUCCESS")))

    def _write(self, table: DataFrame, folder: str, key: str) -> None:
        rows = table.withColumn("bucket", bucket(key, self.buckets))
        # a bucket that outgrows a task is split; a task holds no more than that however long the history is
        rows.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{folder}")

    def _meta(self, folder: str, cut: int) -> None:
        self.spark.range(1).select(F.lit(cut).cast("bigint").alias("cut")).write.mode("overwrite").parquet(f"{self.path}/{folder}/meta")

    def _read(self, folders: Sequence[str], like: DataFrame, buckets: Sequence[int] | None) -> DataFrame:
        found = [self.spark.read.schema(like.withColumn("bucket", F.lit(0)).schema).parquet(f"{self.path}/{f}") for f in folders]
        rows = reduce(DataFrame.unionByName, found)
        return (rows if buckets is None else rows.where(F.col("bucket").isin(list(buckets)))).drop("bucket")

    def _empty(self) -> dict[str, DataFrame]:
        """Tables without rows that show the columns of each kind."""
        rows = self.dims.transactions.limit(0).select(*FACT_COLUMNS)
        rich = enrich_event(rows, self.dims)
        return {"customers": customer_totals(rich), "pairs": pair_totals(rich), "merchants": merchant_totals(rows), "by_customer": rows, "by_merchant": rows.select(*SLIM)}

    # ------------------------------------------------------------------------------------------ use
    def exists(self) -> bool:
        return bool(self._ids("version", 1 << 62))

    def start(self, rows: DataFrame, batch_id: int = -1) -> None:
        """First version from a whole history; the only step that reads all of it."""
        last = rows.agg(F.max("ts_epoch")).first()[0]
        self._version(batch_id, self._cut(last or 0), self._empty(), rows.select(*FACT_COLUMNS), rows.select(*SLIM))

    def _cut(self, last: int) -> int:
        return last // DAY * DAY - self.keep

    def _version(self, batch_id: int, cut: int, totals: dict[str, DataFrame], rows: DataFrame, slim: DataFrame) -> None:
        folder, old = f"version/id={batch_id}", F.col("ts_epoch") < cut
        rich = enrich_event(rows.where(old), self.dims)
        self._write(_added(totals["customers"], customer_totals(rich), ["customer_id"], CUSTOMER), f"{folder}/customers", "customer_id")
        self._write(_added(totals["pairs"], pair_totals(rich), ["customer_id", "dim", "value"], PAIR), f"{folder}/pairs", "customer_id")
        self._write(_added(totals["merchants"], merchant_totals(slim.where(old)), ["merchant_id"], MERCHANT), f"{folder}/merchants", "merchant_id")
        self._write(rows.where(~old), f"{folder}/by_customer", "customer_id")
        self._write(slim.where(~old), f"{folder}/by_merchant", "merchant_id")
        self._meta(folder, cut)

    def _newest(self, batch_id: int) -> tuple[int, int, list[int]]:
        """Id and cut of the newest version before the batch, and the batches since."""
        version = self._ids("version", batch_id)[-1]
        cut = self.spark.read.schema("cut bigint").parquet(f"{self.path}/version/id={version}/meta").first()["cut"]
        return version, cut, [i for i in self._ids("batch", batch_id) if i > version]

    def _tables(self, version: int, since: list[int], buckets: dict[str, list[int]] | None) -> dict[str, DataFrame]:
        out = {}
        for name, like in self._empty().items():
            folders = [f"version/id={version}/{name}", *([f"batch/id={i}/{name}" for i in since] if name.startswith("by_") else [])]
            key = "merchant_id" if "merchant" in name else "customer_id"
            out[name] = self._read(folders, like, buckets and buckets[key])
        return out

    def first_time(self, batch_id: int) -> int:
        """Rows before this time are too late: their windows begin before the rows that are kept."""
        return self._newest(batch_id)[1] + self.reach

    def past(self, batch: DataFrame, batch_id: int) -> Past:
        """What the batch needs: rows and totals of its customers and merchants."""
        keys = {k: batch.select(k).distinct() for k in ("customer_id", "merchant_id")}
        wanted = {k: sorted(r[0] for r in v.select(bucket(k, self.buckets)).distinct().collect()) for k, v in keys.items()}  # at most ``buckets`` numbers
        version, cut, since = self._newest(batch_id)
        tables = self._tables(version, since, wanted)
        own = {n: t.join(keys["merchant_id" if "merchant" in n else "customer_id"], "merchant_id" if "merchant" in n else "customer_id", "left_semi")
               .select(*t.columns) for n, t in tables.items()}
        return Past(own["by_customer"], own["by_merchant"], Older(own["customers"], own["pairs"], own["merchants"], cut), cut)

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """Stores the rows of a scored batch and moves the totals on when enough days have passed."""
        folder = f"batch/id={batch_id}"
        self._write(batch.select(*FACT_COLUMNS), f"{folder}/by_customer", "customer_id")
        self._write(batch.select(*SLIM), f"{folder}/by_merchant", "merchant_id")
        self._meta(folder, 0)
        last, (version, cut, since) = batch.agg(F.max("ts_epoch")).first()[0], self._newest(batch_id)
        if last is not None and self._cut(last) >= cut + self.step:
            tables = self._tables(version, [*since, batch_id], None)
            self._version(batch_id, self._cut(last), tables, tables["by_customer"], tables["by_merchant"])
