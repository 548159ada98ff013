"""Content fingerprint of a table and the run manifest."""

from __future__ import annotations

import hashlib
import json
import platform
from collections.abc import Sequence
from dataclasses import asdict

import numpy
import pandas
import pyarrow
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens import __version__
from ledgerlens.config import Settings


def _text(df: DataFrame, name: str) -> Column:
    """A value as text that tells different values apart: exact for floating point, in UTC for times; its length stands before it, a missing value is ``-``."""
    kind, value = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        text = F.regexp_replace(F.regexp_replace(F.format_string("%a", value.cast("double")), r"\.0p", "p"), r"\+", "")
    elif isinstance(kind, T.TimestampType):
        text = F.unix_micros(value).cast("string")
    elif isinstance(kind, T.AtomicType):
        text = value.cast("string")
    else:
        text = F.to_json(F.struct(value))
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))


LANES = 8


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: row count and an order-independent digest, without a sort.

    Every row is digested by SHA-256; the digests are added up as eight numbers of 32 bits, each modulo 2 ** 32. Rows that are there several times count each
    time, and finding other rows with the same sums is a generalised birthday problem over 256 bits instead of one over 64.
    """
    row = F.sha2(F.concat(*[_text(df, c) for c in columns or df.columns]).cast("binary"), 256)
    lanes = [F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)") for i in range(LANES)]
    sums = df.select(row.alias("h")).agg(F.count("*").alias("n_rows"), *[(F.coalesce(F.sum(x), F.lit(0)) % (1 << 32)).cast("bigint").alias(f"l{i}")
                                                                         for i, x in enumerate(lanes)])
    text = F.concat_ws("|", F.col("n_rows").cast("string"), *[F.col(f"l{i}").cast("string") for i in range(LANES)])
    return sums.select("n_rows", F.sha2(text.cast("binary"), 256).alias("fingerprint"))


def manifest(transactions: DataFrame, settings: Settings, headline: dict) -> DataFrame:
    """One row that says which data, settings and versions produced a set of outputs."""
    config = json.dumps(asdict(settings), sort_keys=True)
    spark = transactions.sparkSession
    of_jvm = spark.sparkContext._jvm.System.getProperty
    versions = {"spark": spark.version, "java": of_jvm("java.version"), "python": platform.python_version(), "numpy": numpy.__version__,
                "pandas": pandas.__version__, "pyarrow": pyarrow.__version__}
    return fingerprint(transactions).select(
        F.lit(__version__).alias("project_version"), F.col("n_rows").alias("n_transactions"),
        F.col("fingerprint").alias("data_fingerprint"), F.lit(hashlib.sha256(config.encode()).hexdigest()).alias("config_sha256"),
        F.lit(config).alias("config"), F.lit(json.dumps(versions)).alias("packages"),
        F.lit(json.dumps(headline, sort_keys=True)).alias("headline"))
